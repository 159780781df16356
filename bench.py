"""Time the headline queries and print one JSON line.

Each query is written to the ``noop`` sink: once to warm up, then three times;
the median counts.
"""

import json
import os
import statistics
import time

from checks.queries import QUERIES
from tollwatch.session import local_session

HEADLINE = [
    "block_breakdown_verify", "block_breakdown_msg", "daily_metrics_fg",
    "range_summary_verify", "traffic_daily_verify", "account_daily_traffic",
    "account_daily_blocks", "latest_flags", "account_status", "service_history",
    "mode_change", "rank_by_update", "latest_service", "join_friendly_name",
    "skiplist_anti", "exclusion_override", "block_list_check", "delta_rows",
    "master_merge", "state_upsert", "insert_if_absent_ttl", "upsert_ttl_keys",
    "ticket_fields", "triage_report", "transcript", "route_messages", "model_compare",
]


def seconds(spark, sf_dir, name):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = cpus if cpus.isdigit() else "8"
    spark = local_session("bench", cpus, partitions)
    timed = {}
    for name in HEADLINE:
        seconds(spark, sf_dir, name)
        timed[name] = round(statistics.median(
            seconds(spark, sf_dir, name) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
