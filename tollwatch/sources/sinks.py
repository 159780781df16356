"""Writers: append, run snapshots, dated archive, item files."""

from pyspark.sql import functions as F

from tollwatch.functions.columns import RUN_TIME_FORMAT, as_timestamp
from tollwatch.sources.versions import overwrite_state

# Snapshot folder by merge key.
SNAPSHOT_KINDS = {"account_sid": "account_categorisation", "amm": "amm_threshold"}
RUN_PARTS = ["kind", "run_date", "run_time"]


def append_rows(df, path, update=True):
    """Add rows to a table, or replace it; columns may differ between writes."""
    if update:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_appended(spark, path):
    """All appended rows, columns matched by name, missing ones null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_run(df, base, kind, run_at=None):
    """Write one run's rows under kind / date / minute.

    A run repeated within the minute replaces what it wrote; other runs stay.
    """
    run = as_timestamp(run_at)
    stamped = (
        df.withColumn("kind", F.lit(kind))
        .withColumn("run_date", F.date_format(run, "yyyy-MM-dd"))
        .withColumn("run_time", F.date_format(run, RUN_TIME_FORMAT))
    )
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*RUN_PARTS).parquet(base)


def run_snapshot(df, base, key, run_at=None):
    """Snapshot of one merge run; its folder follows from the merge key."""
    write_run(df, base, SNAPSHOT_KINDS.get(key, "unknown"), run_at)


def archive(base, data_type, frames, run_at=None):
    """Publish a run's outputs under dated folders.

    ``breach`` also replaces the breach state; ``flooding`` keeps only the
    current table; anything else is phone blocking, with three tables.
    """
    if data_type == "breach":
        overwrite_state(frames["state"], f"{base}/breach_state")
        kinds = {"breach_state_data": frames["current"]}
    elif data_type == "flooding":
        kinds = {"dynamic_flooding_data": frames["current"]}
    else:
        kinds = {
            "toll_phone_data": frames["phones"],
            "higher_prefix_data": frames["prefixes"],
            "allow_list": frames["allow_list"],
        }
    for kind, df in kinds.items():
        write_run(df, f"{base}/{kind}", kind, run_at)
    return list(kinds)


def write_items(items, path):
    """Item payloads as JSON lines, one file per task."""
    items.select("item").write.mode("errorifexists").text(path)
