"""Message traffic and conversion rate."""

from pyspark.sql import functions as F

from tollwatch.operators.blocks import CARRIER_DAY
from tollwatch.operators.filters import account_is, keep, mcc_is, within_days


def daily_traffic(features, days=30, as_of=None, account_sid=None, mcc=None):
    """Messages by day and carrier, with the mean rate where the table has ``cr``."""
    rows = keep(features, account_is(account_sid), mcc_is(mcc), within_days(days, as_of))
    by = CARRIER_DAY if account_sid is not None else ["account_sid", *CARRIER_DAY]
    measures = [F.sum("total_count").alias("daily_message_count")]
    if "cr" in features.columns:
        measures.append(F.avg("cr").alias("daily_avg_cr"))
    return rows.groupBy(*by).agg(*measures)


def _rolled_up(traffic, by):
    return traffic.groupBy(*by).agg(
        F.coalesce(F.sum("daily_message_count"), F.lit(0)).alias("daily_message_count"),
        F.avg("daily_avg_cr").alias("daily_avg_cr"),
    )


def account_daily_traffic(traffic):
    """Daily traffic per day: the rate is the plain mean of the carrier means."""
    return _rolled_up(
        traffic, [c for c in ("account_sid", "data_load_date") if c in traffic.columns])


def traffic_by_code(traffic):
    """Daily traffic over all days, per carrier."""
    return _rolled_up(
        traffic, [c for c in ("account_sid", "mcc", "mnc") if c in traffic.columns])


def traffic_series(daily):
    """Points of the traffic and rate lines, in date order."""
    ids = [c for c in ("account_sid", "data_load_date") if c in daily.columns]
    return daily.select(*ids, "daily_message_count", "daily_avg_cr").orderBy(*ids)
