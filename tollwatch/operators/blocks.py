"""Block and pass counts from decision events.

Every report is one partial + final aggregation, so a hot account or country
is reduced on the map side before anything is shuffled.
"""

from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.functions.columns import title_label
from tollwatch.operators.filters import (
    account_is, in_range, keep, mcc_is, product_is, within_days,
)

CARRIER_DAY = ["data_load_date", "mcc", "mnc"]


def reason_counters(preset):
    """One sum per preset column; a null reason adds to none of them."""
    return [
        F.sum(F.when(F.col("reason") == reason, 1).otherwise(0)).alias(name)
        for name, reason in preset.items()
    ]


def block_breakdown(events, product=S.VERIFY, preset=None, days=30, as_of=None,
                    account_sid=None, mcc=None):
    """Traffic by day and carrier, split by reason; by account too unless one is given."""
    if preset is None:
        preset = S.MESSAGING_BREAKDOWN if product == S.MESSAGING else S.VERIFY_BREAKDOWN
    rows = keep(events, product_is(product), account_is(account_sid), mcc_is(mcc),
                within_days(days, as_of))
    by = CARRIER_DAY if account_sid is not None else ["account_sid", *CARRIER_DAY]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_traffic"), *reason_counters(preset))


def _counted(events, product, preset, days, as_of):
    if preset is None:
        preset = S.MESSAGING_BREAKDOWN if product == S.MESSAGING else S.VERIFY_BREAKDOWN
    counters = [F.count(F.lit(1)).alias("total_traffic"), *reason_counters(preset)]
    return keep(events, product_is(product), within_days(days, as_of)), counters


def daily_blocks(events, product=S.VERIFY, preset=None, days=30, as_of=None):
    """Traffic per account and day, split by reason: one scan and one shuffle.

    The same as ``account_daily_blocks`` of a breakdown, without its finer groups.
    """
    rows, counters = _counted(events, product, preset, days, as_of)
    return rows.groupBy("account_sid", "data_load_date").agg(*counters)


#: What each row of ``block_reports`` is about, by the columns that are not summed over.
REPORTS = {"carrier": ["account_sid", *CARRIER_DAY], "account": ["account_sid", "data_load_date"],
           "day": ["data_load_date"]}


def block_reports(events, product=S.VERIFY, preset=None, days=30, as_of=None):
    """The breakdown by carrier, by account and by day, from one scan and one shuffle.

    ``report`` names the level of a row; columns that it sums over are null.
    """
    rows, counters = _counted(events, product, preset, days, as_of)
    by = REPORTS["carrier"]
    level = {sum(1 << (len(by) - 1 - k) for k, c in enumerate(by) if c not in kept): name
             for name, kept in REPORTS.items()}
    name = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])
    found = rows.groupingSets([[F.col(c) for c in kept] for kept in REPORTS.values()], *by).agg(
        F.grouping_id().cast("int").alias("_level"), *counters)
    return found.select(F.element_at(name, F.col("_level")).alias("report"), *by,
                        "total_traffic", *[c for c in found.columns[len(by) + 2:]])


def account_daily_blocks(breakdown):
    """Sums of a breakdown per day, and per account where it has that column."""
    by = [c for c in ("account_sid", "data_load_date") if c in breakdown.columns]
    measures = [c for c in breakdown.columns if c not in ("account_sid", *CARRIER_DAY)]
    return breakdown.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures])


def daily_metrics(events, preset, days=30, as_of=None, product=None):
    """Reason counters and total per day, all products unless one is given."""
    rows = keep(events, product_is(product), within_days(days, as_of))
    return rows.groupBy("data_load_date").agg(
        *reason_counters(preset), F.count(F.lit(1)).alias("total_traffic"))


def daily_metrics_verify(events, days=30, as_of=None, product=None):
    """Largest risk block first."""
    metrics = daily_metrics(events, S.DAILY_VERIFY, days, as_of, product)
    return metrics.orderBy(F.desc("risk_score_block"), "data_load_date")


def daily_metrics_messaging(events, days=30, as_of=None, product=None):
    """Most safe-carrier passes first."""
    metrics = daily_metrics(events, S.DAILY_MESSAGING, days, as_of, product)
    return metrics.orderBy(F.desc("fgl_safe_mcc_mnc"), "data_load_date")


def range_totals(events, start, end, preset, product=None):
    """One row of reason counters over a closed date range; null sums on no rows."""
    rows = keep(events, product_is(product), in_range(start, end))
    return rows.agg(*reason_counters(preset))


def range_summary(events, start, end, preset, product):
    """One row: distinct accounts, reason counters, allowed and blocked totals.

    A null ``block`` is in neither total. The distinct count is planned as a
    grouping by account first, so no task ever holds the set of accounts.
    """
    rows = keep(events, product_is(product), in_range(start, end))
    blocked = F.col("block")
    return rows.agg(
        F.count_distinct("account_sid").alias("active_accounts"),
        *reason_counters(preset),
        F.sum(F.when(~blocked, 1).otherwise(0)).alias("total_allowed"),
        F.sum(F.when(blocked, 1).otherwise(0)).alias("total_blocked"),
    )


def block_series(daily_blocks, series=None):
    """Daily block columns as rows ``(…, series, messages)`` with readable labels."""
    series = series or S.BLOCK_SERIES
    ids = [c for c in ("account_sid", "data_load_date") if c in daily_blocks.columns]
    long = daily_blocks.unpivot(ids, series, "series", "messages")
    return long.withColumn("series", title_label("series"))

