from datetime import date

import pytest
from conftest import rows

from tollwatch import schemas as S
from tollwatch.operators import blocks, filters, traffic

D = date


@pytest.fixture(scope="module")
def events(spark):
    def row(account, day, reason, block, product="Verify", mcc="001", mnc="01"):
        return account, D(2024, 1, day), None, mcc, mnc, product, reason, block
    return spark.createDataFrame([
        row("AC1", 10, "FraudGuardPrefixBlock", True),
        row("AC1", 10, "", False),
        row("AC1", 10, None, None),
        row("AC1", 11, "", False, mcc="002"),
        row("AC2", 11, "SmsPumpingRiskScoreBlock", True, product="Messaging"),
        row("AC2", 12, "never heard of", True),
        row(None, 12, "", False),
    ], S.RAW_EVENTS)


def test_null_reason_counts_only_in_total(events):
    got = blocks.block_breakdown(events, days=30, as_of="2024-01-15").where("account_sid = 'AC1'")
    assert rows(got, "mcc", "total_traffic", "classic_fg", "allowed_messages", "spp_block") == [
        ("001", 3, 1, 1, 0), ("002", 1, 0, 1, 0)]


def test_account_column_goes_with_an_account_filter(events):
    one = blocks.block_breakdown(events, days=30, as_of="2024-01-15", account_sid="AC1", mcc="002")
    assert one.columns[:3] == ["data_load_date", "mcc", "mnc"]
    assert one.count() == 1


@pytest.mark.parametrize("days, expected", [(1, {12}), (2, {11, 12}), (3, {10, 11, 12})])
def test_lookback_is_strict_and_open_above(events, days, expected):
    kept = filters.keep(events, filters.within_days(days, "2024-01-12"))
    assert {r.data_load_date.day for r in kept.collect()} == expected


def test_rows_after_as_of_stay(events):
    assert filters.keep(events, filters.within_days(1, "2024-01-11")).count() == 4


def test_range_includes_both_ends(events):
    assert filters.keep(events, filters.in_range("2024-01-10", "2024-01-11")).count() == 5


def test_like_wildcards(events):
    assert filters.keep(events, filters.account_like("_C1")).count() == 4
    assert filters.keep(events, filters.account_like("%")).count() == 6
    assert filters.keep(events).count() == 7


def test_totals_over_no_rows_are_null(events):
    got = blocks.range_totals(events, "2025-01-01", "2025-02-01", S.TOTALS_RISK).collect()
    assert [tuple(r) for r in got] == [(None, None, None)]
    summary = blocks.range_summary(
        events, "2025-01-01", "2025-02-01", S.SUMMARY_VERIFY, "Verify").first()
    assert summary.active_accounts == 0 and summary.total_blocked is None
    assert blocks.daily_metrics(events, S.DAILY_VERIFY, 1, "2030-01-01").count() == 0


def test_null_block_is_in_no_total(events):
    got = blocks.range_summary(
        events, "2024-01-10", "2024-01-12", S.SUMMARY_VERIFY, "Verify").first()
    assert (got.active_accounts, got.total_allowed, got.total_blocked) == (2, 3, 2)


def test_daily_metrics_are_ordered(events):
    days = [r.data_load_date.day for r in
            blocks.daily_metrics_messaging(events, 30, "2024-01-15").collect()]
    assert days == [10, 11, 12]


def test_series_labels(events):
    daily = blocks.account_daily_blocks(blocks.block_breakdown(events, as_of="2024-01-15"))
    assert {r.series for r in blocks.block_series(daily).collect()} == {
        "Classic Fg", "Spp Block", "Risk Score Block", "Allowed Messages"}


def test_mean_of_means_and_null_rates(spark):
    features = spark.createDataFrame([
        ("AC1", D(2024, 1, 10), "001", "01", 1, 0.2), ("AC1", D(2024, 1, 10), "001", "01", 2, 0.4),
        ("AC1", D(2024, 1, 10), "002", "01", None, 0.9),
        ("AC1", D(2024, 1, 11), "002", "01", None, None)], S.TRAFFIC_FEATURES)
    carrier = traffic.daily_traffic(features, 30, "2024-01-12", account_sid="AC1")
    got = {r.data_load_date.day: (r.daily_message_count, r.daily_avg_cr)
           for r in traffic.account_daily_traffic(carrier).collect()}
    assert got[10] == (3, pytest.approx(0.6))
    assert got[11] == (0, None)
    assert traffic.traffic_by_code(carrier).count() == 2


def test_breakdown_combines_before_one_shuffle(events):
    plan = blocks.block_breakdown(events, as_of="2024-01-15")._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_lookback_reaches_the_scan(spark, events, path):
    events.write.partitionBy("data_load_date").parquet(path("events"))
    read = spark.read.schema(S.RAW_EVENTS).parquet(path("events"))
    plan = blocks.block_breakdown(read, as_of="2024-01-15")._jdf.queryExecution() \
        .executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "data_load_date" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "EqualTo(product_id,Verify)" in scan
    assert "event_ts" not in scan and "block:" not in scan


@pytest.mark.parametrize("config", [{}, {"do_not_include": {}}, {"do_not_include": {"mcc": []}}])
def test_no_exclusion_is_no_change(spark, config):
    df = spark.createDataFrame([("AC1", "001", "01", "Yes")], "account_sid string, mcc string,"
                               " mnc string, block string")
    assert filters.exclusion_override(df, config) is df


def test_exclusion_keeps_other_rows(spark):
    df = spark.createDataFrame(
        [("AC1", "001", "01", "Yes"), ("AC1", "002", "01", "Yes"), ("AC2", "002", "02", "Yes"),
         ("AC3", "002", "02", None), ("AC4", None, "02", "Yes"), ("AC5", "004", "02", "Yes")],
        "account_sid string, mcc string, mnc string, block string")
    config = {"do_not_include": {"mcc": ["001"], "mcc_mnc": ["002_01"],
                                 "mcc_mnc_account": ["002_02_AC2"]}}
    got = {r.account_sid + str(r.mcc): r.block
           for r in filters.exclusion_override(df, config).collect()}
    assert got == {"AC1001": "No", "AC1002": "No", "AC2002": "No", "AC3002": None,
                   "AC4None": "Yes", "AC5004": "Yes"}


def test_exclusion_lists_as_frames(spark):
    df = spark.createDataFrame([("a", "310", "26", "Yes"), ("b", "405", "12", "Yes"),
                                ("c", "222", "01", "Yes")],
                               "account_sid string, mcc string, mnc string, block string")
    mccs = spark.range(100_000).selectExpr("cast(id + 1000 as string) as entry").union(
        spark.createDataFrame([("310",), ("310",), (None,)], "entry string"))
    got = filters.exclusion_override(df, {"do_not_include": {
        "mcc": mccs, "mcc_mnc_account": ["405_12_b"]}})
    assert got.columns == df.columns
    assert rows(got, "account_sid", "block") == [("a", "No"), ("b", "No"), ("c", "Yes")]
