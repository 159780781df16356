"""Settings history and account flags, with small limits to force the hot-group path."""

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.operators import accounts
from tollwatch.operators.ordered import dense_rank_within, lag_within

T0 = datetime(2024, 1, 1)


def service_row(service, minute, configuration, account="AC1", name="n"):
    return account, service, name, configuration, T0 + timedelta(minutes=minute)


def config(flag="true", mode='"max"'):
    return f'{{"{S.ENABLED_FIELD}": {flag}, "{S.MODE_FIELD}": {mode}}}'


def history(spark, data, **options):
    frame = spark.createDataFrame(data, S.SERVICE_EVENTS)
    return accounts.service_history(frame, **options)


@pytest.mark.parametrize("text, expected", [
    (config("true"), ("enable", "max")), (config('"true"'), ("enable", "max")),
    (config("1"), ("enable", "max")), (config("null"), ("disable", "max")),
    (config("false", "null"), ("disable", None)), ("{}", ("disable", None)),
    ("not json", ("disable", None)), ("", ("disable", None)), (None, ("disable", None)),
    (config('"soon"'), ("disable", "max"))])
def test_settings_from_json(spark, text, expected):
    got = history(spark, [service_row("VA1", 0, text)]).first()
    assert (got.fraud_guard, got.fraud_guard_mode) == expected


def test_mode_change_per_service(spark):
    data = [service_row("VA1", 0, config(mode='"basic"')), service_row("VA2", 1, config()),
            service_row("VA1", 2, config()), service_row("VA1", 3, config()),
            service_row("VA1", 4, config(mode="null")), service_row("VA1", 5, config())]
    got = {(r.service_sid, r.updated_at.minute): r.mode_change
           for r in history(spark, data).collect()}
    assert got == {("VA1", 0): "No-Change", ("VA2", 1): "No-Change", ("VA1", 2): "Change",
                   ("VA1", 3): "No-Change", ("VA1", 4): "No-Change", ("VA1", 5): "No-Change"}


def test_equal_rows_count_once_but_names_keep_them_apart(spark):
    data = [service_row("VA1", 0, config()), service_row("VA1", 0, config()),
            service_row("VA1", 0, config(), name="other")]
    assert history(spark, data).count() == 2


def skewed(seed=1):
    rng = random.Random(seed)
    data = []
    for _ in range(900):
        hot = rng.random() < 0.4
        service = "VA_hot" if hot else rng.choice(["VA1", "VA2", None, "VA3"])
        mode = rng.choice(['"a"', '"b"', "null"])
        data.append(service_row(service, rng.randrange(60 if hot else 400), config(mode=mode),
                                account=rng.choice(["AC1", "AC2"]), name=rng.choice("xy")))
    return data


def by_hand_history(data):
    """Services' distinct settings in order, each with whether its mode changed."""
    out = {}
    for account, service, mode, enabled, name, moment in sorted(
            set(data), key=lambda r: tuple((x is not None, x) for x in (r[5], r[2], r[3], r[4]))):
        out.setdefault((account, service), []).append((moment, mode))
    changed = []
    for key, own in out.items():
        before = None
        for moment, mode in own:
            new = before is not None and mode is not None and mode != before
            changed.append((*key, mode, moment, "Change" if new else "No-Change"))
            before = mode
    return sorted(changed, key=repr)


@pytest.mark.parametrize("segment", ["year", "day", "minute"])
def test_segments_give_the_same_history(spark, segment):
    frame = spark.createDataFrame(skewed(), S.SERVICE_EVENTS)
    settings = accounts.service_settings(frame)
    data = [(r.account_sid, r.service_sid, r.fraud_guard_mode, r.fraud_guard, r.friendly_name,
             r.updated_at) for r in settings.collect()]
    got = accounts.service_history(frame, segment=segment)
    assert rows(got, *accounts.SERVICE, "fraud_guard_mode", "updated_at", "mode_change") \
        == by_hand_history(data)


def test_building_a_history_starts_no_job(spark):
    frame = spark.createDataFrame(skewed(), S.SERVICE_EVENTS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    accounts.service_history(frame)
    accounts.rank_by_update(frame)
    assert tracker.getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("segment", ["year", "minute"])
def test_segments_give_the_same_rank(spark, segment):
    data = [("AC1" if i % 3 else None, T0 + timedelta(minutes=m) if m else None, i)
            for i, m in enumerate(random.Random(2).choices(range(40), k=900))]
    frame = spark.createDataFrame(data, "account_sid string, updated_at timestamp, n int")
    ranked = dense_rank_within(frame, ["account_sid"], "updated_at", "r", segment)
    by_hand = {}
    for account, moment, _ in data:
        by_hand.setdefault(account, set()).add(moment)
    for account, moment, _, rank in rows(ranked):
        order = sorted(by_hand[account], key=lambda m: (m is None, -(m or T0).timestamp()))
        assert rank == order.index(moment) + 1


def test_a_hot_group_is_split_over_tasks(spark):
    """One key for all rows: windows see a segment of it each."""
    frame = spark.range(4000).selectExpr(
        "'k' as key", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as moment",
        "id % 7 as value", "id")
    got = lag_within(frame, ["key"], ["moment", "value"], "value", "before", "day")
    assert got.where("before <=> case when id = 0 then null else (id - 1) % 7 end").count() == 4000
    parts = got.select("id", F.spark_partition_id().alias("p")).groupBy("p").count()
    assert parts.count() > 2 and parts.agg(F.max("count")).first()[0] < 3000


def flags(*values):
    return ("AC1", date(2024, 1, 1), *values)


def test_latest_flags_and_status(spark):
    frame = spark.createDataFrame([
        ("AC1", date(2024, 1, 1), True, True, True, True),
        ("AC1", date(2024, 1, 3), True, False, None, True),
        ("AC2", date(2024, 1, 2), None, None, None, None),
        ("AC3", date(2024, 1, 2), False, True, True, None),
        ("AC4", date(2024, 1, 9), True, True, False, False)], S.ACCOUNT_FEATURES)
    got = {r.account_sid: (r.activity, r.protection) for r in
           accounts.account_status(accounts.latest_flags(frame)).collect()}
    assert got == {
        "AC1": ("active on Verify only", "enabled in shadow mode"),
        "AC2": ("not active", "not enabled"),
        "AC3": ("active on Messaging only", "enabled"),
        "AC4": ("active on Verify and Messaging", "not enabled")}
    assert rows(accounts.latest_flags(frame, since="2024-01-03"), "account_sid") == [("AC4",)]
    asked = spark.createDataFrame([("AC1",), ("AC9",), ("AC1",)], "account_sid string")
    assert rows(accounts.account_present(frame, asked)) == [("AC1", True), ("AC9", False)]


def test_latest_service_and_counts(spark):
    data = [service_row("VA1", 0, config()), service_row("VA1", 5, config("false", '"b"')),
            service_row("VA2", 1, config()), service_row(None, 2, config())]
    settings = accounts.service_settings(spark.createDataFrame(data, S.SERVICE_EVENTS))
    latest = accounts.latest_service(settings)
    assert rows(latest, "service_sid", "fraud_guard", "fraud_guard_mode") == sorted(
        [("VA1", "disable", "b"), ("VA2", "enable", "max"), (None, "enable", "max")], key=repr)
    assert accounts.service_count(settings).first().service_sid_count == 2
    assert accounts.by_status(latest, "disable").count() == 1
