import os
from datetime import datetime, timedelta

import pytest
from conftest import rows

from tollwatch import schemas as S
from tollwatch.operators import blocks
from tollwatch.sources import versions
from tollwatch.streaming import daily, upsert
from tollwatch.streaming.batches import once_per_batch

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def events(spark, *data):
    return spark.createDataFrame(
        [("AC1", at(h).date(), at(h), "1", "1", "Verify", r, None) for h, r in data],
        S.RAW_EVENTS)


def test_daily_metrics_over_two_runs_with_late_events(spark, path):
    first = events(spark, (1, ""), (2, "FraudGuardPrefixBlock"), (30, ""))
    second = events(spark, (3, ""), (60, None))
    os.mkdir(path("in"))
    stream = spark.readStream.schema(S.RAW_EVENTS).parquet(path("in"))
    for part in (first, second):
        part.write.mode("append").parquet(path("in"))
        daily.start_daily_metrics(stream, path("out"), path("check")).awaitTermination()
    got = versions.read_version(spark, path("out"))
    batch = blocks.daily_metrics(first.union(second), S.DAILY_VERIFY, None)
    assert rows(got, *batch.columns) == rows(batch)


def state_rows(spark, *data):
    return spark.createDataFrame([(k, "1", "1", at(r), at(e)) for k, r, e in data], S.STATE)


def run_upsert(spark, path, merge, schema, parts):
    os.mkdir(path("in"))
    stream = spark.readStream.schema(schema).parquet(path("in"))
    for part in parts:
        part.write.mode("append").parquet(path("in"))
        upsert.start_upsert(stream, path("out"), path("check"), merge, schema).awaitTermination()
    return versions.read_version(spark, path("out"))


def test_state_upsert_per_batch(spark, path):
    none = spark.createDataFrame([], "account_sid string, mcc string, mnc string")
    got = run_upsert(spark, path, upsert.upserting(none, at(5)), S.STATE, [
        state_rows(spark, ("a", 0, 10), ("b", 0, 4)), state_rows(spark, ("a", 1, 9), ("c", 1, 7))])
    assert rows(got, "account_sid", "expiry_time") == [("a", at(10)), ("c", at(7))]
    assert versions.latest_version(spark, path("out")) == 2


def test_insert_if_absent_per_batch(spark, path):
    schema = "key string, record_time timestamp, expiry_time timestamp"
    part = lambda *d: spark.createDataFrame([(k, at(r), at(e)) for k, r, e in d], schema)
    got = run_upsert(spark, path, upsert.inserting(at(5)), schema, [
        part(("a", 0, 10)), part(("a", 1, 99), ("b", 1, 20))])
    assert rows(got, "key", "expiry_time") == [("a", at(10)), ("b", at(20))]


def test_streams_start_over_an_existing_table(spark, path):
    none = spark.createDataFrame([], "account_sid string, mcc string, mnc string")
    for name in "xyz":
        versions.overwrite_state(state_rows(spark, (name, 0, 10)), path("out"))
    got = run_upsert(spark, path, upsert.upserting(none, at(1)), S.STATE,
                     [state_rows(spark, ("a", 0, 10)), state_rows(spark, ("b", 0, 10))])
    assert [k for k, *_ in rows(got, "account_sid")] == ["a", "b", "z"]
    stream = spark.readStream.schema(S.STATE).parquet(path("in"))
    upsert.start_upsert(stream, path("out"), path("again"), upsert.upserting(none, at(1)), S.STATE,
                        keep=2).awaitTermination()
    assert [k for k, *_ in rows(versions.read_version(spark, path("out")), "account_sid")] == [
        "a", "b", "z"]
    assert len(versions.committed_versions(spark, path("out"))) == 2


def test_many_batches_equal_one(spark, path):
    none = spark.createDataFrame([], "account_sid string, mcc string, mnc string")
    data = [(k, r, r + 20) for r, k in enumerate("abcabcab")]
    os.mkdir(path("in"))
    for row in data:
        state_rows(spark, row).coalesce(1).write.mode("append").parquet(path("in"))
    stream = (spark.readStream.schema(S.STATE).option("maxFilesPerTrigger", 1)
              .parquet(path("in")))
    upsert.start_upsert(stream, path("out"), path("check"), upsert.upserting(lambda b: none, at(1)),
                        S.STATE, keep=3).awaitTermination()
    got = versions.read_version(spark, path("out"))
    assert rows(got, "account_sid", "expiry_time") == [
        ("a", at(26)), ("b", at(27)), ("c", at(25))]


def test_a_batch_is_applied_once(spark, path):
    def apply(batch, stream):
        old = versions.read_version(spark, path("out"))
        both = batch if old is None else old.union(batch)
        versions.overwrite_state(both, path("out"), stream=stream)

    first, second = (once_per_batch(path("out"), name, apply, keep=2) for name in "ab")
    for run in (first, second, second, first):  # the first stream's batch is played again last
        run(state_rows(spark, ("a", 0, 10)), 0)
    assert versions.read_version(spark, path("out")).count() == 2
    first(state_rows(spark, ("a", 0, 10)), 1)
    second(state_rows(spark, ("a", 0, 10)), 0)
    assert versions.read_version(spark, path("out")).count() == 3
    with pytest.raises(ValueError):
        once_per_batch(path("out"), "c", apply, keep=1)


def test_final_days_leave_the_state_and_late_rows_are_counted(spark, path):
    days = [events(spark, *((24 * d + h, r) for h, r in ((1, ""), (2, "FraudGuardPrefixBlock"))))
            for d in (0, 2, 9)]
    late = events(spark, (3, ""), (24 * 9 + 5, ""))
    os.mkdir(path("in"))
    stream = spark.readStream.schema(S.RAW_EVENTS).parquet(path("in"))
    dropped = 0
    for part in (*days, late):
        part.coalesce(1).write.mode("append").parquet(path("in"))
        query = daily.start_daily_metrics(stream, path("out"), path("check"), keep=2)
        query.awaitTermination()
        dropped += daily.late_rows(query)
    got = versions.read_version(spark, path("out"))
    whole = days[0].union(days[1]).union(days[2]).union(late.where("event_ts > '2024-01-05'"))
    batch = blocks.daily_metrics(whole, S.DAILY_VERIFY, None)
    assert rows(got, *batch.columns) == rows(batch)
    assert dropped == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only the newest day


def test_a_new_stream_keeps_the_days_of_the_table(spark, path):
    for name, day in (("one", 0), ("two", 24)):
        os.mkdir(path(name))
        events(spark, (day + 1, "")).write.mode("append").parquet(path(name))
        stream = spark.readStream.schema(S.RAW_EVENTS).parquet(path(name))
        daily.start_daily_metrics(stream, path("out"), path("check-" + name)).awaitTermination()
    assert versions.read_version(spark, path("out")).count() == 2


def test_a_small_batch_writes_few_buckets(spark, path):
    none = spark.createDataFrame([], "account_sid string, mcc string, mnc string")
    os.mkdir(path("in"))
    merge = upsert.upserting(lambda batch: none, at(1))
    stream = spark.readStream.schema(S.STATE).parquet(path("in"))
    written = []
    for part in ([(str(k), 0, 10) for k in range(500)], [("7", 2, 20)]):
        state_rows(spark, *part).write.mode("append").parquet(path("in"))
        before = {d for d, _, f in os.walk(path("out")) if f}
        upsert.start_upsert(stream, path("out"), path("check"), merge, S.STATE,
                            buckets=32).awaitTermination()
        written.append(sum("_bucket" in d for d, _, f in os.walk(path("out"))
                           if f and d not in before))
    assert written == [32, 1]
    got = versions.read_version(spark, path("out"))
    assert got.count() == 500 and rows(got.where("account_sid = '7'"), "expiry_time") == [(at(20),)]
