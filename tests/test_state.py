import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.operators import state
from tollwatch.plans import publish
from tollwatch.sources import sinks, tables, versions

T0 = datetime(2024, 1, 1)
PAIRS = "account_sid string, a int, b string"


def at(hours):
    return T0 + timedelta(hours=hours)


def state_frame(spark, *data):
    return spark.createDataFrame(
        [(k, "001", "01", at(r), at(e)) for k, r, e in data], S.STATE)


def keys_frame(spark, *keys):
    return spark.createDataFrame([(k, "001", "01") for k in keys],
                                 "account_sid string, mcc string, mnc string")


def expiries(df):
    return {r.account_sid: (r.expiry_time - T0).total_seconds() / 3600 for r in df.collect()}


def test_upsert_rules(spark):
    old = state_frame(spark, ("kept", 0, 50), ("cleared", 0, 50), ("expired", 0, 10),
                      ("now", 0, 20), ("longer", 0, 60), (None, 0, 70))
    new = state_frame(spark, ("cleared", 5, 40), ("longer", 5, 40), ("new", 5, 41), ("new", 6, 41),
                      ("past", 5, 9))
    got = state.state_upsert(old, new, keys_frame(spark, "cleared", None, "nobody"), at(20))
    assert expiries(got) == {"kept": 50, "cleared": 40, "longer": 60, "new": 41}
    assert got.where("account_sid = 'new'").first().record_time == at(6)


def test_upsert_without_state_returns_the_rows(spark):
    new = state_frame(spark, ("a", 0, 1), ("a", 0, 2))
    assert state.state_upsert(None, new, keys_frame(spark, "a"), at(20)) is new


def test_upsert_is_one_shuffle(spark):
    frame = state_frame(spark, ("a", 0, 1))
    plan = state.state_upsert(frame, frame, keys_frame(spark, "b"), at(0))._jdf \
        .queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def brute_upsert(old, new, cleared, now):
    rows_ = [r for r in old if r[0] not in cleared] + new
    best = {}
    for key, record, expiry in rows_:
        best[key] = max(best.get(key, (expiry, record)), (expiry, record))
    return {k: v[0] for k, v in best.items() if v[0] > now}


def test_upsert_against_brute_force(spark):
    rng = random.Random(3)
    keys = [None, "hot", *map(str, range(8))]

    def some(n):
        return [(rng.choice(keys + ["hot"] * 5), rng.randrange(20), rng.randrange(60))
                for _ in range(n)]
    old, new, cleared = some(80), some(60), rng.sample(keys, 4)
    got = state.state_upsert(state_frame(spark, *old), state_frame(spark, *new),
                             keys_frame(spark, *cleared), at(30))
    assert expiries(got) == brute_upsert(old, new, cleared, 30)


def test_latest_expiry(spark):
    got = state.dedupe_latest_expiry(state_frame(spark, ("a", 1, 5), ("a", 2, 5), ("a", 9, 4)))
    assert [(r.record_time, r.expiry_time) for r in got.collect()] == [(at(2), at(5))]


def test_cleared_matches_null_keys(spark):
    frame = state_frame(spark, ("a", 0, 1), (None, 0, 1), ("b", 0, 1))
    got = state.cleared(frame, keys_frame(spark, "a", "a", None))
    assert rows(got, "account_sid") == [("b",)]


def test_delta_is_null_safe_and_distinct(spark):
    new = spark.createDataFrame([("k", None, "x"), ("k", 1, "x"), ("k", 1, "x"), (None, 2, None)],
                                PAIRS)
    old = spark.createDataFrame([("k", None, "x"), (None, 2, None), ("gone", 1, "x")], PAIRS)
    assert rows(state.rows_not_in(new, old)) == [("k", 1, "x")]
    assert state.rows_not_in(new, old.limit(0)).count() == 3


def test_lowest_row_wins_unless_new_is_preferred(spark):
    old = spark.createDataFrame([("k", 1, "old"), ("m", 1, "old")], PAIRS)
    new = spark.createDataFrame([("k", 2, "new"), ("n", None, "new"), ("n", 5, "new")], PAIRS)
    assert rows(state.master_merge(new, old, "account_sid")) == [
        ("k", 1, "old"), ("m", 1, "old"), ("n", 5, "new")]
    assert rows(state.master_merge(new, old, "account_sid", prefer="new")) == [
        ("k", 2, "new"), ("m", 1, "old"), ("n", 5, "new")]
    assert rows(state.delta_rows(new, old, "account_sid")) == [("k", 2, "new"), ("n", 5, "new")]
    assert rows(state.master_merge(new, None, "account_sid")) == [("k", 2, "new"), ("n", 5, "new")]
    with pytest.raises(ValueError):
        state.master_merge(new, old, "account_sid", prefer="old")


def test_dedupe_of_key_only_rows(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert state.dedupe_key(frame, ["k"]).count() == 2


def test_publish_twice(spark, path):
    first = spark.createDataFrame([("k", 1, "x"), ("m", 1, "x")], PAIRS)
    second = spark.createDataFrame([("k", 0, "y"), ("n", 1, "y"), ("m", 1, "x")], PAIRS)
    paths = path("store"), path("runs")
    master, delta = publish.merge_and_publish(first, first, *paths, "account_sid")
    assert rows(master) == rows(delta) == [("k", 1, "x"), ("m", 1, "x")]
    master, delta = publish.merge_and_publish(second, second, *paths, "account_sid", run_at=T0)
    assert rows(master) == [("k", 0, "y"), ("m", 1, "x"), ("n", 1, "y")]
    assert rows(delta) == [("k", 0, "y"), ("n", 1, "y")]
    master, delta = publish.merge_and_publish(first, first, *paths, "amm", True, T0)
    assert rows(master) == rows(delta) == rows(first)
    runs = spark.read.parquet(path("runs"))
    assert {r.kind for r in runs.collect()} == {"account_categorisation", "amm_threshold"}


def test_snapshot_of_one_minute_is_replaced(spark, path):
    frame = spark.createDataFrame([("k", 1, "x"), ("m", 1, "x")], PAIRS)
    for run in (T0, T0, at(1)):
        sinks.run_snapshot(frame, path("runs"), "other", run)
    counts = spark.read.parquet(path("runs")).groupBy("kind", "run_time").count()
    assert rows(counts) == [("unknown", "2024-01-01_00_00", 2), ("unknown", "2024-01-01_01_00", 2)]


def test_state_file_is_read_and_replaced(spark, path):
    store, none = path("state"), keys_frame(spark)
    publish.update_state(store, state_frame(spark, ("a", 0, 50), ("b", 0, 5)), none)
    got = publish.update_state(store, state_frame(spark, ("c", 1, 40)), none, True, at(20))
    assert expiries(got) == {"a": 50, "c": 40}
    assert versions.latest_version(spark, store) == 2
    assert expiries(versions.read_version(spark, store, at_most=1)) == {"a": 50, "b": 5}


def test_uncommitted_version_is_not_seen(spark, path):
    store = path("state")
    versions.overwrite_state(state_frame(spark, ("a", 0, 50)), store)
    state_frame(spark, ("half", 0, 50)).write.parquet(f"{store}/data-dead")
    open(f"{store}/_committed/2", "w").close()  # a writer that died over its marker
    assert expiries(versions.read_version(spark, store)) == {"a": 50}
    assert versions.overwrite_state(state_frame(spark, ("b", 0, 50)), store) == 3
    assert expiries(versions.read_version(spark, store)) == {"b": 50}
    assert versions.committed_versions(spark, store) == [1, 3]
    assert versions.read_version(spark, path("nothing")) is None


def test_markers_are_whole_and_exclusive(spark, path, monkeypatch):
    store = path("state")
    versions.overwrite_state(state_frame(spark, ("a", 0, 50)), store)
    monkeypatch.setattr(versions, "_numbers", lambda *a: [])  # a writer that looked too early
    with pytest.raises(Exception, match="exist"):
        versions.overwrite_state(state_frame(spark, ("b", 0, 50)), store)
    monkeypatch.undo()
    assert expiries(versions.read_version(spark, store)) == {"a": 50}
    assert versions.committed_versions(spark, store) == [1]
    assert len(versions.sweep(spark, store, -1)) == 2  # its data and its marker
    assert expiries(versions.read_version(spark, store)) == {"a": 50}


def test_only_touched_buckets_are_written(spark, path):
    store = path("state")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(store) for f in names
                if f.endswith(".parquet")}

    def merge(old, batch):
        return old.union(batch).groupBy("k").agg(F.max("v").alias("v"))

    first = spark.range(4000).selectExpr("id as k", "0 as v")
    versions.upsert_buckets(first, store, merge, ["k"], n=16)
    before = files()
    assert len(before) == 16
    batch = spark.createDataFrame([(7, 1), (4001, 1)], "k long, v int")
    versions.upsert_buckets(batch, store, merge, ["k"], n=16)
    assert 1 <= len(files() - before) <= 2
    got = versions.read_version(spark, store)
    assert got.count() == 4001 and rows(got.where("v = 1"), "k") == [(7,), (4001,)]
    # old folders go only when no kept version names them
    assert versions.drop_old_versions(spark, store, 1) == [1]
    assert versions.read_version(spark, store).count() == 4001
    # another number of buckets deals all rows out anew
    versions.upsert_buckets(batch, store, merge, ["k"], n=3)
    versions.drop_old_versions(spark, store, 1)
    assert versions.read_version(spark, store).count() == 4001 and len(files()) == 3


def test_cleared_keys_empty_their_buckets(spark, path):
    store = path("state")

    def merge(old, batch):
        return old.limit(0)

    rows_ = spark.range(8).selectExpr("id as k")
    versions.upsert_buckets(rows_, store, lambda old, batch: batch, ["k"], n=4)
    versions.upsert_buckets(rows_.limit(0), store, merge, ["k"], [rows_], n=4)
    assert versions.read_version(spark, store).count() == 0
    versions.upsert_buckets(rows_.limit(2), store, lambda old, batch: batch, ["k"], n=4)
    assert versions.read_version(spark, store).count() == 2


def test_second_writer_from_one_version_fails(spark, path):
    store = path("state")
    base = versions.overwrite_state(state_frame(spark, ("a", 0, 50)), store)
    versions.overwrite_state(state_frame(spark, ("b", 0, 50)), store, base=base)
    with pytest.raises(RuntimeError):
        versions.overwrite_state(state_frame(spark, ("c", 0, 50)), store, base=base)
    assert expiries(versions.read_version(spark, store)) == {"b": 50}


@pytest.mark.parametrize("step", ["commit", "_names"])
def test_a_rerun_makes_the_same_delta(spark, path, monkeypatch, step):
    """A run that dies before its marker changes neither master nor delta."""
    old, new = (spark.createDataFrame(r, "account_sid string, n int")
                for r in ([("a", 1)], [("a", 1), ("b", 2)]))
    paths = [path(n) for n in ("store", "snapshots")]
    publish.merge_and_publish(old, old, *paths, "account_sid", reset=True, run_at=at(1))
    if step == "commit":
        monkeypatch.setattr(versions, "commit", lambda *a: 1 / 0)
    else:
        new.write.parquet(f"{paths[0]}/data-half")  # died while it wrote
    if step == "commit":
        with pytest.raises(ZeroDivisionError):
            publish.merge_and_publish(new, new, *paths, "account_sid", run_at=at(2))
        monkeypatch.undo()
    for name in ("master", "delta"):
        assert versions.read_version(spark, paths[0], name=name).count() == 1
    assert versions.sweep(spark, paths[0]) == []  # too young, a writer may still be at it
    assert len(versions.sweep(spark, paths[0], -1)) == (2 if step == "commit" else 1)
    assert versions.sweep(spark, paths[0], -1) == []
    master, delta = publish.merge_and_publish(new, new, *paths, "account_sid", run_at=at(3))
    assert [r.account_sid for r in delta.collect()] == ["b"]
    assert master.count() == 2


def test_old_versions_are_dropped_on_request(spark, path):
    store = path("state")
    for hours in (10, 20, 30):
        versions.overwrite_state(state_frame(spark, ("a", 0, hours)), store)
    assert versions.drop_old_versions(spark, store, keep=2) == [1]
    assert versions.committed_versions(spark, store) == [2, 3]
    assert versions.read_version(spark, store, at_most=1) is None
    assert expiries(versions.read_version(spark, store)) == {"a": 30}
    with pytest.raises(ValueError):
        versions.drop_old_versions(spark, store, keep=0)


def test_optional_source(spark, path):
    empty = tables.read_if_exists(spark, path("absent"), S.SKIPLIST)
    assert empty.count() == 0 and empty.columns == ["prefix"]
    with open(path("broken"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        tables.read_if_exists(spark, path("broken"), S.SKIPLIST).collect()
    with pytest.raises(AnalysisException):
        spark.read.parquet(path("absent"))


def test_append_with_other_columns(spark, path):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([(True, 2)], "f boolean, n int")
    sinks.append_rows(a, path("t"), update=False)
    sinks.append_rows(b, path("t"))
    assert rows(sinks.read_appended(spark, path("t")), "n", "t", "f") == [
        (1, "x", None), (2, None, True)]
    sinks.append_rows(a, path("t"), update=False)
    assert sinks.read_appended(spark, path("t")).count() == 1


def test_bound_parameters(spark):
    state_frame(spark, ("it's", 0, 1), ("b", 0, 1)).createOrReplaceTempView("bound")
    got = tables.run_query(spark, "select account_sid from bound where account_sid = :a",
                           {"a": "it's"})
    assert rows(got) == [("it's",)]


def test_scan_projected(spark, path):
    state_frame(spark, ("a", 0, 1)).write.parquet(path("s"))
    like = keys_frame(spark).select("mcc", "account_sid")
    got = tables.read_like(spark, path("s"), like)
    assert rows(got) == [("001", "a")]
    assert "expiry_time" not in got._jdf.queryExecution().executedPlan().toString()
