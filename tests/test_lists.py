import hashlib
import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tollwatch.functions import columns as C
from tollwatch.operators import filters, items, lists, state

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def ttl_frame(spark, *data):
    return spark.createDataFrame(
        [(k, "001", "01", at(r), at(e)) for k, r, e in data],
        "key string, mcc string, mnc string, record_time timestamp, expiry_time timestamp")


def test_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "account_sid string, n int")
    names = spark.createDataFrame([("a", "A"), ("c", "C")], "account_sid string, friendly_name string")
    got = lists.join_friendly_name(df, names)
    assert rows(got, "n", "friendly_name") == [(1, "A"), (2, "A"), (3, None), (4, None)]


def test_name_listed_twice_is_an_error(spark):
    df = spark.createDataFrame([("a", 1)], "account_sid string, n int")
    names = spark.createDataFrame([("a", "A"), ("a", "B")],
                                  "account_sid string, friendly_name string")
    with pytest.raises(Exception, match="more than one name for account a"):
        lists.join_friendly_name(df, names).collect()


@pytest.mark.parametrize("prefixes, left", [
    (["1x"], [2, 3]), (["1x", None], [2]), ([None], [1, 2]), ([], [1, 2, 3]), (["1x", "1x"], [2, 3])])
def test_skiplist_nulls(spark, prefixes, left):
    df = spark.createDataFrame([(1, "1x"), (2, "2x"), (3, None)], "n int, phone_prefix string")
    skip = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    assert rows(lists.skiplist_anti(df, skip), "n") == [(n,) for n in left]
    assert lists.skiplist_anti(df, None) is df


def test_prefix_merge_joins_mncs_and_takes_latest_times(spark):
    df = spark.createDataFrame(
        [("p", "001", "03", at(1), at(9)), ("p", "001", "01", at(2), at(5)),
         ("p", "001", "01", at(0), at(99)), ("p", "001", " ", at(0), at(1)),
         ("p", "002", "07", at(1), at(2))],
        "phone_prefix string, mcc string, mnc string, record_time timestamp, expiry_time timestamp")
    assert rows(lists.prefix_merge(df, "phone_prefix")) == [
        ("p", "001", "01,03", at(2), at(5)), ("p", "002", "07", at(1), at(2))]
    assert rows(lists.prefix_keys(df), "key", "mcc", "mnc") == [("p", "001", "01,03")]
    first = state.dedupe_prefix(df, "phone_prefix")
    assert rows(first.where("mnc = '01'"), "record_time") == [(at(0),)]


def test_account_keys(spark):
    df = spark.createDataFrame(
        [("a", "1x", "2x", "Yes", at(3), at(4)), ("a", "1x", "3x", "No", at(3), at(4)),
         ("a", None, "4x", "Yes", None, at(4)), ("b", "1x", "5x", "Yes", at(3), None)],
        "account_sid string, phone_prefix string, higher_prefix string,"
        " higher_prefix_block_flag string, higher_prefix_record_time timestamp,"
        " higher_prefix_expiry_time timestamp").selectExpr(
            "*", "'001' as mcc", "'01' as mnc", "timestamp '2024-01-01' as record_time",
            "timestamp '2024-01-01 02:00:00' as expiry_time")
    got = {r.key: r.expiry_time for r in lists.account_prefix_keys(df).collect()}
    assert got == {"a_1x": at(2), "b_1x": at(2), "a_2x": at(4)}


def test_ttl_values(spark):
    got = lists.with_value(ttl_frame(spark, ("k", 1, 3))).first()
    assert got.ttl_seconds == 7200
    assert json.loads(got.value) == {
        "mcc": "001", "mnc": "01", "expiry_time": "2024-01-01 03:00:00"}


def test_upsert_keys_last_write_wins(spark):
    old = ttl_frame(spark, ("k", 5, 90), ("old", 0, 50), ("dead", 0, 1))
    new = ttl_frame(spark, ("k", 1, 30), ("k", 0, 80), ("n", 0, 20), ("soon", 0, 10))
    got = {r.key: r.expiry_time for r in lists.upsert_ttl_keys(old, new, at(10)).collect()}
    assert got == {"k": at(30), "old": at(50), "n": at(20)}
    assert lists.upsert_ttl_keys(None, new, at(10)).count() == 2


def test_insert_if_absent(spark):
    held = ttl_frame(spark, ("k", 0, 50), ("dead", 0, 10))
    batch = ttl_frame(spark, ("k", 9, 99), ("dead", 9, 60), ("n", 8, 70), ("n", 9, 65))
    got = lists.insert_if_absent_ttl(held, batch, at(10))
    assert rows(got, "key", "expiry_time", "inserted") == [
        ("dead", at(60), True), ("k", at(50), False), ("n", at(65), True)]
    assert lists.any_inserted(got)
    assert not lists.any_inserted(lists.insert_if_absent_ttl(held, batch.where("key = 'k'"), at(10)))


def test_allow_list(spark):
    df = spark.createDataFrame(
        [("49123", at(1), at(2)), ("49123", at(3), at(9)), (None, at(1), at(2))],
        "phone_number string, record_time timestamp, expiry_time timestamp").selectExpr(
            "*", "'001' as mcc", "'01' as mnc")
    digest = hashlib.sha256(b"+49123").hexdigest()
    assert rows(lists.allow_list_build(df, True), "key", "expiry_time") == [
        ("allow_" + digest, at(9))]
    assert rows(lists.allow_list_build(df), "key") == [("allow_49123",)]
    held = spark.createDataFrame([("allow_" + digest,), ("49999",)], "key string")
    asked = spark.createDataFrame([("49123",), ("49999",), (None,)], "phone_number string")
    got = lists.check_allow_list(asked, held, True)
    assert got.columns == ["phone_number"]
    assert rows(got) == [("49999",), (None,)]
    assert lists.check_allow_list(asked, held).count() == 3


def test_block_list(spark):
    keys = spark.createDataFrame(
        [("1x", "01,02"), ("2x", "01"), ("3", "01"), ("5x", None)], "key string, mnc string")
    df = spark.createDataFrame(
        [(1, "1x", "9x", "02", "bad"), (2, "1x", "9x", "03", "bad"), (3, "9x", "2x", "01", "bad"),
         (4, "1x", "2x", "01", "good"), (5, "3", "9x", "01", "bad"), (6, None, None, "01", "bad"),
         (7, "1x", "9x", "01", None), (8, "5x", "5x", None, "bad"), (9, "1x", "1x", None, "bad")],
        "n int, phone_prefix string, higher_prefix string, mnc string, mode string")
    for prefilter in (False, True):
        assert rows(lists.check_block_list(df, keys, prefilter), "n") == [
            (2,), (4,), (5,), (6,), (8,), (9,)]


def test_delete_keys(spark):
    held = ttl_frame(spark, ("a", 0, 1), ("b", 0, 1))
    named = spark.createDataFrame([("a",), (None,), ("zz",)], "prefix string")
    assert rows(lists.delete_keys(held, named, "prefix"), "key") == [("b",)]


def test_items(spark):
    df = spark.sql(
        "select 'k' as id, 'c' as account_category, 'l' as ccr_label, 'C1' as country_code,"
        " '001' as mcc, '01' as mnc, true as observe, false as optout, 60 as block_ttl_mins,"
        " 1440 as lookback_mins, 7 as default_threshold, 2.9D as ucl, -2.9D as threshold")
    item = json.loads(items.threshold_items(df).first().item)["PutRequest"]["Item"]
    values = [t["M"]["model_value"]["N"] for t in item["thresholds"]["L"]]
    assert values == ["2", "-2"] and item["observe"] == {"BOOL": True}
    assert item["mcc"] == {"S": "001"} and item["lookback_mins"] == {"N": "1440"}
    account = json.loads(items.account_items(df).first().item)["PutRequest"]["Item"]
    assert account["default_threshold"] == {"N": "7"} and account["optout"] == {"BOOL": False}


def test_keys_and_hashes(spark):
    df = spark.sql("select 'a' as a, 1 as n, cast(null as string) as gone")
    got = df.select(C.joined_key("a", "n").alias("key"), C.joined_key("a", "gone").alias("null"),
                    C.hashed("a").alias("sha"), C.hashed("a", "md5_hex").alias("md5"),
                    C.hashed("a", "crc").alias("none"), C.title_label(F.lit("a_b c")).alias("t"))
    row = got.first()
    assert row["key"] == "a_1" and row["null"] is None and row["none"] is None
    assert row.sha == hashlib.sha256(b"a").hexdigest() and row.md5 == hashlib.md5(b"a").hexdigest()
    assert row.t == "A B C"


def skewed_plan(spark, join, column):
    """Final plan of a join whose left side has one key on most rows."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 400_000, 1, 8).selectExpr(
            f"case when id % 3 > 0 then 'hot' else cast(id as string) end as {column}",
            "sha2(cast(id as string), 256) as payload", "'bad' as mode", "'01' as mnc",
            "cast(id as string) as higher_prefix")
        right = spark.range(0, 400_000, 7).selectExpr("cast(id as string) as k")
        joined = join(left, right)
        n = joined.agg(F.count("payload"), F.max("payload"))
        n.collect()
        return n._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("join, column", [
    (lambda a, b: lists.skiplist_anti(a, b.withColumnRenamed("k", "prefix")), "phone_prefix"),
    (lambda a, b: lists.join_friendly_name(
        a, b.selectExpr("k as account_sid", "k as friendly_name")), "account_sid"),
    (lambda a, b: lists.check_allow_list(
        a, b.selectExpr("concat('allow_', k) as key")), "phone_number"),
    (lambda a, b: lists.check_block_list(
        a, b.selectExpr("concat(k, 'x') as key", "'01,02' as mnc")), "phone_prefix"),
    (lambda a, b: state.cleared(a, b.withColumnRenamed("k", "account_sid"), ["account_sid"]),
     "account_sid"),
    (lambda a, b: filters.exclusion_override(
        a.withColumn("block", F.lit("Yes")).withColumn("account_sid", F.lit("AC1")),
        {"do_not_include": b.selectExpr("'mcc' as level", "k as key")}), "mcc"),
])
def test_hot_keys_are_split_in_joins(spark, join, column):
    assert "skew=true" in skewed_plan(spark, join, column)


def test_the_filter_lets_few_rows_through(spark):
    listed = spark.range(200).selectExpr("concat(id, 'x') as p", "'01' as m")
    rows_ = spark.range(20_000).selectExpr("concat(id, 'x') as p", "'01' as m")
    bits = lists.bit_filter(listed, "p", "m")
    passed = rows_.where(lists.may_hold(bits, "p", "m"))
    assert passed.join(listed, ["p", "m"]).count() == 200 and passed.count() < 260


def test_block_list_shuffles_only_rows_that_may_be_listed(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr(
        "concat(id, 'x') as phone_prefix", "concat(id % 97, 'x') as higher_prefix",
        "case when id % 2 = 0 then '01' end as mnc", "case when id % 5 = 0 then 'good' end as mode")
    keys = spark.range(50).selectExpr("concat(id + 1000, 'x') as key", "'01,02' as mnc")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = lists.check_block_list(df, keys, True)
        assert got.count() == 30_000 - 20  # even ids of 1000 to 1049 that are not in mode good
        plan = got._jdf.queryExecution().executedPlan()
        assert plan.toString().count("LeftAnti") >= 2
    finally:
        for k in settings:
            spark.conf.unset(k)
