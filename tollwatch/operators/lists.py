"""Name lookup, skip, block and allow lists, and keys with a time to live."""

from pyspark.sql import functions as F

from tollwatch.functions.columns import (
    EXPIRY_FORMAT, allow_key, as_timestamp, joined_key, not_blank, ttl_seconds,
)


def join_friendly_name(df, names):
    """Add the account's name, null where it has none.

    A name table that lists an account twice is an error, raised when the job
    runs. The lookup is not broadcast by hand: it grows with the accounts, so
    its measured size decides.
    """
    twice = F.raise_error(F.concat(F.lit("more than one name for account "),
                                   F.col("account_sid")))
    lookup = names.groupBy("account_sid").agg(
        F.count(F.lit(1)).alias("_n"), F.max("friendly_name").alias("_name"),
    ).select(F.col("account_sid").alias("_account"),
             F.when(F.col("_n") > 1, twice).otherwise(F.col("_name")).alias("friendly_name"))
    rows = df.drop("friendly_name")
    return rows.join(lookup, splittable("account_sid", "_account"), "left").drop("_account")


def splittable(left, right):
    """Join condition that leaves hot keys of the left side to adaptive skew splitting.

    Splitting needs a shuffle directly under each side of the join. A plain
    equality would reuse the partitioning of a right side that was just grouped
    by the key; the null-safe form does not.
    """
    return F.col(left).eqNullSafe(F.col(right))


def skiplist_anti(df, skiplist):
    """Drop rows whose prefix is listed; a listed null drops null prefixes."""
    if skiplist is None:
        return df
    listed = skiplist.select(F.col("prefix").alias("_prefix")).distinct()
    return df.join(listed, splittable("phone_prefix", "_prefix"), "left_anti")


def prefix_merge(df, key, record="record_time", expiry="expiry_time"):
    """Per (key, mcc): the mncs as one sorted text, and the times of the latest record.

    Copies are reduced by (key, mcc, mnc) first; a country has at most a
    thousand mncs, which bounds the set.
    """
    latest = F.max(F.struct(F.col(record).alias("record_time"),
                            F.col(expiry).alias("expiry_time"))).alias("_times")
    single = df.groupBy(F.col(key).alias("key"), "mcc", "mnc").agg(latest)
    mncs = F.array_sort(F.collect_set(F.when(not_blank("mnc"), F.col("mnc"))))
    return single.groupBy("key", "mcc").agg(
        F.array_join(mncs, ",").alias("mnc"), F.max("_times").alias("_times"),
    ).select("key", "mcc", "mnc", "_times.*")


def last_write(df):
    """One row per key: the latest record wins."""
    last = F.max(F.struct("record_time", "mcc", "mnc", "expiry_time")).alias("_row")
    return df.groupBy("key").agg(last).select(
        "key", "_row.mcc", "_row.mnc", "_row.record_time", "_row.expiry_time")


def prefix_keys(df, key="phone_prefix", record="record_time", expiry="expiry_time"):
    """Keys to set for blocked prefixes, with the times of the columns named.

    Rows without a key or without its times set nothing.
    """
    return last_write(prefix_merge(df.dropna(subset=[key, record, expiry]), key, record, expiry))


def account_prefix_keys(df):
    """Keys ``account_prefix``, and ``account_higher prefix`` for rows flagged so.

    The second set carries its own times; rows without them set nothing.
    """
    own = df.withColumn("prefix_key", joined_key("account_sid", "phone_prefix"))
    own = own.where(F.col("prefix_key").isNotNull())
    higher = df.where(F.col("higher_prefix_block_flag") == "Yes").select(
        joined_key("account_sid", "higher_prefix").alias("key"), "mcc", "mnc",
        F.col("higher_prefix_record_time").alias("record_time"),
        F.col("higher_prefix_expiry_time").alias("expiry_time"),
    ).dropna(subset=["key", "record_time", "expiry_time"])
    return last_write(prefix_merge(own, "prefix_key").unionByName(higher))


def allow_list_build(df, hash_keys=False):
    """Allow-list keys of phone numbers, hashed or plain; null numbers set nothing."""
    keyed = df.withColumn("key", allow_key("phone_number", hash_keys))
    return last_write(keyed.where(F.col("key").isNotNull()))


def with_value(keys):
    """Add what a key-value store takes: seconds to live and the value as JSON."""
    expiry = F.date_format("expiry_time", EXPIRY_FORMAT)
    value = F.to_json(F.struct("mcc", "mnc", expiry.alias("expiry_time")))
    return keys.withColumn("ttl_seconds", ttl_seconds("expiry_time", "record_time")) \
        .withColumn("value", value)


def upsert_ttl_keys(state, new, as_of=None):
    """Write keys over a state: a new write replaces the old one; expired keys go."""
    columns = ["mcc", "mnc", "record_time", "expiry_time"]
    fresh = new.select("key", F.struct(F.lit(1).alias("_batch"), *columns).alias("_row"))
    rows = fresh
    if state is not None:
        rows = fresh.union(state.select(
            "key", F.struct(F.lit(0).alias("_batch"), *columns).alias("_row")))
    last = rows.groupBy("key").agg(F.max("_row").alias("_row"))
    return last.select("key", *[f"_row.{c}" for c in columns]).where(
        F.col("expiry_time") > as_timestamp(as_of))


def insert_if_absent_ttl(state, batch, as_of=None):
    """Insert keys without an unexpired entry; ``inserted`` tells which rows are new.

    Of several batch rows of one key the latest record is written.
    """
    now = as_timestamp(as_of)
    entry = F.struct("record_time", "expiry_time")
    held = state.where(F.col("expiry_time") > now).select(
        "key", entry.alias("_held"), F.lit(None).alias("_new"))
    asked = batch.select("key", F.lit(None).alias("_held"), entry.alias("_new"))
    reduced = held.union(asked).groupBy("key").agg(
        F.max("_held").alias("_held"), F.max("_new").alias("_new"))
    return reduced.select(
        "key", F.coalesce("_held", "_new").alias("_row"),
        F.col("_held").isNull().alias("inserted"),
    ).select("key", "_row.*", "inserted")


def any_inserted(upserted):
    return not upserted.where("inserted").isEmpty()


#: Bits of the filter before a list's join; a longer list lets more rows through.
FILTER_BITS = 1 << 20


def _bit(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def bit_filter(listed, *columns):
    """One value, an array of ``FILTER_BITS`` bits with those set that the list's entries hash to."""
    words = listed.select(_bit(*columns).alias("b")).select(
        F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"),
    ).groupBy("w").agg(F.bit_or("v").alias("v"))
    every = listed.sparkSession.range(FILTER_BITS // 64).select(
        F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    dense = words.union(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    one = dense.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("all"))
    return one.select(F.col("all.v")).scalar()


def may_hold(bits, *columns):
    """Whether the list behind the bits may have an entry of these values."""
    b = _bit(*columns)
    word = F.get(bits, F.shiftright(b, 6).cast("int"))
    return F.getbit(word, b.bitwiseAND(F.lit(63)).cast("int")) == 1


def check_block_list(df, keys, prefilter=False):
    """Drop candidates whose prefix or higher prefix is blocked for their mnc.

    Stored prefixes end in ``x``; other keys are not looked at. Rows in mode
    ``good`` always stay. With ``prefilter`` a filter of fixed size, made from
    the list, first keeps the rows that it cannot have, and only the others are
    shuffled to be looked up: for lists that hit few of many candidates.
    """
    stored = keys.where(F.col("key").endswith("x")).select(
        F.col("key").alias("_prefix"),
        F.explode(F.split("mnc", ",")).alias("_mnc")).distinct()
    # No stored prefix or mnc is null, so a null never matches.
    droppable = ~F.col("mode").eqNullSafe(F.lit("good"))
    prefixes = ("phone_prefix", "higher_prefix")
    left = df
    if prefilter:
        bits = bit_filter(stored, "_prefix", "_mnc")
        asked = droppable & (
            may_hold(bits, prefixes[0], "mnc") | may_hold(bits, prefixes[1], "mnc"))
        left = df.where(asked)
    for prefix in prefixes:
        hit = splittable(prefix, "_prefix") & splittable("mnc", "_mnc")
        left = left.join(stored, hit & droppable, "left_anti")
    return df.where(~asked).union(left) if prefilter else left


def check_allow_list(df, keys, hash_keys=False):
    """Drop candidates whose number is on the allow list."""
    listed = keys.where(F.col("key").startswith("allow")).select(
        F.col("key").alias("_key")).distinct()
    number = allow_key("phone_number", hash_keys)
    keyed = df.withColumn("_number", number)
    return keyed.join(listed, splittable("_number", "_key"), "left_anti").drop("_number")


def delete_keys(state, df, column):
    """State without the keys named by a column of ``df``."""
    named = df.select(F.col(column).alias("_key")).distinct()
    return state.join(named, F.col("key") == F.col("_key"), "left_anti")
