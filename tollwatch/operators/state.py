"""Deduplication, delta and merge of keyed tables.

Sides are tagged, put together and reduced by key: one shuffle with map-side
combining where a join plus a window would need two or three and would send all
copies of a key to one task. Grouping also treats null keys as equal.
"""

from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.functions.columns import nulls_last
from tollwatch.operators.filters import not_expired


def union_by_name(left, right):
    """All rows of both, columns matched by name, missing ones null."""
    return left.unionByName(right, allowMissingColumns=True)


def dedupe_key(df, key, order=()):
    """One row per key: the first by ``order``, then by all other columns.

    Without ``order`` this is the lowest row of the key, nulls last.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = F.min(F.struct(*order, *[nulls_last(c).alias(f"_{c}") for c in rest]))
    reduced = df.groupBy(*key).agg(first.alias("_row"))
    return reduced.select(*[
        F.col(c) if c in key else F.col(f"_row._{c}.value").alias(c) for c in df.columns])


def dedupe_latest_expiry(df, key=S.STATE_KEY):
    """Latest expiry per key, then latest record."""
    rest = [c for c in df.columns if c not in (*key, "expiry_time", "record_time")]
    best = F.max(F.struct("expiry_time", "record_time", *rest)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*").select(*df.columns)


def dedupe_prefix(df, key):
    """Earliest record per (key, mcc, mnc)."""
    return dedupe_key(df, [key, "mcc", "mnc"], [nulls_last("record_time")])


def rows_not_in(df, master):
    """Distinct rows of ``df`` that ``master`` lacks, nulls being equal."""
    columns = df.columns
    tagged = df.select(*columns, F.lit(False).alias("_known")).union(
        master.select(*columns, F.lit(True).alias("_known")))
    known = tagged.groupBy(*columns).agg(F.max("_known").alias("_known"))
    return known.where(~F.col("_known")).select(*columns)


def delta_rows(df, master, key):
    """New or changed rows against the master, one per key; all rows without a master."""
    if master is None:
        return dedupe_key(df, [key])
    return dedupe_key(rows_not_in(df, master), [key])


def master_merge(df, master, key, prefer="lowest"):
    """Master and new rows, one per key.

    ``lowest`` keeps the lowest row by column order, so a changed row may lose
    to the one it replaces; ``new`` keeps the row of ``df``.
    """
    if master is None:
        return dedupe_key(df, [key])
    columns = df.columns
    if prefer == "lowest":
        return dedupe_key(df.union(master.select(*columns)), [key])
    if prefer != "new":
        raise ValueError(f"prefer must be 'lowest' or 'new', not {prefer!r}")
    tagged = df.withColumn("_old", F.lit(False)).union(
        master.select(*columns).withColumn("_old", F.lit(True)))
    return dedupe_key(tagged, [key], [F.col("_old")]).drop("_old")


def cleared(state, keys, key=S.STATE_KEY):
    """State without the rows whose key is listed; null keys match each other."""
    listed = keys.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    match = None
    for k in key:
        same = state[k].eqNullSafe(listed[f"_k_{k}"])
        match = same if match is None else match & same
    return state.join(listed, match, "left_anti")


def state_upsert(state, new, not_breached, as_of=None, key=S.STATE_KEY):
    """Old state less cleared keys, plus new rows: latest expiry per key, unexpired.

    Without a state the new rows are returned as they are.
    """
    if state is None:
        return new
    rest = [c for c in new.columns if c not in key]
    row = F.struct("expiry_time", "record_time",
                   *[c for c in rest if c not in ("expiry_time", "record_time")])
    old_rows = state.select(*key, row.alias("_old"), F.lit(None).alias("_new"),
                            F.lit(False).alias("_clear"))
    new_rows = new.select(*key, F.lit(None).alias("_old"), row.alias("_new"),
                          F.lit(False).alias("_clear"))
    clear = not_breached.select(*key, F.lit(None).alias("_old"), F.lit(None).alias("_new"),
                                F.lit(True).alias("_clear"))
    reduced = old_rows.union(new_rows).union(clear).groupBy(*key).agg(
        F.max("_old").alias("_old"), F.max("_new").alias("_new"),
        F.max("_clear").alias("_clear"))
    kept_old = F.when(~F.col("_clear"), F.col("_old"))
    best = reduced.select(*key, F.greatest(kept_old, F.col("_new")).alias("_row"))
    alive = best.where(F.col("_row").isNotNull()).select(*key, "_row.*")
    return alive.where(not_expired(as_of)).select(*new.columns)


def sort_by_expiry(state):
    return state.orderBy(F.desc("expiry_time"), *S.STATE_KEY)
