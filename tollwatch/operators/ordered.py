"""Previous value and dense rank inside groups of any size.

A window puts each group into one task, which a group holding a third of the
table would not survive. So every group is cut into segments of its own order,
by the calendar, a window runs inside each segment, and a table with one row
for each group and segment carries the state over the cuts. Segments follow
from the rows alone, so the plan is one for tables of any size, nothing is
counted or written while it is built, and a task that runs again sees the same
segments. ``position_within`` cuts by ranges instead.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from tollwatch.session import written

RANGE = "_range"
SEGMENT = "_segment"


def _same(df, prefix, keys):
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(prefix + k)) for k in keys])


def _ranged(df, keys, order):
    """Rows cut into ranges of (keys, order), kept so that all readers see the same cuts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return written(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _with_carry(df, carry, keys, segment, broadcast=False):
    """Attach one row per (group, segment)."""
    on = [*keys, segment]
    carried = carry.select(*[F.col(k).alias("_c_" + k) for k in on],
                           *[c for c in carry.columns if c not in on])
    carried = F.broadcast(carried) if broadcast else carried
    joined = df.join(carried, _same(df, "_c_", on), "left")
    return joined.drop(*["_c_" + k for k in on])


def lag_within(df, keys, order, value, name, segment="month"):
    """Add ``name``: ``value`` of the row before, by ``order`` columns, ascending.

    The first of ``order`` is a timestamp or date, and ``segment`` a calendar
    unit that bounds the rows of a group and unit to what a task can sort.
    ``order`` must tell any two rows of a group apart, or they must be equal.
    """
    cut = df.withColumn(SEGMENT, F.date_trunc(segment, F.col(order[0])))
    window = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    inside = (cut.withColumn("_before", F.lag(value).over(window))
              .withColumn("_nth", F.row_number().over(window)))
    tails = cut.groupBy(*keys, SEGMENT).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    carry = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SEGMENT)))
    joined = _with_carry(inside, carry.drop("_tail"), keys, SEGMENT)
    previous = F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_before"))
    return joined.withColumn(name, previous).drop(SEGMENT, "_before", "_nth", "_carry")


def dense_rank_within(df, keys, column, name, segment="month"):
    """Add ``name``: dense rank by ``column``, greatest first, nulls last.

    ``column`` is a timestamp or date. A rank goes to a value, so distinct
    values are ranked and then joined to their rows: rows that are equal in
    ``column`` never meet in one window, whatever their number.
    """
    values = df.select(*keys, column).distinct().withColumn(
        SEGMENT, F.date_trunc(segment, F.col(column)))
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(F.desc_nulls_last(column))
    local = values.withColumn("_local", F.row_number().over(inside))
    later = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(SEGMENT)).rowsBetween(
        Window.unboundedPreceding, -1)
    counts = values.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_n"))
    carry = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    ranked = _with_carry(local, carry, keys, SEGMENT)
    ranks = ranked.select(*[F.col(c).alias("_v_" + c) for c in (*keys, column)],
                          (F.col("_local") + F.col("_offset")).cast("long").alias(name))
    return df.join(ranks, _same(df, "_v_", [*keys, column])).select(*df.columns, name)


def position_within(df, keys, order, name):
    """Add ``name``: how many rows of the group come before, by ``order`` columns, ascending.

    All rows are cut into ranges, so no task holds a group of any size. Only the
    first group of a range can go on from the one before, so the carry has fewer
    rows than there are ranges. Rows that are equal in ``order`` may be cut too.
    """
    order = [*order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    cut = _ranged(tied, keys, [F.col(c) for c in order])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, RANGE).agg(F.count("*").alias("_n")).withColumn(
        "_offset", F.sum("_n").over(before)).where("_offset > 0").drop("_n")
    inside = F.row_number().over(Window.partitionBy(RANGE, *keys).orderBy(*order)) - 1
    joined = _with_carry(cut.withColumn("_nth", inside), carry, keys, RANGE, True)
    place = F.coalesce("_offset", F.lit(0)) + F.col("_nth")
    return joined.withColumn(name, place.cast("long")).drop(RANGE, "_tie", "_nth", "_offset")
