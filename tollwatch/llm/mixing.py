"""Mix sources to target weights by Poisson replication."""

import pyspark.sql.functions as F

#: A document's own mean is split into draws of at most this mean, so that exp(-mean) is far from 0.
MEAN_PER_DRAW = 16.0


def _group(source, names):
    """Place of a source in the targets; -1 for all others and for null."""
    place = F.lit(-1)
    for i, name in enumerate(names):
        place = F.when(source == name, i).otherwise(place)
    return F.coalesce(place, F.lit(-1))


def rates(docs, targets, other, source="source", text="text", size=1.0):
    """Mean repetitions for each target: weight * total mass * size / own mass.

    A document's mass is its characters plus one. One row per target plus one
    for all other sources, so its size is bounded by the parameter. ``cdf``
    holds the distribution function of one draw up to where it is 1.
    """
    names = list(targets)
    share = float(sum(targets.values()) + other)
    weights = [float(w) / share for w in (*targets.values(), other)]
    mass = docs.select(
        _group(F.col(source), names).alias("g"),
        (F.length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("m"),
    ).groupBy("g").agg(F.sum("m").alias("m"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.when(F.col("g") < 0, len(weights))
                          .otherwise(F.col("g") + 1))
    listed = mass.groupBy().agg(F.sum("m").alias("total"),
                                F.collect_list(F.struct("g", "m")).alias("all"))
    mean = listed.select("total", F.explode("all").alias("one")).select("total", "one.*").select(
        "g", (weight * F.col("total") * F.lit(float(size)) / F.col("m")).alias("mean"))
    draws = F.greatest(F.ceil(F.col("mean") / MEAN_PER_DRAW), F.lit(1)).cast("int")
    one = F.col("mean") / F.col("draws")
    last = F.ceil(one + 12 * F.sqrt(one) + 24).cast("int")
    first = F.exp(-one)
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * one / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * one / k)).alias("c")),
    )["c"]
    return mean.withColumn("draws", draws).withColumn("cdf", cdf)


def _uniform(*parts):
    """Number in [0, 1) from 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def mix_sources(docs, targets, other=0.0, size=1.0, seed="mix", source="source",
                text="text", doc_id="doc_id"):
    """Repeat each document a Poisson number of times, so that sources get ``targets``.

    ``targets`` gives weights for named sources and ``other`` for all the rest
    together, null included; they are shares after division by their sum, of
    characters. ``size`` is the expected output against the input. A document's
    count inverts the distribution at a hash of ``seed`` and its id (of its
    text, where the id is null), so it does not depend on partitions, and rows
    that share an id share the count. The result has the columns of ``docs``,
    ``copy`` from 1 and ``shuffle_key``, by which it is sorted: a global random
    order. Input columns with those two names are replaced. A null or empty
    text has mass 1. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rate = rates(docs, targets, other, source, text, size).select(
        F.struct("draws", "cdf").alias("rate"), F.col("g").alias("own"))
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    # the input's columns stay in one struct, so that none of their names can clash
    joined = docs.select(F.struct(*kept).alias("row"), key.alias("key"),
                         _group(F.col(source), list(targets)).alias("group"))
    joined = joined.join(F.broadcast(rate), F.col("group") == F.col("own"))

    def draw(j):
        u = _uniform(F.lit(seed), F.col("key"), j.cast("string"))
        return F.size(F.filter(F.col("rate.cdf"), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("rate.draws")), F.lit(0),
                        lambda n, j: n + draw(j))
    repeated = joined.withColumn("n", count).where("n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.lit("order"), F.col("key"),
                            F.col("copy").cast("string")))
    return repeated.select("row.*", "copy", key.alias("shuffle_key")).orderBy("shuffle_key")
