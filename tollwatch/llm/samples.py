"""Bounded samples of labelled documents for fitting classifiers."""

import pyspark.sql.functions as F


def fold(doc_id):
    """crc32 of the id as text, modulo 4; -1 without an id. Rows of fold 2 are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def labelled(docs, labels, label, bound, doc_id="doc_id", text="text"):
    """At most ``bound`` documents (id, text, label) for fitting, none of fold 2.

    Ids are taken in the order of a hash, so the sample does not depend on
    partitions. An id labelled more than once gets its lowest label, an id
    that several rows bear its first text in text order; rows without a label
    or an id are not used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    ids = known.where(fold(F.col("id")) != 2).groupBy("id").agg(F.min("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most ``bound`` ids, so this side is small however large the corpus is
    return rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
