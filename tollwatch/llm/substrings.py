"""Substring dedup: remove words of long windows that occur more than once.

A difference cover modulo a period holds, for any two positions, a shift below
the period that moves both into the cover. So if two places match over a whole
window, some anchor, a shorter run of words inside the window, starts at a cover
position in both. Only anchors at cover positions are counted. Windows around
an anchor that occurs twice are the candidates to which a match may extend, and
only their hashes are counted and looked up.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm.words import Texts, chunks, covered

#: Period and residues of a perfect difference set: every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bits of the broadcast filter, and the share of set bits up to which it is used.
FILTER_BITS, FILTER_FILL = 1 << 26, 0.5


def is_difference_cover(period, cover):
    return {(a - b) % period for a, b in itertools.product(cover, cover)} == set(range(period))


def _anchors(texts, hashes, size):
    """Cover positions of the texts at which an anchor begins, and the anchors' hashes."""
    length = size - PERIOD + 1
    place = texts.window_starts(length)
    within = place - texts.first[:-1][texts.doc[place]]
    place = place[np.isin(within % PERIOD, COVER)]
    return place, texts.window_hashes(hashes, place, length)


def _candidates(texts, anchors, size):
    """Starts of the windows that contain one of ``anchors``."""
    steps = np.zeros(len(texts.start) + 1, np.int64)
    low = np.maximum(anchors - PERIOD + 1, texts.first[:-1][texts.doc[anchors]])
    np.add.at(steps, low, 1)
    np.add.at(steps, anchors + 1, -1)
    starts = texts.window_starts(size)
    return starts[np.cumsum(steps[:-1])[starts] > 0] if len(starts) else starts


def _signed(hashes):
    return pa.array(hashes.view(np.int64))


def _anchor_rows(size, keyed):
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Texts(data, at)
            place, h = _anchors(texts, texts.words(), size)
            if keyed:
                doc = texts.doc[place]
                yield pa.RecordBatch.from_pydict({
                    "h": _signed(h), "key": batch.column(0).take(pa.array(doc)),
                    "at": pa.array((place - texts.first[doc]).astype(np.int32))})
            else:
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": _signed(h), "n": pa.array(n)})
    return run


def _bits(h):
    """The two bits of the filter that stand for a hash."""
    return h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def _filter(repeated):
    """Bitmap of the repeated anchors as 64-bit words, or None where too many bits are set.

    However many anchors there are, at most FILTER_BITS / 64 words come to the driver.
    """
    mask = F.lit(FILTER_BITS - 1).cast("long")
    two = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    words = repeated.select(F.explode(two).alias("b")).select(
        F.shiftright("b", 6).cast("int").alias("w"),
        F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"),
    ).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    used = sum(int(np.bitwise_count(part).sum()) for part in np.array_split(bitmap, 64))
    return bitmap if used <= FILTER_FILL * FILTER_BITS else None


def _passes(bitmap, h):
    out = np.ones(len(h), bool)
    for b in _bits(h):
        out &= (bitmap[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) > 0
    return out


def _window_rows(size, bitmap, keyed):
    """Candidate windows of (key, text, copies[, anchors]) rows.

    ``keyed`` rows carry where the window stands; a text that has copies is not
    among them, since all its windows repeat.
    """
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Texts(data, at)
            hashes = texts.words()
            if bitmap is not None:
                place, h = _anchors(texts, hashes, size)
                place = place[_passes(bitmap.value, h)]
            else:
                own = batch.column(3)
                n = np.diff(own.offsets.to_numpy())
                place = own.flatten().to_numpy() + np.repeat(texts.first[:-1], n)
            starts = _candidates(texts, place, size)
            copies = batch.column(2).to_numpy()
            if keyed:
                starts = starts[copies[texts.doc[starts]] == 1]
            doc = texts.doc[starts]
            h = texts.window_hashes(hashes, starts, size)
            if keyed:
                yield pa.RecordBatch.from_pydict({
                    "h": _signed(h), "key": batch.column(0).take(pa.array(doc)),
                    "at": pa.array((starts - texts.first[doc]).astype(np.int32))})
            else:
                order = np.argsort(h)
                h, n = h[order], copies[doc][order]
                first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
                yield pa.RecordBatch.from_pydict({
                    "h": _signed(h[first]),
                    "n": pa.array(np.add.reduceat(n, first) if len(first) else n)})
    return run


def _removal(size):
    """What is left of (key, text, copies, starts) rows."""
    import hashlib

    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Texts(data, at)
            starts, copies = batch.column(3), batch.column(2).to_numpy()
            n = np.diff(starts.offsets.to_numpy())
            place = starts.flatten().to_numpy().astype(np.int64) + np.repeat(texts.first[:-1], n)
            gone = covered(len(texts.start), place, size)
            gone |= ((copies > 1) & (texts.counts >= size))[texts.doc]
            blob = data.tobytes()
            low, high, first = texts.start.tolist(), texts.end.tolist(), texts.first.tolist()
            left = np.flatnonzero(~gone)
            cut = np.searchsorted(left, first).tolist()
            left = left.tolist()
            text = [b" ".join([blob[low[w]:high[w]] for w in left[a:b]])
                    for a, b in itertools.pairwise(cut)]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "n_words": pa.array(texts.counts),
                "n_removed": pa.array(texts.word_sums(gone)),
                "kept_text": pa.array([t.decode() for t in text], pa.string()),
                "kept_sha256": [hashlib.sha256(t).hexdigest() for t in text]})
    return run


def _among(rows, hashes):
    """Rows whose hash is listed. A hash that many rows have is split by adaptive execution:

    the null-safe form asks for a shuffle right below each side, which a plain
    equality would take over from the grouping of the hashes.
    """
    listed = hashes.select(F.col("h").alias("listed"))
    return rows.join(listed, F.col("h").eqNullSafe(F.col("listed")), "left_semi")


def dedup_substrings(docs, size=35, doc_id="doc_id", text="text", keep_text=True, use_filter=True):
    """Words left in each row's text after removing those in repeated windows of ``size`` words.

    Returns doc_id, n_words, n_removed, kept_sha256 and, unless switched off,
    kept_text, one row per input row. Windows are judged on the input: a window
    goes wherever it stands, the first time included, and may repeat within its
    own text. Texts of fewer words than ``size`` keep all of them; null and
    empty texts have none. Rows that share an id or are repeated whole are
    copies of each other like any others. Other columns are not looked at.

    Equal texts are counted as one with their number of copies, so a group of
    copies of any size is one row. Positions are gathered by text only, at most
    as many as it has words. The filter only spares work: without it, or if it
    were too full, the anchors are joined instead. Windows are compared by 64-bit
    hashes among candidates that also share an anchor's 64-bit hash.
    """
    if size <= PERIOD:
        raise ValueError(f"windows must be longer than {PERIOD} words")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.md5("text"))
    repeated = source.select("id", "text").mapInArrow(
        _anchor_rows(size, False), "h long, n long",
    ).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    distinct = source.groupBy(digest.alias("key")).agg(
        F.min("text").alias("text"), F.count("*").alias("copies"))
    bitmap = _filter(repeated) if use_filter else None
    if bitmap is not None:
        shared = spark.sparkContext.broadcast(bitmap)
        tagged = distinct.select("key", "text", "copies")
    else:
        shared = None
        hits = distinct.select("key", "text").mapInArrow(
            _anchor_rows(size, True), "h long, key binary, at int",
        )
        hits = _among(hits, repeated).groupBy("key").agg(F.collect_list("at").alias("anchors"))
        tagged = distinct.join(hits, "key").select("key", "text", "copies", "anchors")
    again = tagged.mapInArrow(_window_rows(size, shared, False), "h long, n long").groupBy(
        "h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    starts = tagged.mapInArrow(_window_rows(size, shared, True), "h long, key binary, at int")
    starts = _among(starts, again).groupBy("key").agg(F.collect_list("at").alias("starts"))
    nothing = F.array().cast("array<int>")
    columns = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]
    left = distinct.join(starts, "key", "left").select(
        "key", "text", "copies", F.coalesce("starts", nothing).alias("starts"),
    ).mapInArrow(_removal(size), "key binary, n_words long, n_removed long, kept_text string,"
                                 " kept_sha256 string").select("key", *columns)
    return source.select(F.col("id"), digest.alias("key")).join(left, "key").select(
        F.col("id").alias(doc_id), *columns)
