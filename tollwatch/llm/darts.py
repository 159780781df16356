"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A text is a weighted set: its shingles of five words, each with its number of
occurrences. Darts are thrown at the plane of weight and rank above every
shingle, by hashes of the shingle only, so all texts see the same darts. A text
keeps those that land below its weights, and of those the earliest in rank for
each coordinate. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity.
"""

import functools
import itertools

import numpy as np
import pyspark.sql.functions as F

from tollwatch.llm.groups import labels_of, linked, node_of, overlaps
from tollwatch.llm.words import Texts, mix

SHINGLE = 5
#: Rank below which the first darts fall; each following layer of darts is as deep as all before.
FIRST_RANK = 2.0 ** -6
#: Texts up to which pairs are compared one by one.
FEW = 8
#: Sets up to which an element is counted pair by pair; others are counted by products of columns.
RARE = 12
COLUMNS = 4096


def shingles(texts, size=SHINGLE):
    """Text, hash and number of occurrences of each distinct shingle.

    A text of fewer than ``size`` words has one shingle, all its words; a text
    without words has none.
    """
    hashes = texts.words()
    starts = texts.window_starts(size)
    h = texts.window_hashes(hashes, starts, size)
    doc = texts.doc[starts]
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < size))
    if len(short):
        low = texts.first[short]
        own = np.array([texts.window_hashes(hashes, low[i:i + 1], int(texts.counts[d]))[0]
                        for i, d in enumerate(short)], np.uint64)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h))).astype(float)


@functools.lru_cache(256)
def _poisson(mean):
    """Distribution function of the number of darts in a cell, up to where it is 1."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 30))
    logs = -mean + np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(k))])
    return np.cumsum(np.exp(logs))


def _unit(h):
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53


def _cell(h, layer, band, low, high, bottom, top):
    """Darts of one layer of rank and one band of weight above each shingle.

    Returns the place of the shingle, and rank, weight and hash of each dart.
    """
    seed = mix(h ^ mix(np.uint64(layer * 256 + band + 1)))
    number = np.searchsorted(_poisson((high - low) * (top - bottom)), _unit(seed), side="right")
    owner = np.repeat(np.arange(len(h)), number)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(seed[owner] + (index + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (owner, bottom + (top - bottom) * _unit(mix(dart + np.uint64(1))),
            low + (high - low) * _unit(mix(dart + np.uint64(2))), dart)


def signatures(n, doc, h, weight, k):
    """Hash of the earliest dart per coordinate, one row per text; zeros without shingles."""
    best = np.full(n * k, np.inf)
    out = np.zeros(n * k, np.uint64)
    open_docs = np.zeros(n, bool)
    open_docs[doc] = True
    layer = 0
    while len(doc):
        bottom = 0.0 if layer == 0 else FIRST_RANK * 2.0 ** (layer - 1)
        top = FIRST_RANK * 2.0 ** layer
        band, low, high = 0, 0.0, 1.0
        rows = np.arange(len(doc))
        while len(rows):
            owner, rank, at, dart = _cell(h[rows], layer, band, low, high, bottom, top)
            owner = rows[owner]
            hit = at < weight[owner]
            owner, rank, dart = owner[hit], rank[hit], dart[hit]
            place = doc[owner] * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, place, rank)
            won = best[place] == rank
            out[place[won]] = dart[won]
            band, low, high = band + 1, high, 2 * high
            rows = rows[weight[rows] > low]
        # a coordinate with a dart is settled, since later layers lie above
        open_docs &= np.isinf(best.reshape(n, k)).any(axis=1)
        still = open_docs[doc]
        doc, h, weight = doc[still], h[still], weight[still]
        layer += 1
    return out.reshape(n, k)


def band_keys(bands=40, rows=6):
    """Function that gives the keys of texts: one for each band of ``rows`` coordinates."""
    def keys(data, at):
        texts = Texts(data, at)
        doc, h, weight = shingles(texts)
        sig = signatures(len(texts), doc, h, weight, bands * rows)
        some = np.flatnonzero(texts.counts > 0)
        key = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(some), 0)
        for r in range(rows):
            key = mix(key + sig[some][:, r::rows])
        return np.repeat(some, bands), key.reshape(-1)
    return keys


def occurrences(data, at):
    """Sorted hashes of each text, one for each occurrence of a shingle, so that weights are sizes."""
    doc, h, weight = shingles(Texts(data, at))
    n = weight.astype(np.int64)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, h = np.repeat(doc, n), mix(np.repeat(h, n) + number.astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    return np.split(h, np.searchsorted(doc, np.arange(1, len(at) - 1)))


def _overlap_matrix(sets):
    """Elements in common of all pairs of the sets of a block."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    owner, first = owner[order], np.cumsum(count) - count
    common = np.zeros((n, n), np.float32)
    for size in range(2, RARE + 1):
        own = owner[first[count == size][:, None] + np.arange(size)]
        for i, j in itertools.combinations(range(size), 2):
            np.add.at(common, (own[:, i], own[:, j]), 1)
    often = np.flatnonzero(count > RARE)
    for low in range(0, len(often), COLUMNS):
        some = often[low:low + COLUMNS]
        member = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), count[some])
        row = np.repeat(first[some] - (np.cumsum(count[some]) - count[some]), count[some])
        member[owner[row + np.arange(len(row))], column] = 1
        common += np.triu(member @ member.T, 1)
    return np.maximum(common, common.T)


def compared(threshold=0.8):
    """Function that labels the sets of a block linked by a similarity of ``threshold``."""
    def compare(sets, left):
        n = len(sets)
        sizes = np.array([len(s) for s in sets])
        i, j = np.triu_indices(n, 1)
        if left:
            across = (i < left) & (j >= left)
            i, j = i[across], j[across]
        shared = overlaps(sets, i, j) if n <= FEW else _overlap_matrix(sets)[i, j].astype(np.int64)
        good = shared >= threshold * (sizes[i] + sizes[j] - shared) * (1 - 1e-12)
        good &= shared > 0
        return labels_of(n, i[good], j[good])
    return compare


def near_duplicates(docs, threshold=0.8, bands=40, rows=6, text="text"):
    """(node, root) for distinct texts that have a near copy; a node is the digest of a text.

    Texts that agree in all ``rows`` coordinates of one of ``bands`` bands are
    in one group, and with the defaults a pair at 0.8 is so with all but a
    probability below 1e-5. The texts of a group are held against ``threshold``
    exactly, in blocks of bounded size, each with itself and with those whose
    sizes allow it. Texts meet only inside tasks; a task gives the links that
    join two parts, at most one for each of its texts.
    """
    return linked(docs, band_keys(bands, rows), occurrences, compared(threshold), threshold, text)


def classes(docs, threshold=0.8, doc_id="doc_id", text="text", **options):
    """doc_id, class_id and class_size for each row of ``docs``.

    ``class_id`` is the least id among the rows whose texts are linked by
    similarities of ``threshold`` or more, ``class_size`` their number. Equal
    texts are in one class, repeated rows and rows without an id too; a class
    without any id has a null ``class_id``. A row without words (null, empty or
    white space) is in a class with the rows of exactly the same text, nulls
    with nulls.
    """
    roots = near_duplicates(docs, threshold, text=text, **options)
    own = docs.select(F.col(doc_id).alias("id"), _node(F.col(text)).alias("node"))
    rooted = own.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("id").alias("class_id"),
                                        F.count("*").alias("class_size"))
    return rooted.join(groups, "root").select(F.col("id").alias(doc_id), "class_id", "class_size")


def _node(text):
    return F.coalesce(node_of(text), F.lit(b""))


def keep_one(docs, threshold=0.8, doc_id="doc_id", text="text", **options):
    """One row of each class, the one with the least id, with all columns of ``docs``.

    Ties on the id go to the first row in the order of the other columns, and a
    row without an id stays only where no row of its class has one. Rows
    without words are no copies of each other and all stay.
    """
    roots = near_duplicates(docs, threshold, text=text, **options)
    worded = F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    columns = docs.columns
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.struct(*columns).alias("row"))
    tagged = docs.select(order.alias("__row"),
                         _node(F.col(text)).alias("node"), F.coalesce(worded, F.lit(False)).alias("w"))
    plain = tagged.where(~F.col("w")).select("__row.row.*")
    distinct = tagged.where("w").groupBy("node").agg(F.min("__row").alias("__row"))
    best = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("r")).agg(
        F.min("__row").alias("__row"))
    return best.select("__row.row.*").union(plain)
