"""Jaccard join of word n-grams by signature trees.

A document is the set of its distinct shingles. The leaves of a signature tree
are sets, each with a bitmap of its hashed elements and its size; a node above
holds the combined bitmaps and the range of sizes of what lies below. Two trees
are walked together from their tops: a pair of nodes is left as soon as the bits
that both have cannot make an overlap that the sizes ask for, and only pairs of
leaves that are reached are compared element by element.

Trees are built inside groups of documents that can be linked at all. Elements
are dealt by hash to more parts than two linked sets have differing elements, so
two linked sets agree in a whole part: sets that agree in no part are the pairs
that a walk of one tree over everything would leave at its top.
"""

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm.darts import shingles
from tollwatch.llm.groups import labels_of, linked, node_of, overlaps, spared_meetings
from tollwatch.llm.words import LOWER, Texts, chunks, mix

SHINGLE = 4
PERCENT = 85
FANOUT = 8
#: Pairs of nodes looked at together.
PAIRS = 1 << 14
#: Sizes of one class lie within this ratio.
RATIO = 1.2


def _sets(data, at, size):
    doc, h, _ = shingles(Texts(data, at, fold=LOWER), size)
    return doc, h


def encoded(size=SHINGLE):
    """Sorted shingle hashes of each text."""
    def encode(data, at):
        doc, h = _sets(data, at, size)
        return np.split(h, np.searchsorted(doc, np.arange(1, len(at) - 1)))
    return encode


@functools.lru_cache(8)
def _classes(longest, percent):
    """Least size, number of parts and empty parts allowed of each class of sizes."""
    low = [1]
    while low[-1] <= longest:
        low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
    most = 2 * (np.array(low[1:]) - 1)
    differing = most * (100 - percent) // (100 + percent)
    spare = np.where(differing > 0, 1 + differing // 16, 0)
    return np.array(low), differing + 1 + spare, spare


def spared_keys(size=SHINGLE, percent=PERCENT):
    """Function that gives the keys of texts, each with its class and how many may be left out.

    Two linked sets differ in at most ``k`` elements, where ``k`` follows from
    the class of the larger one; each set uses the parts of its own class and of
    those above that a partner may be in. Of ``k + 1 + e`` parts at least
    ``e + 1`` are equal. Parts without elements say nothing and give no key; a
    set with more than ``e`` of them has keys for the choices of ``e + 1``. That
    is seldom from 80 percent on, where a part has some three elements or more;
    lower thresholds are refused.

    Since ``e + 1`` parts are equal, a set may leave out as many as ``e`` in each
    class, its empty parts among them, if all sets leave out those that are last
    in one order of all parts: the first of the equal ones stays in both.
    """
    if percent < 80:
        raise ValueError("part keys need a threshold of 80 percent or more")

    def keys(data, at):
        doc, h = _sets(data, at, size)
        n = len(at) - 1
        sizes = np.bincount(doc, minlength=n)
        # up to the classes of partners that are longer than all texts here
        low, parts, spare = _classes(2 << int(sizes.max(initial=1)).bit_length(), percent)
        own = np.searchsorted(low, sizes, side="right") - 1
        spread, value = mix(h + np.uint64(1)), mix(h + np.uint64(2))
        owners, found, kinds, free = [], [], [], []
        step = 0
        while True:
            kind = np.minimum(own + step, len(parts) - 1)
            use = (sizes > 0) & (own + step < len(parts)) & (
                (step == 0) | (100 * sizes >= percent * low[kind]))
            if not use.any():
                break
            step += 1
            number = np.where(use, parts[kind], 0)
            base = np.concatenate([[0], np.cumsum(number)])
            mine = use[doc]
            slot = base[doc[mine]] + (
                spread[mine] % number[doc[mine]].astype(np.uint64)).astype(np.int64)
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, slot, value[mine])
            count = np.bincount(slot, minlength=base[-1])
            owner = np.repeat(np.arange(n), number)
            part = np.arange(base[-1]) - base[owner]
            key = mix(total + mix(((kind[owner] << 32) + part).astype(np.uint64)))
            filled = count > 0
            empty = np.bincount(owner[~filled], minlength=n)
            owners.append(owner[filled])
            found.append(key[filled])
            kinds.append(kind[owner[filled]])
            free.append(np.maximum(spare[kind] - empty, 0)[owner[filled]])
            for d in np.flatnonzero(use & (empty > spare[kind])).tolist():
                none = part[base[d]:base[d + 1]][~filled[base[d]:base[d + 1]]].tolist()
                choices = list(itertools.combinations(none, int(spare[kind[d]]) + 1))
                named = np.zeros(len(choices), np.uint64) + np.uint64(kind[d] + 1)
                for column in np.array(choices, np.uint64).T:
                    named = mix(named + column + np.uint64(1))
                owners.append(np.full(len(choices), d))
                found.append(mix(named))
                kinds.append(np.full(len(choices), kind[d]))
                free.append(np.zeros(len(choices), np.int64))
        if not owners:
            return (np.zeros(0, np.int64), np.zeros(0, np.uint64),
                    np.zeros(0, np.int64), np.zeros(0, np.int64))
        return tuple(map(np.concatenate, (owners, found, kinds, free)))
    return keys


def part_keys(size=SHINGLE, percent=PERCENT):
    """Function that gives the keys of texts: one for each part of their elements, none left out."""
    every = spared_keys(size, percent)
    return lambda data, at: every(data, at)[:2]


class Tree:
    """Bitmaps and size ranges of sets, level by level from the leaves up."""

    def __init__(self, sets, words):
        size = np.array([len(s) for s in sets])
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((least, size))
        size = size[self.order]
        h = mix(np.concatenate([sets[i] for i in self.order]))
        bit = h % np.uint64(64 * words)
        place = np.repeat(np.arange(len(sets)) * words, size) + (bit >> np.uint64(6)).astype(np.int64)
        maps = np.zeros(len(sets) * words, np.uint64)
        np.bitwise_or.at(maps, place, np.uint64(1) << (bit & np.uint64(63)))
        maps = maps.reshape(len(sets), words)
        # elements that share a bit with another of their set
        extra = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, extra)]
        while len(maps) > FANOUT:
            heads = np.arange(0, len(maps), FANOUT)
            maps, low, high, extra = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, heads, axis=0)
            self.levels.append((maps, np.minimum.reduceat(low, heads),
                                np.maximum.reduceat(high, heads), np.maximum.reduceat(extra, heads)))

    def children(self, level, nodes):
        """Which of ``nodes`` each child belongs to, and the children."""
        low = nodes * FANOUT
        n = np.minimum(low + FANOUT, len(self.levels[level - 1][0])) - low
        which = np.repeat(np.arange(len(nodes)), n)
        return which, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _possible(a, b, i, j, percent):
    """Which pairs of nodes may hold sets that are linked."""
    out = []
    for k in range(0, len(i), PAIRS):
        p, q = i[k:k + PAIRS], j[k:k + PAIRS]
        common = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(a[3][p], b[3][q]), np.minimum(a[2][p], b[2][q]))
        least = np.maximum(a[1][p] + b[1][q], 1)
        out.append((100 + percent) * most >= percent * least)
    return np.concatenate(out) if out else np.zeros(0, bool)


def walk(a, b, percent=PERCENT):
    """Pairs of leaves of two trees, or of one with itself, that a walk of both reaches."""
    x, y = len(a.levels) - 1, len(b.levels) - 1
    i, j = (v.reshape(-1) for v in np.meshgrid(
        np.arange(len(a.levels[x][0])), np.arange(len(b.levels[y][0])), indexing="ij"))
    while True:
        if a is b and x == y:
            forward = i < j if x == 0 else i <= j
            i, j = i[forward], j[forward]
        good = _possible(a.levels[x], b.levels[y], i, j, percent)
        i, j = i[good], j[good]
        if x == y == 0:
            return a.order[i], b.order[j]
        if x >= y:
            which, i = a.children(x, i)
            j, x = j[which], x - 1
        else:
            which, j = b.children(y, j)
            i, y = i[which], y - 1


def compared(percent=PERCENT):
    """Function that labels the sets that reach each other by links."""
    def compare(sets, left):
        n = len(sets)
        longest = max(map(len, sets))
        words = 1 << max(2, min(9, (longest // 8).bit_length()))
        if left:
            i, j = walk(Tree(sets[:left], words), Tree(sets[left:], words), percent)
            j = j + left
        else:
            tree = Tree(sets, words)
            i, j = walk(tree, tree, percent)
        sizes = np.array([len(s) for s in sets])
        label, good = np.arange(n), np.zeros((2, 0), np.int64)
        while len(i):
            # one open pair for each set; what it links need not be compared again
            now = np.zeros(len(i), bool)
            now[np.unique(j, return_index=True)[1]] = True
            p, q = i[now], j[now]
            both = overlaps(sets, p, q)
            fine = (100 * both >= percent * (sizes[p] + sizes[q] - both)) & (both > 0)
            good = np.concatenate([good, np.stack([p, q])[:, fine]], axis=1)
            label = labels_of(n, *good)
            open_ = ~now & (label[i] != label[j])
            i, j = i[open_], j[open_]
        return label
    return compare


def _sizes(size, doc_id):
    def run(batches):
        for batch, data, at in chunks(batches, 2):
            doc, _ = _sets(data, at, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.bincount(doc, minlength=len(batch)))],
                names=[doc_id, "node", "n_shingles"])
    return run


def jaccard_components(docs, percent=PERCENT, size=SHINGLE, doc_id="doc_id", text="text"):
    """doc_id, n_shingles and component_id of each row of ``docs``.

    Two rows are linked when their sets of shingles of ``size`` lower-cased
    words have a Jaccard similarity of ``percent`` percent or more; a text of
    fewer words is one shingle. ``component_id`` is the least id that links
    reach, the row itself included. Rows without words (null, empty or white
    space) have no shingle and no link: their component is their own id.
    Repeated rows, and rows without an id, are linked like others; ids of null
    are passed over for the least one. An empty table gives an empty one; other
    columns are not looked at. Shingles are compared by 64-bit hashes.
    """
    kind = dict(docs.dtypes)[doc_id]
    roots = linked(docs, spared_keys(size, percent), encoded(size), compared(percent),
                   percent / 100, text, spared_meetings)
    own = docs.select(F.col(doc_id), node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    own = own.mapInArrow(_sizes(size, doc_id), f"`{doc_id}` {kind}, node binary, n_shingles long")
    own = own.select(F.col(doc_id).alias("id"), "node", "n_shingles")
    rooted = own.join(roots, "node", "left").select(
        "id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.where("root is not null").join(least, "root").select(
        F.col("id").alias(doc_id), "n_shingles", "component_id").union(
        rooted.where("root is null").select("id", "n_shingles", "id"))
