"""Linking of texts that meet under a key, in blocks of bounded size.

Texts are nodes, by a digest. ``meetings`` finds which nodes share a key, as
edges of a forest: keys that many texts of a task have are folded there, so a
hot key sends a few rows to the shuffle, not one for each text, and the texts
that meet in a task go on as one. ``spared_meetings`` is for keys of which texts
have more than they need: each leaves out those that most texts have, so that a
passage in many unlike texts does not join them. ``linked`` lays out the texts
of each group of meeting nodes side by side and compares them in blocks inside
tasks. A block gives a link for each of its texts at most, and a pair of blocks
only links between the classes that each of them has by itself.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Window

from tollwatch.llm.words import chunks
from tollwatch.session import checkpointed, released, written

#: Texts and set elements of a block; a single longer text is a block of its own.
BLOCK_TEXTS = 1024
BLOCK_ITEMS = 1 << 19
#: Elements that are sorted together to compare pairs.
COMPARED = 1 << 20
#: Keys that a task remembers because several of its texts have them.
HOT_KEYS = 1 << 16


def node_of(text):
    """Node of a text; nulls have none."""
    return F.unhex(F.md5(text))


def _short(text):
    return F.xxhash64(text)


def components(edges):
    """(node, root) for every node of ``edges`` (a, b): the least node it is linked to.

    Every round links each node to the least root next to it and then halves
    the paths, so the rounds grow with the logarithm of a chain's length. State
    is one row per node, cut from its lineage in each round.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = checkpointed(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
    state = checkpointed(state.select(F.col("u").alias("node"), "root"))
    while True:
        roots = state.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        seen = both.join(roots, "v").groupBy("u").agg(F.min("rv").alias("near"))
        near = state.join(seen.select(F.col("u").alias("node"), "near"), "node").select(
            "node", "root", F.least("root", "near").alias("near"))
        # the root of a node hears of the least root that any of its nodes has met
        told = near.groupBy("root").agg(F.min("near").alias("told"))
        hooked = near.join(told, "root").select(
            "node", "root", F.least("near", "told").alias("new"))
        hops = hooked.select(F.col("node").alias("new"), F.col("new").alias("hop"))
        following = checkpointed(hooked.join(hops, "new", "left").select(
            "node", F.col("root").alias("old"), F.least("new", "hop").alias("root")))
        state = following.select("node", "root")
        if following.where("old <> root").isEmpty():
            return state


def _forest(a, b):
    """Nodes of the links (a, b), and for each the least node that they link it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[labels_of(len(nodes), at[:len(a)], at[len(a):])]


def _fold(key, node, hot):
    """Which (key, node) rows go on, and (a, b) links in place of the others.

    Rows of one key in a chunk go on as one. Keys that several nodes of a
    chunk had are remembered in ``hot``, and do not go on again. Nodes that
    meet here are linked to the least of them, one link for each, and it stands
    for them in the rows that go on.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    opens = np.ones(len(key), bool)
    opens[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(opens)
    size = np.diff(np.append(head, len(key)))
    known = np.array([hot.get(k, 0) for k in key[head].tolist()], np.int64)
    seen = known != 0
    nodes, least = _forest(np.concatenate([np.repeat(node[head], size), known[seen]]),
                           np.concatenate([node, node[head][seen]]))
    key, node = key[head], least[np.searchsorted(nodes, node[head])]
    for i in np.flatnonzero(~seen & (size > 1)).tolist():
        if len(hot) < HOT_KEYS:
            hot[int(key[i])] = int(node[i])
    joined = nodes != least
    return key[~seen], node[~seen], np.stack([least[joined], nodes[joined]])


def _key_rows(keys):
    def run(batches):
        hot = {}
        for batch, data, at in chunks(batches, 1):
            owner, key = keys(data, at)
            nodes = batch.column(0).to_numpy()
            key, node, (a, b) = _fold(key.view(np.int64), nodes[owner], hot)
            yield pa.RecordBatch.from_pydict({
                "key": np.concatenate([key, a]), "a": np.concatenate([node, a]),
                "b": pa.array(np.concatenate([node, b]),
                              mask=np.arange(len(node) + len(b)) < len(node))})
    return run


def _stars(batches):
    """Links from the least node of each key to its others, and those found before.

    Keys that share many nodes mostly share the least one, so that links of
    different keys are the same ones.
    """
    last_key = last_node = None
    for batch in batches:
        key, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        b = batch.column(2).fill_null(0).to_numpy()
        links = [np.stack([a[found], b[found]])]
        key, a = key[~found], a[~found]
        if len(key):
            opens = np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            head = np.flatnonzero(opens)
            least = a[head]
            if key[0] == last_key:
                least[0] = last_node
            links.append(np.stack([np.repeat(least, np.diff(np.append(head, len(key)))), a]))
            last_key, last_node = key[-1], least[-1]
        nodes, least = _forest(*np.concatenate(links, axis=1))
        joined = nodes != least
        yield pa.RecordBatch.from_pydict({"a": least[joined], "b": nodes[joined]})


def meetings(docs, keys, text="text"):
    """(node, root) of texts that share a key with another text, by 64-bit nodes."""
    source = docs.select(_short(F.col(text)).alias("node"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    rows = source.mapInArrow(_key_rows(keys), "key long, a long, b long")
    met = rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(
        _stars, "a long, b long")
    return components(met.distinct())


def _unseen(batches):
    """Batches without the rows of nodes that the task has had, as far as it remembers them."""
    seen = set()
    for batch in batches:
        new = []
        for i, node in enumerate(batch.column(0).to_pylist()):
            if node not in seen:
                new.append(i)
                if len(seen) < HOT_KEYS:
                    seen.add(node)
        yield batch.take(pa.array(new, pa.int64()))


KEY_COLUMNS = "key", "node", "kind", "free"
KEY_TYPES = pa.int64(), pa.int64(), pa.int32(), pa.int32()
KEY_ROW = "key long, node long, kind int, free int"


def _spared_rows(keys):
    def run(batches):
        for batch, data, at in chunks(_unseen(batches), 1):
            owner, key, kind, free = keys(data, at)
            rows = key.view(np.int64), batch.column(0).to_numpy()[owner], kind, free
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, KEY_TYPES, strict=True)], names=list(KEY_COLUMNS))
    return run


def _shared(batches):
    """Rows of keys that several nodes have, each node once, and ``n``, the number of these nodes.

    Rows come sorted. ``n`` is counted up to ``HOT_KEYS``; the rows of a key are
    held until it is known, so that all of them get the same.
    """
    held, hot = [np.zeros(0, np.int64)] * 4, None
    for batch in itertools.chain(batches, [None]):
        rows = held
        if batch is not None:
            rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True)]
        key, node = rows[:2]
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        rows = [x[new] for x in rows]
        key = rows[0]
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(opens)
        size = np.diff(np.append(head, len(key)))
        n = np.minimum(size, HOT_KEYS)
        if key[0] == hot:
            n[0] = HOT_KEYS  # its first rows are gone
        ready = len(key) if batch is None else head[-1]
        if batch is not None and n[-1] == HOT_KEYS:
            hot, ready = key[-1], len(key) - 1
        held = [x[ready:] for x in rows]
        n = np.repeat(n, size)[:ready]
        some = n > 1
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x[:ready][some], kind) for x, kind in zip(rows, KEY_TYPES, strict=True)),
             pa.array(n[some], pa.int32())], names=[*KEY_COLUMNS, "n"])


def spared_meetings(docs, keys, text="text"):
    """(node, root) of texts that share a key with another text, where some keys may be left out.

    ``keys(data, at)`` gives text numbers, keys, the class of each key and how
    many keys of that class its text may leave out. Each text leaves out those
    that most texts have, ties by the key, so that a passage which many unlike
    texts have in common does not join them. Only keys of several texts are
    counted: the others stay, and join nothing.
    """
    source = docs.select(_short(F.col(text)).alias("node"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    rows = source.mapInArrow(_spared_rows(keys), KEY_ROW)
    shared = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        _shared, f"{KEY_ROW}, n int")
    most = Window.partitionBy("node", "kind").orderBy(F.desc("n"), "key")
    kept = shared.withColumn("place", F.row_number().over(most)).where("place > free").select(
        "key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"))
    met = kept.repartition("key").sortWithinPartitions("key", "a").mapInArrow(
        _stars, "a long, b long")
    found = components(met.distinct())
    del rows, shared, kept, met
    released(docs.sparkSession)
    return found


def overlaps(sets, i, j):
    """Elements in common of pairs of sets."""
    out = np.zeros(len(i), np.int64)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes[i] + sizes[j])
    low = 0
    while low < len(i):
        before = at[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(at, before + COMPARED, side="right")))
        pairs = range(low, high)
        h = np.concatenate([x for k in pairs for x in (sets[i[k]], sets[j[k]])])
        pair = np.repeat(np.arange(high - low), (sizes[i] + sizes[j])[low:high])
        order = np.lexsort((h, pair))
        h, pair = h[order], pair[order]
        same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
        out[low:high] = np.bincount(pair[1:][same], minlength=high - low)
        low = high
    return out


def labels_of(n, i, j):
    """Least number linked to each of ``n`` numbers by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new[new]


ROWS = ("a binary, b binary, root long, part long, node binary, text string, items long")


def _record(links, root=None, part=None, nodes=(), texts=(), items=()):
    """Links, and texts of a part, each with the node that its links in the part lead to."""
    gap, n = [None] * len(links), len(nodes)
    return pa.RecordBatch.from_arrays(
        [pa.array([*(x[0] for x in links), *[None] * n], pa.binary()),
         pa.array([*(x[1] for x in links), *[None] * n], pa.binary()),
         pa.array([*gap, *[root] * n], pa.int64()), pa.array([*gap, *[part] * n], pa.int64()),
         pa.array([*gap, *nodes], pa.binary()), pa.array([*gap, *texts], pa.string()),
         pa.array([*gap, *items], pa.int64())],
        names=["a", "b", "root", "part", "node", "text", "items"])


class _Held:
    """Texts of one group as they come, up to the size of a block."""

    def __init__(self, compare):
        self.compare, self.of = compare, None
        self.empty()

    def empty(self):
        self.nodes, self.texts, self.sets, self.left = [], [], [], 0
        self.items = 0

    def add(self, node, own, text=None):
        self.nodes.append(node)
        self.texts.append(text)
        self.sets.append(own)
        self.items += len(own)

    def full(self):
        return len(self.nodes) >= BLOCK_TEXTS or self.items >= BLOCK_ITEMS

    def links(self):
        if len(self.nodes) < 2:
            return []
        label = self.compare(self.sets, self.left)
        links = ((self.nodes[k], self.nodes[i]) for i, k in enumerate(label.tolist()))
        return list(dict.fromkeys((a, b) for a, b in links if a != b))


def _group_rows(encode, compare):
    """Links of groups that lie in this task as one block; texts of all others in parts, and their links.

    In place of its node a text of a part has the first node that it is linked to there.
    """
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        held, cut, first = _Held(compare), False, True

        def flush(whole):
            nonlocal part
            links = held.links()
            if not whole and held.nodes:
                to = {b: a for a, b in links}
                yield _record(links, held.of, part, [to.get(x, x) for x in held.nodes], held.texts,
                              map(len, held.sets))
                part += 1
            elif links:
                yield _record(links)
            held.empty()

        for batch, data, at in chunks(batches, 2):
            sets = encode(data, at)
            roots, nodes = (batch.column(k).to_pylist() for k in (0, 1))
            texts = batch.column(2)
            for i, root in enumerate(roots):
                if root != held.of:
                    # the first group of a task may have begun in the one before
                    yield from flush(not (cut or first))
                    first = first and held.of is None
                    held.of, cut = root, False
                elif held.full():
                    yield from flush(False)
                    cut = True
                held.add(nodes[i], sets[i], texts[i].as_py())
        yield from flush(False)
    return run


def _pair_rows(encode, compare):
    """Links between the parts of a block, or of two blocks, as they come sorted.

    Texts that are linked within their part have one node, so they give one link.
    """
    def run(batches):
        held = _Held(compare)
        for batch, data, at in chunks(batches, 5):
            sets = encode(data, at)
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), sets, strict=True)
            for root, low, high, side, node, own in rows:
                if (root, low, high) != held.of:
                    links = held.links()
                    if links:
                        yield _record(links).select([0, 1])
                    held.empty()
                    held.of = root, low, high
                held.add(node, own)
                held.left += low != high and side == 0
        links = held.links()
        if links:
            yield _record(links).select([0, 1])
    return run


def linked(docs, keys, encode, compare, least_ratio, text="text", meet=meetings):
    """(node, root) of texts linked by ``compare`` to another text, nodes as in ``node_of``.

    ``keys(data, at)`` gives the keys of some texts as text numbers and unsigned
    64-bit keys, or as ``meet`` asks for them, which makes groups of texts that
    share keys; two texts that are to be linked must be in one group.
    ``encode(data, at)`` gives the set of each text, and ``compare(sets, left)``
    the label of each set: the least number among the sets that it is linked to,
    among all of them or, for ``left`` over 0, between the first ``left`` and the
    others. Sets whose sizes have a ratio below ``least_ratio`` are never linked.

    Groups that a task holds as one block are compared there. Of the others,
    those longer than a block or cut by the border of a task, each part is
    compared within itself, parts are gathered into blocks by their sizes, and
    blocks are compared two by two where their sizes allow links, a block of
    several parts also with itself.
    """
    met = meet(docs, keys, text)
    source = docs.select(_short(F.col(text)).alias("short"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    # copies of a text are one before the shuffle
    texts = source.join(met.withColumnRenamed("node", "short"), "short").groupBy(
        "root", node_of(F.col("text")).alias("node")).agg(F.min("text").alias("text"))
    order = [F.col("root"), F.length("text"), F.col("node")]
    found = written(
        texts.repartitionByRange(*order).sortWithinPartitions(*order).select("root", "node", "text")
        .mapInArrow(_group_rows(encode, compare), ROWS), "groups")
    members = found.where("node is not null")
    parts = members.groupBy("root", "part").agg(
        F.count("*").alias("n"), F.sum("items").alias("m"), F.min("items").alias("least"),
        F.max("items").alias("most"))
    before = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.greatest(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK_TEXTS,
                        F.coalesce(F.sum("m").over(before), F.lit(0)) / BLOCK_ITEMS)
    parts = parts.withColumn("block", F.floor(filled).cast("int"))
    members = members.join(parts.select("part", "block"), "part").select(
        "root", "block", "node", "text")
    blocks = parts.groupBy("root", "block").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("parts"))
    columns = "block", "least", "most", "parts"
    low, high = (blocks.select("root", *(F.col(c).alias(f"{c}_{k}") for c in columns))
                 for k in ("low", "high"))
    pairs = low.join(high, "root").where(
        ((F.col("block_low") < F.col("block_high"))
         | (F.col("block_low") == F.col("block_high")) & (F.col("parts_low") > 1))
        & (F.col("most_low") >= least_ratio * F.col("least_high"))
        & (F.col("most_high") >= least_ratio * F.col("least_low"))).select(
        "root", F.col("block_low").alias("low"), F.col("block_high").alias("high"))
    sides = F.explode(F.array_distinct(F.array(
        F.struct(F.lit(0).alias("side"), F.col("low").alias("block")),
        F.struct((F.col("low") < F.col("high")).cast("int").alias("side"), F.col("high").alias("block")))))
    sent = pairs.select("root", "low", "high", sides.alias("s")).select(
        "root", "low", "high", "s.side", "s.block")
    order = ["root", "low", "high", "side"]
    across = sent.join(members, ["root", "block"]).select(*order, "node", "text").repartition(
        "root", "low", "high").sortWithinPartitions(*order).mapInArrow(
        _pair_rows(encode, compare), "a binary, b binary")
    return components(found.where("a is not null").select("a", "b").union(across))
