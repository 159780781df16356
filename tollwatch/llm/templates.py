"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so that a question with
other values in it has the same template. Windows of template tokens of the
documents are looked up among those of the benchmark, and a match counts only
if its slots are consistent: one value of the question stands for one value in
the document, and the other way round. Slots that break this are left out, with the
windows over them. Windows of plain words are looked up beside the templates:
what is copied word for word counts whatever its share of numbers and names.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm.substrings import _filter, _passes
from tollwatch.llm.words import (
    ALNUM, LOWER, Texts, _table, byte_set, chunks, mix, of_strings, range_hashes, raw,
)
from tollwatch.session import written

WINDOW = 8
#: Matched places that are held at once; more are gone through in parts of texts and items.
PLACES = 1 << 20
#: Tokens in a row that make a leak, however long the item is.
RUN = 13
LITERAL, NUMBER, UNIT, NAME = range(4)

# Spelled numbers and units of measure.
NUMBER_WORDS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
                " fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty"
                " seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres mile miles"
         " inch inches foot feet yard yards mg g kg gram grams kilogram kilograms pound pounds"
         " ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds"
         " minute minutes hour hours day days week weeks month months year years cent cents dollar"
         " dollars euro euros percent degrees mph kmh watt watts volt volts joule joules").split()

DIGIT = byte_set(lambda b: 48 <= b < 58)
SMALL = byte_set(lambda b: 97 <= b < 123)
CAPITAL = byte_set(lambda b: 65 <= b < 91)
STOP = byte_set(lambda b: b in b".!?:;\n\"")
JOIN = byte_set(lambda b: b in b".,")


def _known(words):
    return np.sort(of_strings(words, word_bytes=ALNUM).words())


class Templates:
    """Template tokens of some texts: kind, template hash and value hash of each.

    A number may have a point or commas inside, neighbouring names are one, a
    unit is one only after a number, and a capital makes a name only inside a
    sentence.
    """

    def __init__(self, data, at):
        folded = LOWER[data]
        wide = np.zeros(len(data), bool)  # Latin-1 capitals follow byte C3
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded = folded + (wide * 32).astype(np.uint8)
        texts = Texts(data, at, ALNUM)
        start, end, doc = texts.start, texts.end, texts.doc
        self.words = texts
        coded = _table(0)[folded]
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        number = digits[end] - digits[start] == end - start

        def spans(joined):
            heads = np.flatnonzero(~joined)
            tails = np.append(heads[1:], len(joined)) - 1 if len(joined) else heads
            return heads, tails

        if len(start):
            joined = np.zeros(len(start), bool)
            joined[1:] = (number[1:] & number[:-1] & (doc[1:] == doc[:-1])
                          & (start[1:] - end[:-1] == 1) & JOIN[data[end[:-1] % len(data)]])
            heads, tails = spans(joined)
            start, end, doc, number = start[heads], end[tails], doc[heads], number[heads]
        self.word = range_hashes(coded, texts.start, texts.end)
        word = range_hashes(coded, start, end)
        number |= np.isin(word, _known(NUMBER_WORDS))
        unit = np.zeros(len(start), bool)
        opens = np.ones(len(start), bool)
        if len(start):
            same = doc[1:] == doc[:-1]
            unit[1:] = number[:-1] & same & ~number[1:] & np.isin(word[1:], _known(UNITS))
            stops = np.concatenate([[0], np.cumsum(STOP[data])])
            opens[1:] = ~same | (stops[start[1:]] > stops[end[:-1]])
        second = np.minimum(start + 1, max(len(data) - 1, 0))
        capital = (CAPITAL[data[start]] & SMALL[data[second]]) | (wide[second] & (end - start > 2)) \
            if len(start) else opens
        name = capital & ~opens & ~number & ~unit & (end - start > 1)
        if len(start):
            joined = np.zeros(len(start), bool)
            joined[1:] = name[1:] & name[:-1] & same & (start[1:] - end[:-1] == 1)
            heads, tails = spans(joined)
            start, end, doc = start[heads], end[tails], doc[heads]
            number, unit, name = number[heads], unit[heads], name[heads]
        self.kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL)
        self.value = range_hashes(coded, start, end)
        self.token = np.where(self.kind == LITERAL, self.value, mix(self.kind.astype(np.uint64)))
        self.doc, self.first = doc, np.searchsorted(doc, np.arange(len(at)))
        self.token_of = np.searchsorted(start, texts.start, side="right") - 1  # of each word

    @property
    def counts(self):
        return np.diff(self.first)

    def windows(self, size):
        """Starts and hashes of windows at least half of whose tokens are literal."""
        place = np.arange(len(self.doc))
        place = place[place + size <= self.first[1:][self.doc]] if len(place) else place
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        place = place[2 * (literal[place + size] - literal[place]) >= size]
        return place, range_hashes(self.token, place, place + size)

    def word_windows(self, size):
        """Starts and hashes of windows of plain words, whatever they are."""
        place = self.words.window_starts(size)
        return place, self.words.window_hashes(self.word, place, size)


class Index:
    """Template and word windows of some benchmark texts.

    A text of fewer tokens or words than a window is one window of its own size.
    """

    def __init__(self, ids, texts):
        data, at = raw(pa.array(texts, pa.large_string()))
        self.ids, self.items = ids, Templates(data, at)
        items = self.items
        self.sizes = self._sorted(items.counts, items.windows, items.doc)
        self.word_sizes = self._sorted(items.words.counts, items.word_windows, items.words.doc)

    @staticmethod
    def _sorted(counts, windows, docs):
        sizes = {}
        for size in sorted({min(WINDOW, int(n)) for n in counts if n}):
            place, h = windows(size)
            own = np.minimum(counts[docs[place]], WINDOW) == size
            order = np.argsort(h[own], kind="stable")
            hashes, rank = np.unique(h[own][order], return_inverse=True)
            places = place[own][order]
            sizes[size] = hashes, places, rank * np.int64(len(docs) + 1) + places
        return sizes

    @staticmethod
    def _hits(sizes, windows):
        """Per size: document places whose window the block has, and the window's rank."""
        out = []
        for size, (hashes, *_) in sizes.items():
            at, h = windows(size)
            if len(at) and len(hashes):
                rank = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                own = hashes[rank] == h
                out.append((size, at[own], rank[own]))
        return out

    @staticmethod
    def _windows(sizes, hits, n, docs, items):
        """Hits of a range of document places, with where those of item places lie and how many."""
        out = []
        for size, at, rank in hits:
            a, b = np.searchsorted(at, docs)
            _, places, keys = sizes[size]
            base = rank[a:b] * np.int64(n + 1)
            low = np.searchsorted(keys, base + items[0])
            out.append((size, at[a:b], places, low, np.searchsorted(keys, base + items[1]) - low))
        return out

    @staticmethod
    def _pairs(windows):
        """Document place, item place and size of each pair of equal windows."""
        found = [np.zeros((3, 0), np.int64)]
        for size, at, places, low, n in windows:
            at, which = np.repeat(at, n), np.repeat(low, n)
            which += np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([at, places[which], np.full(len(at), size)]))
        return np.concatenate(found, axis=1)

    def parts(self, docs):
        """Pairs of equal template and word windows, part after part of at most ``PLACES`` places.

        No text and item are in two parts; a single text and item are not cut.
        """
        own, plain = docs.words, self.items.words
        hits = self._hits(self.sizes, docs.windows)
        word_hits = self._hits(self.word_sizes, docs.word_windows)
        todo = [(0, len(own), 0, len(plain))]
        while todo:
            d0, d1, i0, i1 = todo.pop()
            both = [self._windows(sizes, found, count, (d.first[d0], d.first[d1]),
                                  (i.first[i0], i.first[i1]))
                    for sizes, found, count, d, i in (
                        (self.sizes, hits, len(self.items.doc), docs, self.items),
                        (self.word_sizes, word_hits, len(plain.doc), own, plain))]
            places = sum(int(w[-1].sum()) * w[0] for windows in both for w in windows)
            if not places:
                continue
            if places <= PLACES or (d1 - d0 == 1 and i1 - i0 == 1):
                yield [self._pairs(w) for w in both]
            elif d1 - d0 > 1:
                todo += [(d0, (d0 + d1) // 2, i0, i1), ((d0 + d1) // 2, d1, i0, i1)]
            else:
                todo += [(d0, d1, i0, (i0 + i1) // 2), (d0, d1, (i0 + i1) // 2, i1)]

    @staticmethod
    def _places(windows):
        """Window number, document place and item place of each place of the windows."""
        at, place, size = windows
        number = np.repeat(np.arange(len(at)), size)
        step = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
        return number, at[number] + step, place[number] + step

    def matches(self, docs, windows, word_windows):
        """Matched token pairs: text, item, document and item position, slot, changed."""
        number, d, i = self._places(windows)
        kept = ~np.isin(number, number[self._conflicts(docs, d, i)])
        _, dw, iw = self._places(word_windows)
        same = pd.DataFrame({"d": docs.token_of[dw], "i": self.items.token_of[iw], "changed": False})
        alike = pd.DataFrame({"d": d[kept], "i": i[kept]})
        alike["changed"] = docs.value[alike["d"]] != self.items.value[alike["i"]]
        pairs = pd.concat([same.drop_duplicates(), alike.drop_duplicates()])
        pairs = pairs.sort_values(["d", "i", "changed"]).drop_duplicates(["d", "i"])
        d, i = pairs["d"].to_numpy(), pairs["i"].to_numpy()
        return pairs.assign(doc=docs.doc[d], item=self.items.doc[i],
                            slot=self.items.kind[i] != LITERAL)

    def _conflicts(self, docs, d, i):
        """Which token pairs are slots that go against a better pair of values of their line.

        A line is a text, an item and a shift. Its pairs of values are taken one to
        one: the most frequent first, then equal values, then the first in the item.
        """
        slot = np.flatnonzero(self.items.kind[i] != LITERAL)
        rows = pd.DataFrame({"d": d[slot], "i": i[slot]}).drop_duplicates()
        line = ["doc", "item", "shift"]
        here, there = [*line, "here"], [*line, "there"]
        ds, its = rows["d"].to_numpy(), rows["i"].to_numpy()
        rows = rows.assign(doc=docs.doc[ds], item=self.items.doc[its], shift=ds - its,
                           here=self.items.value[its], there=docs.value[ds])
        values = rows.groupby([*line, "here", "there"], sort=False).agg(
            n=("i", "size"), at=("i", "min")).reset_index()
        twice = values.duplicated(here, keep=False) | values.duplicated(there, keep=False)
        open_, bad = values[twice], []
        open_ = open_.assign(differs=open_["here"] != open_["there"]).sort_values(
            ["n", "differs", "at"], ascending=[False, True, True])
        while len(open_):
            best = ~open_.duplicated(here) & ~open_.duplicated(there)
            taken, rest = open_[best], open_[~best]
            beaten = np.zeros(len(rest), bool)
            for key in (here, there):
                beaten |= rest[key].merge(taken[key].assign(hit=True), on=key, how="left")[
                    "hit"].notna().to_numpy()
            bad.append(rest[beaten])
            open_ = rest[~beaten]
        out = np.zeros(len(d), bool)
        if sum(map(len, bad)):
            lost = rows.merge(pd.concat(bad)[[*line, "here", "there"]], on=[*line, "here", "there"])
            n = np.int64(len(self.items.doc))
            out[slot] = np.isin(d[slot] * n + i[slot], lost["d"].to_numpy() * n + lost["i"].to_numpy())
        return out

    @staticmethod
    def _longest(pairs):
        """Most item tokens matched in a row at one shift, per text and item."""
        line = ["doc", "item", "shift"]
        rows = pairs.assign(shift=pairs["d"] - pairs["i"]).sort_values([*line, "i"])
        before = rows[[*line, "i"]].shift()
        goes_on = (rows[line] == before[line]).all(axis=1) & (rows["i"] == before["i"] + 1)
        sizes = rows.groupby((~goes_on).cumsum()).agg(
            doc=("doc", "first"), item=("item", "first"), run=("i", "size"))
        return sizes.groupby(["doc", "item"])["run"].max()

    def leaks(self, data, at, covered):
        """Per text and item: tokens matched, share of the item, slots, and how many differ.

        Frames of bounded size, none with a text and item of another.
        """
        docs = Templates(data, at)
        for part in self.parts(docs):
            found = self._leaks(self.matches(docs, *part), covered)
            if len(found):
                yield found

    def _leaks(self, pairs, covered):
        if not len(pairs):
            return pairs
        longest = self._longest(pairs)
        pairs = pairs.sort_values(["doc", "item", "i", "changed", "d"]).drop_duplicates(
            ["doc", "item", "i"])
        out = pairs.groupby(["doc", "item"]).agg(
            n_tokens=("i", "size"), n_slots=("slot", "sum"),
            n_changed=("changed", "sum")).reset_index()
        out["covered"] = out["n_tokens"] / self.items.counts[out["item"]]
        run = longest.loc[pd.MultiIndex.from_frame(out[["doc", "item"]])].to_numpy()
        return out[(out["covered"] >= covered) | (run >= RUN)]


TEMPLATE, WORDS = 0, 1


def _keys(texts, kind, size):
    """Text of each window of a kind and size, and the window's key."""
    place, h = texts.windows(size) if kind == TEMPLATE else texts.word_windows(size)
    doc = texts.doc if kind == TEMPLATE else texts.words.doc
    return doc[place], mix(h + np.uint64(16 * kind + size))


def _item_rows(least):
    """Windows (h, item, kind, size) of benchmark texts; short ones are one window."""
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Templates(data, at)
            for kind, counts in ((TEMPLATE, texts.counts), (WORDS, texts.words.counts)):
                for size in sorted({min(WINDOW, int(n)) for n in counts if n >= least}):
                    own, h = _keys(texts, kind, size)
                    fits = (np.minimum(counts, WINDOW) == size)[own]
                    pairs = np.unique(np.stack([h[fits].view(np.int64), own[fits]]), axis=1)
                    yield pa.RecordBatch.from_pydict({
                        "h": pairs[0], "item": batch.column(0).take(pa.array(pairs[1])),
                        "kind": np.full(pairs.shape[1], kind, np.int32),
                        "size": np.full(pairs.shape[1], size, np.int32)})
    return run


def _hit_rows(kinds, shared):
    """Texts with windows that the benchmark may have, and the keys of those windows."""
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Templates(data, at)
            found = [np.zeros((2, 0), np.int64)]
            for kind, size in kinds:
                own, h = _keys(texts, kind, size)
                if shared is not None:
                    good = _passes(shared.value, h)
                    own, h = own[good], h[good]
                found.append(np.stack([own, h.view(np.int64)]))
            own, h = np.unique(np.concatenate(found, axis=1), axis=1)
            hit, n = np.unique(own, return_counts=True)
            part = batch.take(pa.array(hit))
            bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "key": part.column(0), "text": part.column(1),
                "h": pa.ListArray.from_arrays(pa.array(bounds), pa.array(h))})
    return run


def _pair_rows(covered):
    """What is matched in each pair of a document's and an item's text."""
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            keys, item_keys = (batch.column(k).to_pylist() for k in (0, 2))
            first, items = {}, {}
            for row, key in enumerate(keys):
                first.setdefault(key, row)
            texts = batch.column(3)
            for row, key in enumerate(item_keys):
                if key not in items:
                    items[key] = texts[row].as_py()
            index = Index(list(items), list(items.values()))
            asked = set(zip(keys, item_keys, strict=True))
            rows = batch.take(pa.array(list(first.values())))
            names = list(first)
            for found in index.leaks(*raw(rows.column(1)), covered):
                own = [(names[d], index.ids[i]) in asked for d, i in zip(
                    found["doc"], found["item"], strict=True)]
                found = found[own]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([names[d] for d in found["doc"]], pa.binary()),
                    "item": pa.array([index.ids[i] for i in found["item"]], pa.binary()),
                    **{c: pa.array(found[c].to_numpy()) for c in MATCHED}})
    return run


MATCHED = ("n_tokens", "covered", "n_slots", "n_changed")
FOUND = "key binary, item binary, n_tokens long, covered double, n_slots long, n_changed long"


def _digest(text):
    return F.unhex(F.md5(F.col(text)))


def _matches(docs, benchmark, covered, least, text, item_text):
    """Leaking pairs of distinct texts, by digests.

    The windows of both sides are joined in Spark. Before that, a bitmap of the
    benchmark's windows, of fixed size, leaves out windows and documents that
    it cannot have; where the benchmark would fill it, all windows are joined.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).groupBy(
        _digest(item_text).alias("item")).agg(F.min(item_text).alias("item_text"))
    windows = written(items.mapInArrow(
        _item_rows(least), "h long, item binary, kind int, size int"), "benchmark-windows")
    # at most WINDOW sizes of two kinds
    kinds = sorted(tuple(r) for r in windows.select("kind", "size").distinct().collect())
    bitmap = _filter(windows)
    shared = None if bitmap is None else spark.sparkContext.broadcast(bitmap)
    source = docs.select(_digest(text).alias("key"), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    hits = written(source.mapInArrow(
        _hit_rows(kinds, shared), "key binary, text string, h array<long>"), "benchmark-hits")
    asked = hits.select("key", F.explode("h").alias("asked")).distinct()
    # a window that many texts or items have is split by adaptive execution
    pairs = asked.join(windows.select("h", "item"), F.col("asked").eqNullSafe(F.col("h"))).select(
        "key", "item").distinct()
    texts = hits.groupBy("key").agg(F.min("text").alias("text"))
    both = pairs.join(texts, "key").join(items, "item")
    return both.select("key", "text", "item", "item_text").mapInArrow(_pair_rows(covered), FOUND)


def leaks(docs, benchmark, covered=0.3, doc_id="doc_id", item_id="item_id", text="text",
          item_text="text", least=1):
    """Documents and benchmark items of which they hold the share ``covered`` or a run of ``RUN`` tokens.

    One row per document row and item: doc_id, item_id, n_tokens matched, the
    share ``covered``, n_slots and n_changed (slots with another value than the
    item's). Null and empty texts hold nothing and are not held; windows without
    a literal word in half of their tokens match only word for word. Items of
    fewer than ``least`` tokens are not looked for. Repeated rows on either side
    give repeated results; copies of a text are matched once. An item of fewer
    words than a window matches as a whole. With no items or no documents the
    result is empty. Neither side passes through the driver.
    """
    found = _matches(docs, benchmark, covered, least, text, item_text)
    own = docs.select(F.col(doc_id).alias("doc"), _digest(text).alias("own"))
    items = benchmark.select(F.col(item_id).alias("name"), _digest(item_text).alias("its"))
    rows = own.join(found, F.col("own").eqNullSafe(F.col("key"))).join(
        items, F.col("item").eqNullSafe(F.col("its")))
    return rows.select(F.col("doc").alias(doc_id), F.col("name").alias(item_id), *MATCHED)


def decontaminate(docs, benchmark, covered=0.3, text="text", item_text="text", least=4):
    """``docs`` without the rows that ``leaks`` would report; columns unchanged.

    Items of fewer than ``least`` tokens take no document away, since common
    phrases are that short; ``leaks`` can report them. Null and empty texts
    stay, repeated rows share their fate, empty tables on either side leave
    ``docs`` as they are.
    """
    name = "leaking"
    while name in docs.columns:
        name += "_"
    gone = _matches(docs, benchmark, covered, least, text, item_text).select(
        F.col("key").alias(name)).distinct()
    return docs.join(gone, _digest(text).eqNullSafe(F.col(name)), "left_anti")
