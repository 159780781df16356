"""Runs of repeated phrases in the words of a text, found from Lyndon arrays.

A run is a stretch with a smallest period that no neighbouring word extends.
Each run holds a Lyndon root, a longest Lyndon word at its place under an order
of the words or under the opposite one. Both Lyndon arrays come from grouping,
the first phase of a suffix sorter: suffixes are grouped by their first word,
and from the highest group down each group is appended to the suffixes in front
of it. Every root is then extended to both sides by longest common extensions.

Only zones that can hold a run of the asked exponent are grouped: all but the
last period of a run are words that come again within one period.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm.words import Texts, chunks, mix, prefix_hashes

LEAST_WORDS = 6
LEAST_EXPONENT = 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_array(ranks):
    """Length of the longest Lyndon word at each place of a list of small integers."""
    n = len(ranks)
    suffixes = sorted(range(n), key=ranks.__getitem__)
    slot = [0] * n
    group = [0] * n  # first slot of the group of each suffix
    end, context = {}, {}  # by first slot: one past the last slot, words in common
    low = 0
    for k, i in enumerate(suffixes):
        slot[i] = k
        if ranks[i] != ranks[suffixes[low]]:
            low = k
        group[i] = low
        end[low], context[low] = k + 1, 1
    before = [-1] * n
    todo = n
    while todo:
        low = group[suffixes[todo - 1]]
        length = context[low]
        times = {}
        for i in sorted(suffixes[low:todo]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        todo = low
        by_times = {}
        for j, t in times.items():
            by_times.setdefault(t, []).append(j)
        for t in sorted(by_times, reverse=True):
            split = {}  # by group: its end before these suffixes leave it
            for j in by_times[t]:
                g = group[j]
                split.setdefault(g, end[g])
                end[g] -= 1
                a, b = slot[j], end[g]
                other = suffixes[b]
                suffixes[a], suffixes[b] = other, j
                slot[other], slot[j] = a, b
            for g, last in split.items():
                new = end[g]
                for j in suffixes[new:last]:
                    group[j] = new
                end[new], context[new] = last, context[g] + t * length
    return [context[g] for g in group]


def zones(hashes, texts, exponent=LEAST_EXPONENT):
    """Stretches of words, as (low, high), outside of which no run has the exponent.

    In a run of period ``q`` all words but the last ``q`` come again within
    ``q`` words. For each power of two ``b`` the stretches of words that come
    again within ``b`` are taken that are long enough for a period over ``b / 2``.
    """
    n = len(hashes)
    key = mix(hashes + mix(texts.doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    gap = np.full(n, n + 1)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    gap[order[same]] = order[same + 1] - order[same]
    steps = np.zeros(n + 1, np.int64)
    longest = int(texts.counts.max(initial=0))
    b = 1
    while b < 2 * longest:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gap <= b, [0]]).astype(np.int8)))
        low, high = edge[::2], edge[1::2]
        wide = high - low >= (exponent - 1) * (b // 2 + 1)
        low, high = low[wide], high[wide]
        if len(low):
            np.add.at(steps, low, 1)
            np.add.at(steps, np.minimum(high + b, texts.first[1:][texts.doc[low]]), -1)
        b *= 2
    inside = np.cumsum(steps[:-1]) > 0
    # two texts side by side are two zones
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (texts.doc[1:] != texts.doc[:-1])
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | (texts.doc[1:] != texts.doc[:-1])
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def roots(hashes, low, high):
    """Place and length of the Lyndon words of both orders in a zone."""
    _, ranks = np.unique(hashes[low:high], return_inverse=True)
    places = np.arange(low, high)
    for own in (ranks, ranks.max() - ranks):
        yield places, np.array(lyndon_array(own.tolist()), np.int64)


def _common(prefix, a, b, most, back=False):
    """Words in common from ``a`` and ``b`` on, or before them, at most ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        if back:
            equal = prefix(a - half, a) == prefix(b - half, b)
        else:
            equal = prefix(a, a + half) == prefix(b, b + half)
        low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
    return low


def find_runs(texts, least=LEAST_WORDS, exponent=LEAST_EXPONENT):
    """Text, start, length and period of every run, by text, start and period.

    ``exponent`` is at least 2, below which roots do not tell a run.
    """
    if exponent < 2:
        raise ValueError("runs have an exponent of 2 or more")
    none = np.zeros((4, 0), np.int64)
    if not len(texts.start):
        return none
    hashes = texts.words()
    found = [np.stack(r) for low, high in zip(*zones(hashes, texts, exponent), strict=True)
             for r in roots(hashes, low, high)]
    if not found:
        return none
    place, period = np.concatenate(found, axis=1)
    doc = texts.doc[place]
    first, last = texts.first[doc], texts.first[doc + 1]
    again = place + period
    good = again < last
    good[good] = hashes[place[good]] == hashes[again[good]]
    place, period, again = place[good], period[good], again[good]
    doc, first, last = doc[good], first[good], last[good]
    prefix = prefix_hashes(hashes)
    start = place - _common(prefix, place, again, place - first, back=True)
    length = again + _common(prefix, place, again, last - again) - start
    good = length >= np.maximum(least, exponent * period)
    runs = np.unique(np.stack([doc, start, period, length])[:, good], axis=1)
    return np.stack([runs[0], runs[1] - texts.first[runs[0]], runs[3], runs[2]])


def _collapsed(text, runs):
    words = text.split()  # bytes split at ASCII white space only
    if runs.shape[1]:
        steps = np.zeros(len(words) + 1, np.int64)
        _, start, length, period = runs
        np.add.at(steps, start + period, 1)
        np.add.at(steps, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    return b" ".join(words).decode()


def _rows(least, exponent, doc_id):
    def run(batches):
        for batch, data, at in chunks(batches, 1):
            texts = Texts(data, at)
            runs = find_runs(texts, least, exponent)
            bounds = np.searchsorted(runs[0], np.arange(len(texts) + 1))
            whole = data.tobytes()
            kept = [_collapsed(whole[at[d]:at[d + 1]], runs[:, bounds[d]:bounds[d + 1]])
                    for d in range(len(texts))]
            spans = pa.StructArray.from_arrays(
                [pa.array(runs[k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict({
                doc_id: batch.column(0), "n_words": texts.counts,
                "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                "collapsed": pa.array(kept, pa.string())})
    return run


def periodic_runs(docs, least=LEAST_WORDS, exponent=LEAST_EXPONENT, doc_id="doc_id", text="text"):
    """doc_id, n_words, runs and the collapsed text of each row of ``docs``.

    ``runs`` has start (a word number), length and period of each run of at
    least ``least`` words and ``exponent`` periods, by start and period.
    ``collapsed`` joins the words that stay with single spaces: those in no run
    behind its first period. Each row is judged by itself, repeated rows and
    rows without an id too. Null and empty texts have no words and no runs; an
    empty table gives an empty one; other columns are not looked at. Words are
    compared by 64-bit hashes. One narrow stage, memory follows the longest text.
    """
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, F.col(text).alias("__text")).mapInArrow(
        _rows(least, exponent, doc_id),
        f"`{doc_id}` {kind}, n_words long, runs {RUNS}, collapsed string")
