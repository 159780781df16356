"""Quality rules: fixed limits, then boosted trees over statistics of each text."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F

from tollwatch.llm import samples, trees
from tollwatch.llm.words import Texts, byte_set, chunks, covered, mix, range_hashes, _table

SYMBOLS = byte_set(lambda b: b in b"#*$%&|<>")
FIRST_BYTE = byte_set(lambda b: not 0x80 <= b < 0xC0)
UPPER = byte_set(lambda b: 65 <= b < 91)
LETTER = byte_set(lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 0x80)
DIGIT = byte_set(lambda b: 48 <= b < 58)
END = byte_set(lambda b: b in b".!?")

#: Name and direction of each feature: -1 where more of it can only lower the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1, "upper_share": -1, "digit_share": 0, "end_share": 0,
    "stutter_share": -1, "distinct_share": 0, "exclaim_per_word": -1, "words_per_line": 0,
    "odd_last_share": -1,
}
SIGNS = np.array(list(FEATURES.values()))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines(data, at, words):
    """Start, end and document of each line that has a word."""
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(at[:-1], breaks + 1)
    start = start[start < len(data)]
    doc = np.searchsorted(at, start, side="right") - 1
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    return start[holds], end[holds], doc[holds]


def statistics(data, at, window=8):
    """Base counts and features of some whole texts, as two arrays of one row per text."""
    texts = Texts(data, at)
    n = texts.counts
    tables = _table(1)
    hashes = texts.words()
    start, end, doc = _lines(data, at, texts)
    own = range_hashes(tables[data], start, end) if len(start) else np.zeros(0, np.uint64)
    key = mix(own + mix(doc.astype(np.uint64)))
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    dup_lines = np.bincount(doc[later], minlength=len(texts))
    lines = np.bincount(doc, minlength=len(texts))

    places = texts.window_starts(window)
    key = mix(texts.window_hashes(hashes, places, window) + mix(texts.doc[places].astype(np.uint64)))
    _, inverse, seen = np.unique(key, return_inverse=True, return_counts=True)
    repeat = texts.word_sums(covered(len(hashes), places[seen[inverse] > 1], window))

    length = np.zeros(len(data) + 1, np.int64)
    np.cumsum(FIRST_BYTE[data], out=length[1:])
    chars = texts.word_sums(length[texts.end] - length[texts.start])
    symbols = texts.text_sums(SYMBOLS[data])
    distinct = np.bincount(
        texts.doc[np.unique(mix(hashes + mix(texts.doc.astype(np.uint64))), return_index=True)[1]],
        minlength=len(texts)) if len(hashes) else np.zeros(len(texts), int)
    stutter = np.zeros(len(hashes), bool)
    if len(hashes):
        stutter[1:] = (hashes[1:] == hashes[:-1]) & (texts.doc[1:] == texts.doc[:-1])
    last = data[texts.end - 1] if len(hashes) else np.zeros(0, np.uint8)
    words = np.maximum(n, 1)
    letters = np.maximum(texts.text_sums(LETTER[data]), 1)
    features = np.stack([
        np.log1p(n), chars / words, symbols / words, dup_lines / np.maximum(lines, 1),
        repeat / words, texts.text_sums(UPPER[data]) / letters,
        texts.text_sums(DIGIT[data]) / np.maximum(np.diff(at), 1),
        texts.word_sums(END[last]) / words, texts.word_sums(stutter) / words, distinct / words,
        texts.text_sums(data == ord("!")) / words, n / np.maximum(lines, 1),
        texts.word_sums(~LETTER[last] & ~END[last] & (last != ord(","))) / words], axis=1)
    return np.stack([n, chars, symbols, dup_lines, repeat], axis=1).astype(np.int64), features


def _fit_rows(batches):
    for batch, data, at in chunks(batches, 2):
        counts, features = statistics(data, at)
        frame = pd.DataFrame(features, columns=list(FEATURES))
        frame.insert(0, "label", batch.column(1).to_pandas())
        yield pa.RecordBatch.from_pandas(frame.astype(float), preserve_index=False)


def fit_rules(docs, labels, label="quality", bound=8000, doc_id="doc_id", text="text", **options):
    """Trees fitted to ``label`` on at most ``bound`` labelled documents, held-out fold left out."""
    sample = samples.labelled(docs, labels, label, bound, doc_id, text).select("id", "label", "text")
    schema = ", ".join(f"`{c}` double" for c in ("label", *FEATURES))
    rows = sample.mapInArrow(_fit_rows, schema).toPandas().sort_values(["label", *FEATURES])
    return trees.fit(rows[list(FEATURES)].to_numpy(), rows["label"].to_numpy(), SIGNS, **options)


def judge(docs, model, least_words=20, most_repeats=30, threshold=0.5, doc_id="doc_id",
          text="text"):
    """Counts, base verdict, score and final verdict for each row.

    A row keeps its place even if ids repeat or are null. A text fails the base
    rules with fewer than ``least_words`` words or with more than
    ``most_repeats`` percent of words in windows found twice. Other texts are
    kept if the trees score them at ``threshold`` or more. Null and empty texts
    have no words and fail.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch, data, at in chunks(batches, 1):
            counts, features = statistics(data, at)
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < least_words) | (100 * repeat > most_repeats * n)
            score = model.score(features)
            out = {doc_id: batch.column(0), **dict(zip(COUNTS, counts.T, strict=True))}
            out |= {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}
            yield pa.RecordBatch.from_pydict(out)

    counted = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(doc_id, F.col(text).cast("string").alias("__text")).mapInArrow(
        run, f"`{doc_id}` {kind}, {counted}, base_failed boolean, score double, kept boolean")
