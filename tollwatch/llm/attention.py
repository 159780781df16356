"""Quality classifier: attention over the passages of a text, learned from document labels.

A text is a bag of passages of some words. Each passage is encoded, gated
attention weighs the encoded passages of a text, and the weighted sum is
scored. Only documents carry labels; the weights of the passages are learned.
The fit runs on the driver on a bounded sample, scoring on whole texts in tasks.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Window

from tollwatch.llm import samples
from tollwatch.llm.words import Texts, chunks, mix

PASSAGE_WORDS = 64
#: Bytes of text whose passages are held at once; features take some ten times as much.
CHUNK = 1 << 19
WORD_BUCKETS = 128


def _classes():
    """Kind of each byte: letters, capitals, digits, space, break, common marks, the rest."""
    kinds = np.full(256, 11)
    kinds[97:123] = kinds[128:] = 0
    kinds[65:91] = 1
    kinds[48:58] = 2
    for kind, marks in enumerate((b" ", b"\n", b".", b",", b"!", b"|", b"#$%&*", b"?;:'\"()-"), 3):
        kinds[list(marks)] = kind
    return kinds


CLASSES = _classes()
KINDS = 12
STATS = 6
WIDTH = KINDS * KINDS + WORD_BUCKETS + STATS


def passages(data, at, size=PASSAGE_WORDS):
    """Features of all passages of some texts, and the first passage of each text.

    A text without words is one passage of zeros.
    """
    texts = Texts(data, at)
    number = np.maximum(-(-texts.counts // size), 1)
    first = np.concatenate([[0], np.cumsum(number)])
    total = int(first[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if not len(texts.start):
        return x, first
    hashes = texts.words()
    within = np.arange(len(hashes)) - texts.first[:-1][texts.doc]
    owner = first[:-1][texts.doc] + within // size
    words = np.bincount(owner, minlength=total).astype(float)
    heads = np.flatnonzero(within % size == 0)
    filled, low = owner[heads], texts.start[heads]
    tails = np.append(heads[1:], len(hashes)) - 1
    high = texts.end[tails]
    length = high - low
    place = np.arange(length.sum()) + np.repeat(low - (np.cumsum(length) - length), length)
    byte_owner = np.repeat(filled, length)
    kind = CLASSES[data[place]]
    follows = byte_owner[1:] == byte_owner[:-1]
    pair = (byte_owner[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
    counts = np.bincount(pair[follows], minlength=total * KINDS * KINDS)
    size_of = np.zeros(total)
    size_of[filled] = length
    at_least_one = np.maximum(size_of, 1)[:, None]
    x[:, :KINDS * KINDS] = np.sqrt(counts.reshape(total, -1) / at_least_one)
    bucket = owner * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    x[:, KINDS * KINDS:-STATS] = np.sqrt(
        np.bincount(bucket, minlength=total * WORD_BUCKETS).reshape(total, -1)
        / np.maximum(words, 1)[:, None])
    distinct = np.bincount(
        owner[np.unique(mix(hashes + mix(owner.astype(np.uint64))), return_index=True)[1]],
        minlength=total)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    some = np.maximum(words, 1)
    x[:, -STATS:] = np.stack([
        np.log1p(words), distinct / some, np.bincount(owner[same], minlength=total) / some,
        size_of / some / 8, np.log1p(np.repeat(texts.counts, number)),
        np.repeat(texts.counts == 0, number)], axis=1)
    return x, first


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """Weights of encoder, gated attention and scorer."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def forward(self, x, first):
        w = self.weights
        x = (x - self.mean) / self.scale
        z = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(z @ w["V"]), _sigmoid(z @ w["U"])
        raw = (v * u) @ w["a"]
        low = first[:-1]
        n = np.diff(first)
        power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, low), n))
        alpha = power / np.repeat(np.add.reduceat(power, low), n)
        pooled = np.add.reduceat(z * alpha[:, None], low, axis=0)
        return x, z, v, u, alpha, pooled, pooled @ w["c"] + w["d"]

    def score(self, x, first):
        """Probability of label 1 for each text."""
        if len(first) < 2:
            return np.zeros(0)
        return _sigmoid(self.forward(x, first)[-1]).astype(float)

    def gradients(self, x, first, y, weight):
        w = self.weights
        x, z, v, u, alpha, pooled, logit = self.forward(x, first)
        n, low = np.diff(first), first[:-1]
        d_logit = (_sigmoid(logit) - y) * weight
        d_pooled = np.repeat(d_logit[:, None] * w["c"], n, axis=0)
        d_alpha = (d_pooled * z).sum(axis=1)
        mean = np.repeat(np.add.reduceat(alpha * d_alpha, low), n)
        d_raw = alpha * (d_alpha - mean)
        d_gate = d_raw[:, None] * w["a"]
        d_v, d_u = d_gate * u * (1 - v * v), d_gate * v * u * (1 - u)
        d_z = (d_pooled * alpha[:, None] + d_v @ w["V"].T + d_u @ w["U"].T) * (1 - z * z)
        return {"E": x.T @ d_z, "e": d_z.sum(axis=0), "V": z.T @ d_v, "U": z.T @ d_u,
                "a": (v * u * d_raw[:, None]).sum(axis=0), "c": pooled.T @ d_logit,
                "d": d_logit.sum()}


def fit(x, first, y, width=16, steps=200, rate=0.02, decay=1e-3, seed=7):
    """Fit by Adam on whole bags; both labels weigh the same in sum.

    Without both labels the score is one share for every text.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH, np.float32)
    scale = x.std(axis=0) + 0.02 if len(x) else np.ones(WIDTH, np.float32)
    w = {"E": rng.normal(0, WIDTH ** -0.5, (WIDTH, width)), "e": np.zeros(width),
         "V": rng.normal(0, 0.3, (width, width)), "U": rng.normal(0, 0.3, (width, width)),
         "a": np.zeros(width), "c": rng.normal(0, 0.3, width), "d": 0.0}
    model = Model(mean, scale, {k: np.asarray(v, np.float32) for k, v in w.items()})
    positive = float(y.sum())
    if not 0 < positive < len(y):
        share = (positive + 0.5) / (len(y) + 1)
        model.weights["c"][:] = 0
        model.weights["d"] = np.float32(np.log(share / (1 - share)))
        return model
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (len(y) - positive)).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    s = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for t in range(1, steps + 1):
        for k, g in model.gradients(x, first, y, weight).items():
            g = g + decay * model.weights[k] * (k != "d")
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            step = m[k] / (1 - 0.9 ** t) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
            model.weights[k] = (model.weights[k] - rate * step).astype(np.float32)
    return model


def _bags(batches):
    for batch, data, at in chunks(batches, 2, CHUNK):
        x, first = passages(data, at)
        yield pa.RecordBatch.from_pydict({
            "id": batch.column(0), "label": batch.column(1),
            "bag": [x[a:b].astype("<f4").tobytes() for a, b in itertools.pairwise(first.tolist())]})


def fit_sample(docs, labels, label="quality", bound=3000, passages_bound=40_000, doc_id="doc_id",
               text="text"):
    """Labelled whole documents for a fit: at most ``bound``, and at most ``passages_bound`` passages.

    Documents are taken in the order of a hash of their ids, as long as the sum
    of their passages allows; a document is taken whole or not at all.
    """
    sample = samples.labelled(docs, labels, label, bound, doc_id, text)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    number = F.greatest(F.ceil(words / PASSAGE_WORDS), F.lit(1))
    # one task, of at most ``bound`` ids and numbers
    before = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    taken = sample.select("id", number.alias("n")).withColumn("total", F.sum("n").over(before))
    taken = taken.where(F.col("total") <= passages_bound).select("id")
    return sample.join(F.broadcast(taken), "id")


def fit_quality(docs, labels, label="quality", bound=3000, passages_bound=40_000,
                doc_id="doc_id", text="text", **options):
    """Model fitted on a bounded sample of labelled documents, none of the held-out fold.

    The bounds are on documents and on their passages in all, see ``fit_sample``;
    every passage of a sampled document takes part. Inputs are the texts; no
    other column is looked at.
    """
    sample = fit_sample(docs, labels, label, bound, passages_bound, doc_id, text).select(
        F.col("id").cast("string").alias("id"), "label", "text")
    rows = sample.mapInArrow(_bags, "id string, label int, bag binary")
    rows = rows.toPandas().sort_values("id")
    bags = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in rows.pop("bag")]
    sizes, y = [len(b) for b in bags], rows["label"].to_numpy()
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    del bags
    return fit(x, np.cumsum([0, *sizes]), y, **options)


def score_quality(docs, model, threshold=0.7, doc_id="doc_id", text="text", keep=()):
    """doc_id, the columns ``keep``, score and predicted for each row, ids repeated or null too.

    Null and empty texts are scored as one passage without words.
    """
    kinds = dict(docs.dtypes)
    kept = [doc_id, *keep]

    def run(batches):
        for batch, data, at in chunks(batches, len(kept), CHUNK):
            score = model.score(*passages(data, at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(
        run, f"{schema}, score double, predicted int")


def reject_low_quality(docs, model, threshold=0.7, text="text"):
    """``docs`` without the rows that the classifier rejects, columns unchanged.

    Null and empty texts are scored as one passage without words; repeated rows
    share their fate; an empty table stays empty.
    """
    def run(batches):
        place = names.index(text)
        for batch, data, at in chunks(batches, place, CHUNK):
            passed = model.score(*passages(data, at)) >= threshold
            yield batch.filter(pa.array(passed))

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
