"""Runs of repeated phrases against brute force."""

import random

import pytest

from tollwatch.llm import periods
from tollwatch.llm.words import of_strings


def brute_lyndon(ranks):
    def less(a, b):
        return ranks[a:] < ranks[b:]

    n = len(ranks)
    return [next((j for j in range(i + 1, n) if less(j, i)), n) - i for i in range(n)]


def brute_runs(words, least=6, exponent=4):
    """Every (start, length, period), stretch by stretch of equal words a period apart."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i:i + length]
            smaller = any(all(stretch[k] == stretch[k + p] for k in range(length - p))
                          for p in range(1, q))
            if j > i and length >= max(least, exponent * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    """Words of a small vocabulary with planted repetitions, some broken, some nested."""
    words = [rng.choice("abcd") for _ in range(n)]
    for _ in range(rng.randrange(4)):
        root = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            root = root * 4 + ["z"]
        low = rng.randrange(n + 1)
        words[low:low] = (root * 8)[:rng.randrange(1, 8 * len(root) + 1)]
    return words


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(3)
    for _ in range(600):
        ranks = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(40))]
        assert periods.lyndon_array(ranks) == brute_lyndon(ranks)


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (12, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    texts = [some_words(rng, rng.randrange(60)) for _ in range(60)]
    found = periods.find_runs(of_strings([" ".join(t) for t in texts]), least, exponent)
    ours = [[] for _ in texts]
    for doc, start, length, period in found.T.tolist():
        ours[doc].append((start, length, period))
    assert ours == [brute_runs(t, least, exponent) for t in texts]


def test_exponents_below_two_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs(of_strings(["a"]), 6, 1)


def test_rows_of_all_kinds(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "a  b\na b a b a b x", 0),
            (None, "x x x x x x", 0), (4, "a  b\na b a b a b x", 0), (5, "ä ö " * 5, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
           for r in periods.periodic_runs(docs).collect()]
    four = (4, 9, [(0, 8, 2)], "a b x")
    assert sorted(out, key=repr) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), four, four,
        (None, 6, [(0, 6, 1)], "x"), (5, 10, [(0, 10, 2)], "ä ö")], key=repr)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    """A single text of 200,000 words, one run over nearly all of it."""
    text = "start " + "one two three four five " * 40_000 + "end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periods.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 200_000, 5)]
    assert row.collapsed == "start one two three four five end"
