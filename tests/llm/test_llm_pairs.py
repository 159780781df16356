"""Near duplicates, substrings and templates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tollwatch.llm import darts, substrings, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, node string, root long, n long"


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], DOCS)


def shingles(text):
    w = words(text)
    full = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    return collections.Counter(full or [tuple(w)] * bool(w))


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Least id of the class of each row, by all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] == rows[b][1]
            if same or sets[a] and sets[b] and weighted(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], min([x for x in groups[find(i)] if x is not None], default=None),
                    len(groups[find(i)])) for i in range(len(rows))), key=repr)


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        add(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add("  ".join(copy) if rng.random() < 0.3 else " ".join(copy))
    for text in ("", "", " \n", None, None, "one two", "one two", "one  two", "a b c d",
                 "a b c d e", "z " * 400, "z " * 401, "z " * 300):
        add(text)
    rows.append((0, rows[0][1]))
    rows.append((None, rows[1][1]))
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    got = sorted((tuple(r) for r in darts.classes(frame(spark, rows)).collect()), key=repr)
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(1, 2**63, 60, dtype=np.uint64)
    weight = rng.integers(1, 9, 60).astype(float)
    other = np.maximum(weight - rng.integers(0, 3, 60), 0)
    some = other > 0
    sig = darts.signatures(
        2, np.concatenate([np.zeros(60, int), np.ones(some.sum(), int)]),
        np.concatenate([h, h[some]]), np.concatenate([weight, other[some]]), 4096)
    truth = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.03
    assert (darts.signatures(1, np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 8) == 0).all()


def test_keep_one_of_each_class(spark):
    rows = near_rows()
    df = frame(spark, rows)
    kept = darts.keep_one(df)
    assert kept.columns == df.columns
    worded = [r for r in brute_classes([r for r in rows if words(r[1])])]
    blank = [r[0] for r in rows if not words(r[1])]
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted({c for _, c, _ in worded} | set(blank), key=repr)


def test_no_rows_make_no_classes(spark):
    assert darts.classes(frame(spark, [])).count() == 0
    assert darts.keep_one(frame(spark, [])).count() == 0


def test_a_chain_of_links_is_one_class(spark):
    a = [f"c{i}" for i in range(120)]
    rows = []
    for step in range(12):
        text = list(a)
        text[:step * 8] = [f"d{i}" for i in range(step * 8)]
        rows.append((step, " ".join(text)))
    got = sorted((tuple(r) for r in darts.classes(frame(spark, rows)).collect()), key=repr)
    assert got == brute_classes(rows)


def brute_substrings(rows, size):
    texts = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


def substring_rows():
    rng = random.Random(9)
    vocabulary = [f"ü{i}" for i in range(90)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (22, 34, 35, 36, 50, 80)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 45))]
            if rng.random() < 0.6:
                text += rng.choice(passages)
        rows.append((i, rng.choice(["\t", " \n"]).join(text)))
    return [*rows, (0, rows[0][1]), (None, rows[5][1]), (61, None), (62, ""), (63, "x " * 80),
            (64, "y " * 35), (65, "y " * 34)]


@pytest.mark.parametrize("size", [35, 30])
@pytest.mark.parametrize("use_filter", [True, False])
def test_substrings_equal_brute_force(spark, size, use_filter):
    rows = substring_rows()
    got = substrings.dedup_substrings(frame(spark, rows), size, use_filter=use_filter).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_substrings(rows, size)


def test_substrings_of_nothing(spark):
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(frame(spark, []), 21)


def test_cover_holds_all_differences():
    assert substrings.is_difference_cover(substrings.PERIOD, substrings.COVER)


QUESTION = ("A train leaves the town of Berlin at 9 in the morning and travels 120 km before it"
            " meets Anna Schmidt who walked 3.5 hours to see it pass")


def leaks(spark, texts, items=(QUESTION,), **options):
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)],
                                  "item_id long, text string, covered int")
    found = templates.leaks(frame(spark, list(enumerate(texts))), bench, **options)
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_other_values_are_caught(spark):
    changed = QUESTION.replace("Berlin", "Paris").replace("120", "1,250").replace(
        "Anna Schmidt", "Bo").replace("3.5", "seven")
    found = leaks(spark, ["Before it. " + QUESTION + ". After", "x " * 500 + "\n" + changed,
                          "Nothing of the kind is here at all", "", None])
    assert sorted(found) == [(0, 0), (1, 0)]
    assert found[0, 0].covered == 1 and found[0, 0].n_changed == 0
    assert found[1, 0].n_changed >= 3


def test_inconsistent_slots_are_no_match(spark):
    item = "take 4 apples and put 4 apples into 7 boxes so that 4 apples are in each of 7 boxes"
    good = item.replace("4", "6").replace("7", "9")
    bad = "take 1 apples and put 2 apples into 3 boxes so that 5 apples are in each of 8 boxes"
    assert sorted(leaks(spark, [good, bad], [item])) == [(0, 0)]


def test_copies_of_items_of_few_literals_are_caught(spark):
    item = "Compute 12 + 35 * 4 - 7"
    names = "Tell me whether Anna Schmidt, Bob Brown, Carl Cole, Dora Dunn, Emil Eck or Fay Fox won"
    found = leaks(spark, ["so: Compute 12 + 35 * 4 - 7 = 145", "Compute 12 + 35 * 4 - 8",
                          "we ask. " + names], [item, names])
    assert sorted(found) == [(0, 0), (2, 1)]
    assert found[0, 0].covered == 1 and found[2, 1].n_changed == 0


def test_a_conflict_drops_only_its_windows(spark):
    item = ("take 5 red apples from the old tree by the river and then walk slowly all the way back"
            " home where your mother puts 5 more into the basket before you all sit down to eat")
    other = item.replace("5", "3", 1)
    found = leaks(spark, [item.replace("5 more", "7 more"), other.replace("3", "4").replace(
        "5", "4")], [item, other])
    assert sorted(found) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert found[0, 0].covered < 1 and found[0, 0].n_changed == 0


def test_a_run_of_a_long_item_is_a_leak(spark):
    item = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)).split()
    texts = [" ".join(["say", *item[50:50 + n], "end"]) for n in (12, 13, 60)]
    texts.append(" ".join([*item[:9], "x", *item[20:29]]))  # 18 tokens, but not in a row
    found = leaks(spark, texts, [" ".join(item)])
    assert sorted(found) == [(1, 0), (2, 0)] and found[1, 0].n_tokens == 13
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in templates.decontaminate(
        frame(spark, list(enumerate(texts))), bench).collect()) == [0, 3]


def test_short_and_empty_items(spark):
    found = leaks(spark, ["say blue whale now", "other", "9 9 9 9"], ["blue whale", "", None, "1 2 3"])
    assert sorted(found) == [(0, 0)]
    assert leaks(spark, ["some text"], []) == {}
    assert leaks(spark, []) == {}


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    df = frame(spark, [(1, QUESTION), (2, "clean"), (None, None), (2, "clean")])
    kept = templates.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(2, "clean"), (2, "clean"), (None, None)], key=repr)


def test_windows_joined_without_a_bitmap_give_the_same(spark, monkeypatch):
    items = [QUESTION, *[f"item {'abc'[i]} has its own words here and there {i}" for i in range(3)]]
    texts = [QUESTION, items[1], "and " + items[2], QUESTION, "nothing of it"]
    whole = leaks(spark, texts, items)
    monkeypatch.setattr(templates, "_filter", lambda windows: None)
    assert leaks(spark, texts, items) == whole and len(whole) >= 4


def test_leaks_equal_every_text_against_every_item(spark):
    """The join finds the pairs that the comparison of all texts with all items does."""
    rng = random.Random(6)
    words = [f"word{chr(97 + k)}" for k in range(26)] + ["Anna Schmidt", "12", "3.5 km", "seven"]
    items = [" ".join(rng.choices(words, k=rng.choice((2, 5, 12, 30)))) for _ in range(25)]
    texts = []
    for _ in range(60):
        low = rng.randrange(20)
        item = rng.choice(items).split()
        texts.append(" ".join([*rng.choices(words, k=9), *item[low:low + 20], *item[:9],
                               *rng.choices(words, k=5)]))
    index = templates.Index(list(range(len(items))), items)
    want = templates.pd.concat(index.leaks(*templates.raw(
        templates.pa.array(texts, templates.pa.large_string())), 0.3))
    found = leaks(spark, texts, items)
    assert sorted(found) == sorted(zip(want["doc"], want["item"], strict=True)) and len(found) > 40
    for r in want.itertuples():
        got = found[r.doc, r.item]
        assert (got.n_tokens, got.n_slots, got.n_changed) == (r.n_tokens, r.n_slots, r.n_changed)


def test_short_items_take_no_document_away(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "of the old house")], "item_id long, text string")
    df = frame(spark, [(1, "the cat"), (2, "roof of the old house"), (3, None), (4, "")])
    df = df.withColumn("leaking", templates.F.lit(1))
    assert sorted(r.doc_id for r in templates.decontaminate(df, bench).collect()) == [1, 3, 4]
    assert templates.decontaminate(df, bench.limit(0)).count() == 4
    assert templates.decontaminate(df.limit(0), bench).count() == 0


def test_a_very_long_text_is_searched_whole(spark):
    long = " ".join(f"x{k}" for k in range(80_000)) + " " + QUESTION
    assert list(leaks(spark, [long], [QUESTION])) == [(0, 0)]


def test_parts_of_hot_windows_are_bounded_and_give_the_same(spark, monkeypatch):
    words = "red green blue".split()
    items = [QUESTION.replace("120", str(k)).replace("town", words[k % 3]) for k in range(300)]
    texts = [QUESTION, "x " + items[7], "none of it", "", items[8] + " and " + items[9], None]
    whole = leaks(spark, texts, items)
    assert len(whole) == 900
    index = templates.Index(list(range(300)), items)
    docs = templates.Templates(*templates.raw(templates.pa.array(texts, templates.pa.large_string())))
    monkeypatch.setattr(templates, "PLACES", 2000)
    parts = list(index.parts(docs))
    assert len(parts) > 10
    assert all(sum(int(w[2].sum()) for w in part) <= 2000 for part in parts)
    found = templates.pd.concat(index.leaks(*templates.raw(
        templates.pa.array(texts, templates.pa.large_string())), 0.3))
    assert {(r.doc, r.item): (r.n_tokens, r.covered, r.n_slots, r.n_changed)
            for r in found.itertuples()} == {
        k: (r.n_tokens, r.covered, r.n_slots, r.n_changed) for k, r in whole.items()}
