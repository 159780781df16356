"""Mixing, URLs, quality rules, token files, pseudonyms, classifier and license scans."""

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollwatch.llm import (
    attention, licenses, mixing, pseudonyms, rules, samples, tokens, trees, urls,
)
from tollwatch.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, copy int, score int, spans int, host string"


def frame(spark, rows):
    rows = [(i, t, s if len(rest) else "a", 1, 2, 3, "h")
            for i, t, *rest in rows for s in [rest[0] if rest else "a"]]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id here"), (4, "x" * 300_000),
       (5, "word " * 20_000), (4, "x" * 300_000), (6, "\u00e9\u4e16 \U0001f600 <|endoftext|>")]


# mixing

def test_mixing_meets_target_weights(spark):
    rows = [(i, "t" * 99, "abc"[min(i % 10, 2)]) for i in range(6000)]
    mixed = mixing.mix_sources(frame(spark, rows), {"a": 0.5, "b": 0.3}, 0.2)
    got = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["a"] / 3000 - 1) < 0.06 and abs(got["b"] / 1800 - 1) < 0.08
    assert abs(got["c"] / 1200 - 1) < 0.1
    assert mixed.columns == ["doc_id", "text", "source", "score", "spans", "host", "copy",
                             "shuffle_key"]


def test_counts_are_poisson_and_stable(spark):
    rows = [(i, "t", "a") for i in range(4000)] + [(9000, "t", "b")]
    df = frame(spark, rows)
    once = mixing.mix_sources(df, {"a": 0.75, "b": 0.25}, size=2.0)
    again = mixing.mix_sources(df.repartition(7), {"a": 0.75, "b": 0.25}, size=2.0)
    key = sorted(tuple(r) for r in once.select("doc_id", "copy").collect())
    assert key == sorted(tuple(r) for r in again.select("doc_id", "copy").collect())
    counts = collections.Counter(i for i, _ in key)
    mean = 0.75 * 4001 * 2 / 4000
    share = sum(counts[i] == 0 for i in range(4000)) / 4000
    assert abs(share - math.exp(-mean)) < 0.03
    assert abs(counts[9000] - 0.25 * 4001 * 2) < 250  # one document, many draws


def test_mixing_odd_rows(spark):
    df = frame(spark, [(*r, None if r[0] == 2 else "a") for r in ODD])
    got = mixing.mix_sources(df, {"a": 1.0}, 1e-4, size=10.0)
    counts = collections.Counter(r.doc_id for r in got.select("doc_id").collect())
    assert counts[4] % 2 == 0 and counts[2] > 0
    assert mixing.mix_sources(df.limit(0), {"a": 1.0}).count() == 0


# URLs

def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.COM:80/x?y#z": ("a.example.com:80", "/x", None),
        "https://example.com/en/1": ("example.com", "/en/1", "example.com/en/"),
        "https://blog.example.com/en/1": ("blog.example.com", "/en/1", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/"),
        "ftp://other.com/": ("other.com", "/", "com/"), "http://other.com": ("other.com", "", None),
        "http://notcom/": ("notcom", "/", None), "http://a.net/es/q": ("a.net", "/es/q", "net/es/"),
        "http://a.net/esq": ("a.net", "/esq", None), "x://h/p://q/r": ("h", "/p://q/r", None),
        "http:/broken.com/": ("", "", None), "": ("", "", None), None: ("", "", None),
        "a?b://c.com/d": ("c.com", "/d", "com/"), "http://\u00c4.com/": ("\u00c4.com", "/", "com/"),
    }
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(cases)],
                               "page_id long, url string, host string")
    got = urls.judge_urls(df, urls.fit_urls(df)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == list(cases.values())
    verdicts = {f"{h}{p}": v for v, h, p in urls.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)


def test_url_trees_learn(spark):
    rows = [(i, f"http://s{i % 7}.{'net' if i % 2 else 'com'}/{'es' if i % 2 else 'go'}/{i}"
             + ("?a=1&b=2&c=3" if i % 2 else "")) for i in range(400)]
    rows += [(1000, "http://q.org/go/5"), (1001, "http://q.org/es/7?a=1&b=2&c=3")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(df, urls.fit_urls(df)).collect()}
    assert got[1000].score > got[1001].score
    assert (got[1000].verdict, got[1001].verdict) == ("allow", "block")
    assert urls.judge_urls(df.limit(0), urls.fit_urls(df.limit(0))).count() == 0


# quality rules

def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeat = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            repeat.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeat))


def rule_rows():
    rng = random.Random(2)
    return [(i, "".join(rng.choice(["a", "b", "\u00e9", "#", "|", " ", " ", "\n", "\r\n", "c d"])
                        for _ in range(rng.randint(0, 200)))) for i in range(80)]


def test_rule_counts_equal_brute_force(spark):
    rows = rule_rows() + ODD + [(200, "a " * 9), (201, "a\na\n a\na")]
    model = trees.fit(np.zeros((0, len(rules.FEATURES))), [])
    got = rules.judge(frame(spark, rows), model).collect()
    want = collections.Counter((i, *brute_counts(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, *(r[c] for c in rules.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= 0.5)
    assert rules.judge(frame(spark, []), model).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(int)
    model = trees.fit(x, y, [1, -1, 0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    line = np.linspace(0, 1, 50)
    for at in rng.random((20, 3)):
        grid = np.repeat(at[None], 50, axis=0)
        up, down = grid.copy(), grid.copy()
        up[:, 0], down[:, 1] = line, line
        assert (np.diff(model.score(up)) >= -1e-12).all()
        assert (np.diff(model.score(down)) <= 1e-12).all()
    assert abs(trees.fit(x[:4], [1, 1, 1, 1]).score(x[:1])[0] - 0.9) < 1e-9
    assert trees.fit(x[:0], []).score(x[:2]).tolist() == [0.5, 0.5]


def labelled(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
                 for _ in range(rng.randint(25, 200))]
        if i % 3 == 0:
            cut = rng.randrange(len(words) // 2)
            words[cut:] = [w.upper() + "!!" for w in words[cut:]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 != 0), None))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fold_is_crc32_of_the_id(spark):
    ids = spark.range(200).select("id", samples.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in ids)


def test_fit_leaves_out_the_held_out_fold(spark):
    docs, labels = labelled(spark, 60)
    got = samples.labelled(docs, labels, "quality", 30).collect()
    assert len(got) == 30 and all(zlib.crc32(str(r.id).encode()) % 4 != 2 for r in got)


@pytest.mark.parametrize("kind", ["rules", "attention"])
def test_held_out_accuracy(spark, kind):
    docs, labels = labelled(spark)
    if kind == "rules":
        scored = rules.judge(docs, rules.fit_rules(docs, labels), most_repeats=100)
    else:
        scored = attention.score_quality(docs, attention.fit_quality(docs, labels))
    out = scored.join(labels, "doc_id").where(samples.fold(F.col("doc_id")) == 2).collect()
    assert len(out) > 60
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in out) / len(out) > 0.95


def test_attention_gradients():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, attention.WIDTH)).astype(np.float64)
    first, y, weight = np.array([0, 2, 3, 9]), np.array([1.0, 0, 1]), np.array([0.2, 0.5, 0.3])
    model = attention.fit(x, first, y, width=4, steps=3)
    model.weights = {k: np.asarray(v, float) for k, v in model.weights.items()}

    def loss():
        logit = model.forward(x, first)[-1]
        return (weight * (np.logaddexp(0, logit) - y * logit)).sum()

    grads = model.gradients(x, first, y, weight)
    for name, at in (("E", (3, 1)), ("V", (0, 2)), ("U", (1, 1)), ("a", (2,)), ("c", (0,))):
        held = model.weights[name][at]
        model.weights[name][at] = held + 1e-5
        up = loss()
        model.weights[name][at] = held - 1e-5
        down = loss()
        model.weights[name][at] = held
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_scores_do_not_depend_on_neighbours(spark):
    docs, labels = labelled(spark, 80)
    model = attention.fit_quality(docs, labels, steps=20)
    odd = frame(spark, ODD)
    both = attention.score_quality(odd.union(docs).coalesce(1), model).collect()
    alone = attention.score_quality(odd.repartition(5), model).collect()
    key = {(r.doc_id, round(r.score, 5)) for r in both}
    assert len(alone) == len(ODD) and {(r.doc_id, round(r.score, 5)) for r in alone} <= key
    kept = attention.reject_low_quality(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.predicted for r in alone)
    assert attention.score_quality(odd.limit(0), model).count() == 0
    empty = attention.fit_quality(docs, labels.limit(0))
    assert {r.score for r in attention.score_quality(odd, empty).collect()} == {0.5}


# token files

def brute_tokens(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, path):
    rows = rule_rows() + [r for r in ODD if r[0] not in (None, 1, 2, 3, 4, 5, 6)]
    rows += [(300, None), (301, ""), (302, "  two  spaces \n\u00a0\u2003x "),
             (303, "it's <|endoftext|>we'll \u4e16\u754c 12ab"), (304, "word " * 5000)]
    folder = tokens.write_tokens(frame(spark, rows).repartition(5), tokenizer_path(), path("t"))
    got = [tuple(r) for r in tokens.read_tokens(spark, folder).orderBy("start").collect()]
    assert got == brute_tokens(sorted(rows))
    with open(f"{folder}/index.json") as f:
        index = json.load(f)
    assert index["n_docs"] == len(rows) and index["n_ids"] == sum(r[2] for r in got)
    ids, at, docs = tokens.open_part(folder, index["parts"][0]["part"], index["dtype"])
    assert len(ids) == at[-1] and len(docs) == len(at) - 1


def test_tokens_of_null_and_repeated_ids(spark, path):
    rows = [(None, "a b"), (7, "c"), (7, "c"), (7, "d e f"), (1, "z")]
    folder = tokens.write_tokens(frame(spark, rows), tokenizer_path(), path("t"))
    got = tokens.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 7, 7, 7]
    assert sorted(r.ids_crc32 for r in got) == sorted(r[3] for r in brute_tokens(rows))
    empty = tokens.write_tokens(frame(spark, []), tokenizer_path(), path("e"))
    assert tokens.read_tokens(spark, empty).count() == 0


def test_only_mounted_folders():
    assert tokens.mounted("file:///a/b") == "/a/b" and tokens.mounted("/a:b") == "/a:b"
    with pytest.raises(ValueError):
        tokens.mounted("hdfs://x/y")


# pseudonyms

def pseudonymized(spark, texts, key="k"):
    df = frame(spark, list(enumerate(texts)))
    out = pseudonyms.pseudonymize(df, key)
    return {r.doc_id: r for r in out.collect()}


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_formats_are_kept_and_values_linked(spark):
    texts = ["mail bob.smith7@mail.example.com now", "from bob.smith7@mail.example.com",
             "ip 81.117.173.241, 8.8.8.8.", "card 4190609732687108 or 4190-6097-3268-7108",
             "call +1 (829) 555-4386 or 829-555-4386", "on 1980-02-29 or 02/29/1980", "id 123-45-6789"]
    got = pseudonymized(spark, texts)
    for i, text in enumerate(texts):
        assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", got[i].text)) == \
            re.sub("[a-z]", "a", re.sub("[0-9]", "9", text)) or "ip" in text
        assert got[i].text != text and sum(got[i].pii.values()) >= 1
    mails = [re.search(r"\S+@\S+", got[i].text)[0] for i in (0, 1)]
    assert mails[0] == mails[1] and mails[0].endswith("@mail.example.com")
    cards = re.findall(r"[\d-]{13,}", got[3].text)
    assert all(map(luhn, cards)) and cards[0] == cards[1].replace("-", "")
    dates = re.findall(r"[\d/-]{10}", got[5].text)
    assert dates[0] == "{2}-{0}-{1}".format(*dates[1].split("/"))
    assert all(int(n) < 256 for n in re.findall(r"\d+", got[2].text))
    assert pseudonymized(spark, texts, "other")[3].text != got[3].text


def test_invalid_values_and_odd_texts_stay(spark):
    texts = ["card 4190609732687109", "ip 300.1.1.1 and 1.2.3.4.5", "on 1981-02-29", "on 1800-01-01",
             "v 4.0. in 2024", "password=e3b3ed3cc8548923d6", "", None, "@ @x a@b", "1" * 5000,
             "a" * 200_000, "id 000-12-3456"]
    got = pseudonymized(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts
    assert all(r.pii == {} for r in got.values())
    assert pseudonymized(spark, []) == {}
    with pytest.raises(ValueError):
        pseudonymized(spark, ["x"], "")


def test_cards_beside_other_digits_and_wider_phones(spark):
    card = "4111 1111 1111 1111"
    texts = [f"card {card} 12/26", "4111111111111111 123", f"order 1234 {card}",
             f"{card} 4190-6097-3268-7108 7", "call (555)123-4567", "call 5551234567.",
             "call +33 1 23 45 67 89", "to 4190609732687109@mail.example.com", f"12 5551234567 {card}",
             "1 4190609732687108@mail.example.com", f"{card} 2024-02-29", card]
    got = pseudonymized(spark, texts)
    kinds = [{"card": 1}] * 3 + [{"card": 2}] + [{"phone": 1}] * 3 + [{"email": 1}] + [
        {"phone": 1, "card": 1}, {"email": 1}, {"card": 1, "date": 1}, {"card": 1}]
    assert [got[i].pii for i in range(len(texts))] == kinds
    new = got[11].text
    assert luhn(new) and new != card
    for i in (0, 2, 8, 10):
        assert new in got[i].text and card not in got[i].text
    assert got[0].text == f"card {new} 12/26" and got[2].text == f"order 1234 {new}"
    assert got[1].text == new.replace(" ", "") + " 123" and got[3].text.endswith(" 7")
    assert got[6].text.startswith("call +33 ") and got[6].text != texts[6]
    for text, row in zip(texts, (got[i] for i in range(len(texts)))):
        assert re.sub("[0-9]", "9", row.text) == re.sub("[0-9]", "9", text)
    hidden = ["sha 0ab5551234567cd", "t 1700000000", "0.5551234567"]
    assert [pseudonymized(spark, hidden)[i].text for i in range(3)] == hidden


def test_the_network_is_a_permutation(spark):
    made = spark.range(10_000).select(
        pseudonyms.permuted_digits("k", F.lit("t"), F.lpad("id", 4, "0")).alias("a"),
        pseudonyms.permuted_digits("k", F.lit("t"), F.lpad("id", 5, "0")).alias("b"))
    row = made.agg(F.countDistinct("a"), F.countDistinct("b"), F.min(F.length("a")),
                   F.max(F.length("a"))).first()
    assert tuple(row) == (10_000, 10_000, 4, 4)


def test_pseudonyms_run_no_python(spark):
    plan = pseudonyms.pseudonymize(frame(spark, ODD), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# license scans

def brute_base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def license_rows():
    rng = random.Random(8)
    parts = ["mit", "license", "MIT License", "apache", "general public", "the", "-", "\n", "\u00e9",
             "Licensed under the Apache License, Version 2.0", "of this software and"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return rows + ODD


def test_base_phrases_equal_brute_force(spark):
    rows = license_rows()
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    want = collections.Counter((i, *brute_base(t)) for i, t in rows)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    automaton = licenses.Automaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(60):
        text = [rng.randrange(5) for _ in range(40)]
        longest = [max((n for n in range(1, i + 2) if tuple(text[i - n + 1:i + 1]) in inside), default=0)
                   for i in range(40)]
        want = [(i, longest[i]) for i in range(40) if longest[i] >= 3
                and (i == 39 or longest[i + 1] != longest[i] + 1)]
        runs = automaton.runs(text, 3)
        assert [(end, length) for end, length, _ in runs] == want
        for end, length, state in runs:
            ends = {(k, j) for k, s in enumerate(sequences) for j in range(len(s))
                    if s[j - length + 1:j + 1] == text[end - length + 1:end + 1] and j >= length - 1}
            assert automaton.ends[state] == ends


def test_chains_bridge_changed_words(spark):
    label, template = licenses.TEMPLATES[0]
    words = template.split()
    words[20:22] = ["CHANGED"]
    text = "intro words " + " ".join(words) + " and the tail"
    got = licenses.scan_licenses(frame(spark, [(1, text), (2, "no grant of rights here")])).collect()
    spans = {s.label: s for s in got[0].spans}
    assert label in got[0].labels.split(",") and spans[label].covered > 0.9
    assert spans[label].first_word == 2
    assert got[1].labels == "" and got[1].score == 0


def test_each_occurrence_of_a_license_has_a_span(spark):
    label, template = licenses.TEMPLATES[0]
    n = len(re.findall("[A-Za-z0-9]+", template))
    for between in ("", "code " * 100):
        text = f" {between} ".join(["intro", *[template] * 5])
        got = licenses.scan_licenses(frame(spark, [(1, text)])).first()
        spans = sorted((s.first_word, s.end_word) for s in got.spans if s.label == label)
        step = n + len(between.split())
        first = 1 + len(between.split())
        assert spans == [(first + k * step, first + k * step + n) for k in range(5)]
        assert got.score == 1 and got.labels.split(",").count(label) == 1


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["key", "group", "rate", "own", "n", "row", "__key", "__group", "__rate", "__n"]
    docs = spark.createDataFrame([(k, f"text {k}", "src0", *range(10)) for k in range(20)],
                                 ["doc_id", "text", "source", *names])
    out = mixing.mix_sources(docs, {"src0": 1.0}, size=2.0)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    assert out.count() > 10 and out.where("key = 0 and __n = 9").count() == out.count()
