"""Repair of conversations against exhaustive search and plain Python."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tollwatch.llm import conversations as conv
from tollwatch.llm import queries

SMALL = "/root/testdata/sf0.001"
LEGAL = re.compile("(s?(ua)+)?")


def brute_repair(rows):
    """Cheapest (cost, audit, messages) of rows (role, text, fault), by plain recursion."""
    ends = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(k, state, inserts):
        out = []
        if k == len(rows):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            role, text, fault = rows[k]
            cost, audit, rest = best(k + 1, state, 0)
            out.append((cost + 2, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                new = ends[state]
                name = {"u": "user", "a": "assistant"}[new]
                cost, audit, rest = best(k + 1, new, 0)
                out.append((cost + 1 + more, "R" + audit, ((name, text), *rest)))
                if role[:1] == new or role[:1] == "s" and state == "":
                    cost, audit, rest = best(k + 1, role[:1], 0)
                    out.append((cost + more, "K" + audit, ((role, text), *rest)))
        if inserts < 3:
            new = ends[state]
            cost, audit, rest = best(k, new, inserts + 1)
            out.append((cost + 5, "I" + audit, (({"u": "user", "a": "assistant"}[new], ""), *rest)))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    return best(0, "", 0)


def plain_summary(rows):
    """The summary of one conversation's rows (turn, role, text), sorted."""
    seen, faulty, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, messages = brute_repair(tuple(faulty))
    assert LEGAL.fullmatch("".join(r[0] for r, _ in messages))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest)


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    texts = ["Yes.", "No!", "so", "", " \n", "Well?", "a b", "x. "]
    return [(rng.choice((None, rng.randrange(n + 2), rng.randrange(n + 2))), rng.choice(roles),
             rng.choice(texts) + rng.choice(("", str(rng.randrange(30)) + "."))) for _ in range(n)]


def test_crossings_equal_exhaustive_search():
    rng = random.Random(5)
    fault = {conv.FINE: None, conv.TRUNCATED: "truncated", conv.GONE: "blank"}
    for _ in range(400):
        rows = [(rng.choice(("user", "assistant", "system", "tool")), rng.choice((0, 0, 0, 1, 2)))
                for _ in range(rng.randrange(12))]
        kinds = bytes([conv._kind(r[:1], f) for r, f in rows] + [conv.END])
        cost, audit, _ = brute_repair(tuple((r, "", fault[f]) for r, f in rows))
        found = conv.crossing(kinds, conv.START, conv.START)
        assert ("".join(found), conv._cost(kinds, found)) == (audit, cost)
        # the same over segments, by their tables
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
        starts, total = conv.states([conv.table(p) for p in parts])
        goals = [*starts[1:], conv.START] if parts else []
        joined = "".join("".join(conv.crossing(
            p + (bytes([conv.END]) if k == len(parts) - 1 else b""), s,
            conv.START if k == len(parts) - 1 else t))
            for k, (p, s, t) in enumerate(zip(parts, starts, goals)))
        assert total == cost and (joined == audit or not parts)


@pytest.mark.parametrize("segment", [2, 4096])
def test_summaries_equal_plain_python(spark, monkeypatch, segment):
    monkeypatch.setattr(conv, "SEGMENT_ROWS", segment)
    rng = random.Random(segment)
    groups = {k: random_rows(rng, rng.randrange(1, 9)) for k in [None, *range(60)]}
    groups[61] = random_rows(rng, 120)  # a long one over many segments
    rows = [(k, *r, 1) for k, own in groups.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    ours = {r[0]: tuple(r)[1:] for r in conv.summarize_repairs(df.repartition(5)).collect()}
    assert ours == {k: plain_summary(sorted(own, key=order)) for k, own in groups.items()}
    # the messages themselves give the same digests
    parts = {}
    for r in conv.repair_conversations(df).collect():
        parts.setdefault(r.conv_id, []).append((r.segment, r.audit, r.messages))
    for k, found in parts.items():
        found.sort()
        text = "\n".join(f"{m.role}:{m.text}" for f in found for m in f[2])
        assert hashlib.sha256(text.encode()).hexdigest() == ours[k][-1]
        assert "".join(f[1] for f in found) == ours[k][-2]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None)],
                               "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conv.summarize_repairs(df).collect()] == [
        (1, 0, 2, 0, 0, 1, 4, "DD", empty)]
    assert conv.summarize_repairs(df.limit(0)).count() == 0


def test_op12_equals_plain_python(spark):
    want = {}
    for c, turn, role, text in duckdb.sql(
            f"select conv_id, turn, role, text from '{SMALL}/conversations.parquet'").fetchall():
        own = want.setdefault(c, [])
        place = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        hit = zlib.crc32(place.encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    empty = hashlib.sha256(b"").hexdigest()
    want = {c: plain_summary(sorted(own, key=order)) if own else (0,) * 6 + ("", empty)
            for c, own in want.items()}
    ours = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SMALL).collect()}
    assert ours == want


def test_long_texts_and_clashing_columns(spark):
    """A message of two million characters and a conversation of 9,000 rows, cut into segments."""
    names = ["user", "assistant"]
    rows = [(1, k, names[k % 2], f"line {k}.", "x", "y") for k in range(9000)]
    rows += [(2, 0, "user", "a" * 2_000_000 + ".", "x", "y"), (2, 1, "assistant", "ok.", "x", "y")]
    df = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, conv string, key string")
    out = {r.conv_id: r for r in conv.summarize_repairs(df).collect()}
    assert (out[1].cost, out[1].audit, out[2].cost, out[2].audit) == (0, "K" * 9000, 0, "KK")
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:9000])
    assert out[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    parts = conv.repair_conversations(df).where("conv_id = 1").collect()
    assert len(parts) >= 3 and max(len(p.messages) for p in parts) <= conv.SEGMENT_ROWS
