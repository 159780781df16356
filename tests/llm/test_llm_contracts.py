"""Queries that SQL does not express, against plain Python over whole tables."""

import hashlib
import re
import zlib

import duckdb

from tests.llm.test_llm_periods import brute_runs
from tollwatch.llm import queries

SMALL = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"select * from '{SMALL}/{name}.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def row11(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    if n > 200 + 200 * (h % 10 == 0):  # the plain search takes the square of this
        return None
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best
                         else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_op11_equals_plain_python(spark):
    ours = {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    want = {d[0]: row11(d[0], d[1]) for d in table("documents")}
    assert ours.keys() == want.keys()
    checked = [k for k, v in want.items() if v is not None]
    assert len(checked) > 0.3 * len(want)
    assert all(ours[k] == want[k] for k in checked)
    assert any(want[k][0] for k in checked)
