"""Run check queries against their oracles: ``python -m checks.compare [sf_dir] [name …]``."""

import sys
import time

import duckdb

from checks.oracle import ORACLES
from checks.queries import QUERIES
from tollwatch.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir, name):
    """Empty text when both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return "" if ours else "no rows"
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if a == b:
        return "" if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows against {len(b)}; only ours {only_a}; only oracle {only_b}"


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} {time.time() - start:.2f}s {found}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} failed")


if __name__ == "__main__":
    main(*sys.argv[1:])
