"""Merge runs that read a versioned table and replace it."""

from tollwatch.operators.state import delta_rows, master_merge, state_upsert
from tollwatch.sources.sinks import run_snapshot
from tollwatch.session import written
from tollwatch.sources.versions import (
    latest_version, overwrite_state, overwrite_together, read_version,
)


def merge_and_publish(raw, df, path, snapshot_path, key, reset=False, run_at=None, prefer="lowest"):
    """Snapshot the raw rows, then write the merged master and the delta as one version.

    ``reset`` replaces both with the rows as given. Returns what was written.
    One marker commits the tables ``master`` and ``delta`` below ``path``: a run
    that dies before it changes neither, and a rerun makes the same delta.
    """
    spark = df.sparkSession
    run_snapshot(raw, snapshot_path, key, run_at)
    df = written(df, "publish")
    base = latest_version(spark, path) or 0
    if reset:
        merged = delta = df
    else:
        master = read_version(spark, path, name="master")
        merged = master_merge(df, master, key, prefer)
        delta = delta_rows(df, master, key)
    version = overwrite_together({"delta": delta, "master": merged}, path, base)
    return tuple(read_version(spark, path, at_most=version, name=n) for n in ("master", "delta"))


def update_state(path, new, not_breached, update=False, as_of=None):
    """Upsert rows into a state table and return its new contents."""
    spark = new.sparkSession
    base = latest_version(spark, path) or 0
    state = read_version(spark, path) if update else None
    version = overwrite_state(state_upsert(state, new, not_breached, as_of), path, base=base)
    return read_version(spark, path, at_most=version)
