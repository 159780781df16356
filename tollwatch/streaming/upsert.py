"""State tables kept up to date from a stream of new rows."""

from tollwatch import schemas as S
from tollwatch.operators.lists import insert_if_absent_ttl
from tollwatch.operators.state import state_upsert
from tollwatch.sources import versions
from tollwatch.streaming.batches import once_per_batch

#: Buckets of a state table; a batch rewrites those it touches.
BUCKETS = 64


def start_upsert(rows, path, checkpoint, merge, schema, keep=None, buckets=BUCKETS, **trigger):
    """Apply ``merge(old, batch)`` for every batch to the newest version of a table.

    The state lies in ``buckets`` by a hash of its key, and a batch reads and
    writes only those that hold a key of the batch or one cleared with it, so
    small batches cost little however large the state is. Expired rows of the
    other buckets stay until a batch touches them; readers compare
    ``expiry_time``. ``keep`` bounds the number of versions kept.
    """
    def apply(batch, stream):
        batch = batch.sparkSession.createDataFrame([], schema).unionByName(batch)
        versions.upsert_buckets(batch, path, merge, merge.key, merge.touches(batch), buckets, stream)

    return (rows.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(once_per_batch(path, checkpoint, apply, keep)).start())


def upserting(not_breached, as_of=None):
    """Merge step: latest expiry per key, cleared keys removed, expired rows dropped.

    ``not_breached`` is a function from a batch to the keys cleared with it, as
    each run of the batch form gets its own list. A frame stands for the same
    list in every batch, so a listed key stays only until the next batch.
    """
    def cleared(batch):
        return not_breached(batch) if callable(not_breached) else not_breached

    def merge(old, batch):
        return state_upsert(old, batch, cleared(batch), as_of)

    merge.key = S.STATE_KEY
    merge.touches = lambda batch: [cleared(batch)]
    return merge


def inserting(as_of=None):
    """Merge step: insert keys that have no unexpired entry."""
    def merge(old, batch):
        return insert_if_absent_ttl(old, batch, as_of).drop("inserted")

    merge.key = ["key"]
    merge.touches = lambda batch: []
    return merge
