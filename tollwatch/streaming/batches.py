"""Applying every batch of a stream to a versioned table once."""

from tollwatch.sources import versions


def once_per_batch(path, checkpoint, apply, keep=None):
    """Function for ``foreachBatch`` that commits ``apply(batch, stream)`` once.

    ``apply`` writes the next version with the given stream and batch number.
    Every version carries the last batch of each stream, by its checkpoint
    folder. A batch that runs again after its commit is skipped, also when other
    streams have written since, and a new stream may start over an existing
    table. ``keep`` is two or more: a batch reads one version while it writes
    the next.
    """
    if keep is not None and keep < 2:
        raise ValueError("a stream needs two versions")

    def once(batch, batch_id):
        spark = batch.sparkSession
        last = versions.last_batch(spark, path, checkpoint)
        if last is not None and batch_id <= last:
            return
        apply(batch, (checkpoint, batch_id))
        if keep:
            versions.drop_old_versions(spark, path, keep)

    return once
