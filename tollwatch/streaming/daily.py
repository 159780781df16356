"""Daily metrics kept up to date over an event stream."""

from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.operators.blocks import reason_counters
from tollwatch.sources import versions
from tollwatch.streaming.batches import once_per_batch

#: How long after the newest day seen a day still takes rows.
DELAY = "3 days"


def stream_daily_metrics(events, preset=S.DAILY_VERIFY, delay=DELAY):
    """Counters per load date, in windows of a day of event time.

    The watermark follows the newest load date. Days that it has passed are
    final: their state is dropped and rows that come for them are left out
    (``late_rows`` counts them). State is a row for each day within ``delay``.
    Rows without a date are left out.
    """
    day = F.to_timestamp("data_load_date")
    counters = [*reason_counters(preset), F.count(F.lit(1)).alias("total_traffic")]
    return (events.withColumn("_day", day).withWatermark("_day", delay)
            .groupBy(F.window("_day", "1 day"), "data_load_date").agg(*counters).drop("window"))


def start_daily_metrics(events, path, checkpoint, preset=S.DAILY_VERIFY, keep=None, delay=DELAY,
                        **trigger):
    """Write the days that changed into a versioned table after every batch of events.

    A day of the batch replaces the one in the table, all others stay: those
    that are final, and those of an existing table that the stream has not met.
    A new stream counts a day from the rows that it reads itself, so its source
    must hold whole days. ``keep`` bounds the number of versions kept.
    """
    def apply(batch, stream):
        spark = batch.sparkSession
        base = versions.latest_version(spark, path) or 0
        old = versions.read_version(spark, path)
        batch = batch.persist()  # a row for each day that changed; the stream runs once for it
        try:
            new = batch
            if old is not None:
                days = batch.select(F.col("data_load_date").alias("_new"))
                new = old.join(days, F.col("data_load_date") == F.col("_new"), "left_anti") \
                    .unionByName(batch)
            versions.overwrite_state(new, path, base, stream)
        finally:
            batch.unpersist()

    return (stream_daily_metrics(events, preset, delay).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(once_per_batch(path, checkpoint, apply, keep)).start())


def late_rows(query):
    """Rows that the recent batches of a query left out because their day was final.

    A partial sum of a day that comes late counts once for each task that made it.
    """
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for state in progress["stateOperators"])
