"""A watched folder: new files are batched and recomputed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed values, in milliseconds: a batch ends after a pause, or after so long in any case.
QUIET = 100
MOST = 500
POLL = 300


def watch(spark: SparkSession, path: str, schema: str, recompute: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, form: str = "json") -> StreamingQuery:
    """Calls recompute(rows, batch) for the rows of new files, every POLL milliseconds, or once for what is there."""
    stream = spark.readStream.schema(schema).format(form).load(path)
    writer = stream.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL} milliseconds")).start()


def event_batches(events: DataFrame, within: list[str], millis: Column, order: list[str], quiet: int = QUIET, most: int = MOST, out: str = "batch") -> DataFrame:
    """events with the number of the batch each falls in.

    A batch ends when nothing follows for `quiet` milliseconds, or when it has
    lasted `most`: within a stretch without a pause, a batch takes what is
    less than `most` after its first event.
    """
    over = Window.partitionBy(*within).orderBy("__ms", *order)
    timed = events.withColumn("__ms", millis)
    pause = F.coalesce(F.col("__ms") - F.lag("__ms").over(over) > quiet, F.lit(True))
    stretch = timed.withColumn("__pause", pause.cast("int")).withColumn("__s", F.sum("__pause").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("__ms").over(Window.partitionBy(*within, "__s"))
    parts = stretch.withColumn("__part", F.floor((F.col("__ms") - start) / most))
    return parts.withColumn(out, F.dense_rank().over(Window.partitionBy(*within).orderBy("__s", "__part")).cast("bigint")).drop("__ms", "__pause", "__s", "__part")
