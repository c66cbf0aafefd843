"""Places in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled


def with_ord(df: DataFrame, order: list[str | Column], out: str = "ord", start: int = 0, partitions: int | None = None) -> DataFrame:
    """df with `out`, the place of each row in the order, from start.

    Rows are dealt into ranges and numbered within each; only one count for
    each range is gathered.  The order should be total: ties are numbered in no
    particular order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.isStreaming:
        raise ValueError("a stream has no total order")
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # the place within a partition, in order, and the partition; ranges are drawn anew each time, so this is settled first
    marked = settled(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    marked = marked.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = marked.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))  # one row a range
    return marked.join(F.broadcast(offsets), "__range").withColumn(out, (F.col("__before") + F.col("__at") + start).cast("bigint")).drop("__at", "__range", "__before")


def ord_within(df: DataFrame, group: list[str], order: list[str | Column], out: str = "ord", start: int = 0) -> DataFrame:
    """df with the place of each row within its group."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1 + start).cast("bigint"))
