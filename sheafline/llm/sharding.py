"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing (operator 2).

A partial partition is a tuple of one sum for each shard.  The two with the
largest spread are combined, the largest sum of one with the smallest of the
other, until one is left.  Groups are differenced within buckets, each of which
leaves one partial partition; those of all buckets are then differenced in the
same way, and what remains fixes the shard of every group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Groups that one task differences.
BUCKET_GROUPS = 50_000
#: Partial partitions that the driver combines.
MOST_BUCKETS = 16_384
#: Rows that one task numbers within a shard.
NUMBERED_ROWS = 20_000


def differencing(partials: list[list[int]]) -> list[list[int]]:
    """For each partial partition (k sums, in any order) the final place of each of its sums.

    Ties go to the partial that comes first, so equal input gives equal results.
    """
    if not partials:
        return []
    k = len(partials[0])
    places = range(k)
    #: of each node: the order that makes its sums descend, and its two children
    order: list[list[int]] = []
    children: list[tuple[int, int] | None] = []
    sums: list[list[int]] = []
    heap: list[tuple[int, int]] = []

    def add(s: list[int], of: tuple[int, int] | None) -> None:
        by = sorted(places, key=lambda p: -s[p])
        d = [s[p] for p in by]
        order.append(by)
        children.append(of)
        sums.append(d)
        heapq.heappush(heap, (d[-1] - d[0], len(order) - 1))

    for s in partials:
        add(s, None)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        add([x[p] + y[k - 1 - p] for p in places], (a, b))
        sums[a] = sums[b] = []
    final: list[list[int]] = [[]] * len(order)
    final[-1] = list(places)  # where the root's descending sums go
    out: list[list[int]] = [[]] * len(partials)
    for node in range(len(order) - 1, -1, -1):
        at = [0] * k  # of the node's sums before they were ordered
        for p, q in zip(order[node], final[node], strict=True):
            at[p] = q
        if (of := children[node]) is None:
            out[node] = at
        else:
            final[of[0]] = at
            final[of[1]] = at[::-1]
        final[node] = []
    return out


def _in_bucket(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        rest = [0] * (shards - 1)
        place = [p[0] for p in differencing([[int(b), *rest] for b in groups["bytes"]])]
        return groups.assign(slot=pd.Series(place, dtype="int32"))

    return run


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def plan_shards(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size long, text_crc32 long, shard int, slot long) for every row of docs.

    Rows of equal text (null and empty are different sizes of nothing: both
    one byte, and count as one text) are one group and share a shard.  Sums of
    sizes are near equal over the shards; `slot` numbers the rows of a shard
    from 0 without gaps.  A group larger than a shard's share stays whole, so
    its shard is larger.  Ids may be null or repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    own = stored(
        docs.select(F.col(id).alias("id"), size_of(F.col(text)).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("digest")),
        "shard-rows",
    )
    groups = stored(own.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    buckets = min(MOST_BUCKETS, max(64, -(-groups.count() // BUCKET_GROUPS)))
    local = stored(
        groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
        .groupBy("bucket").applyInPandas(_in_bucket(shards), "digest binary, bytes long, bucket int, slot int"),
        "shard-buckets",
    )
    sums: dict[int, list[int]] = {}
    for r in local.groupBy("bucket", "slot").agg(F.sum("bytes").alias("bytes")).orderBy("bucket", "slot").collect():  # MOST_BUCKETS * shards rows at most
        sums.setdefault(r.bucket, [0] * shards)[r.slot] = r.bytes
    place = dict(zip(sums, differencing(list(sums.values())), strict=True))
    named = spark.createDataFrame([(b, s, p[s]) for b, p in place.items() for s in range(shards)], "bucket int, slot int, shard int")
    shard_of = local.join(F.broadcast(named), ["bucket", "slot"]).select("digest", "shard")

    n = own.count()
    chunks = max(512, -(-n // NUMBERED_ROWS))
    placed = stored(own.join(shard_of, "digest").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "shard-placed")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "digest"))
    return placed.withColumn("rank", rank).join(offsets, ["shard", "chunk"]).select(
        F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id: str = "doc_id") -> None:
    """docs as Parquet folders shard=0, 1, ... in order of slot; ids must be unique and not null."""
    rows = docs.drop("shard", "slot").join(plan.select(id, "shard", "slot"), id)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
