"""Joins between references and what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """refs with their one target; a key with two targets is an error, one without any drops out (see dangling)."""
    one = targets.groupBy(key).agg(F.first(F.struct(*[c for c in targets.columns if c != key])).alias("__t"), F.count("*").alias("__n"))
    checked = one.select(key, F.when(F.col("__n") == 1, F.col("__t")).otherwise(F.raise_error("a reference has more than one target")).alias("__t"))
    return refs.join(checked, key).select(*refs.columns, "__t.*")


def dangling(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return refs.join(targets.select(key).distinct(), key, "left_anti")


def cited_entries(entries: DataFrame, citations: DataFrame, key: str, full: bool = False) -> DataFrame:
    """The entries that are cited, or all; one for each key."""
    used = entries if full else entries.join(citations.select(key).distinct(), key, "left_semi")
    return used.dropDuplicates([key])


def nearest_source(citations: DataFrame, sources: DataFrame, group: list[str], ord: str = "ord", target: Column | None = None) -> DataFrame:
    """citations(group, ord, key) with the source(group, key, ord) each belongs to.

    The first source at or after the citation, else the last before it.  Two
    running windows over the union of both; nothing is compared pairwise.
    """
    c = citations.withColumn("__c", F.lit(True))
    s = sources.select(*group, F.col(ord), F.col(ord).alias("__at"), F.lit(False).alias("__c"))
    rest = [x for x in c.columns if x not in (*group, ord, "__c")]
    both = c.withColumn("__at", F.lit(None).cast(sources.schema[ord].dataType)).unionByName(
        s.select("*", *[F.lit(None).cast(citations.schema[x].dataType).alias(x) for x in rest])
    )
    forward = Window.partitionBy(*group).orderBy(F.col(ord), F.col("__c").desc()).rowsBetween(0, Window.unboundedFollowing)
    backward = Window.partitionBy(*group).orderBy(F.col(ord), F.col("__c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"__next": F.first("__at", ignorenulls=True).over(forward), "__prev": F.last("__at", ignorenulls=True).over(backward)})
    at = F.coalesce(*([target] if target is not None else []), F.col("__next"), F.col("__prev"))
    return found.filter("__c").withColumn("source", at).drop("__c", "__at", "__next", "__prev")


def inherited(styles: DataFrame, id: str, parent: str, fields: list[str], most: int = 32) -> DataFrame:
    """styles with each field from the nearest ancestor that has it, at most so many hops.

    Pointer jumping: each round doubles the part of the chain that is merged,
    so 32 hops are five joins.  A cycle ends with the limit.
    """
    up = styles.select(id, F.col(parent).alias("__up"), *fields)
    hops = 1
    while hops < most:
        above = up.select(F.col(id).alias("__id"), F.col("__up").alias("__next"), *[F.col(f).alias(f"__{f}") for f in fields])
        up = up.join(above, F.col("__up") == F.col("__id"), "left").select(id, F.col("__next").alias("__up"), *[F.coalesce(f, f"__{f}").alias(f) for f in fields])
        hops *= 2
    return up.drop("__up")


def claims(rows: DataFrame, key: str, ord: list[str]) -> DataFrame:
    """First come, first served: the rows that have their key to themselves or came first."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*ord))).filter((F.col("__k") == 1) | F.col(key).isNull()).drop("__k")


def number_by_first_use(uses: DataFrame, key: str, ord: str, within: list[str], out: str = "number") -> DataFrame:
    """uses with a dense number for each key, by its first place."""
    first = uses.withColumn("__first", F.min(ord).over(Window.partitionBy(*within, key)))
    return first.withColumn(out, F.dense_rank().over(Window.partitionBy(*within).orderBy("__first"))).drop("__first")
