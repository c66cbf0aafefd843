"""The array algebra over rows: DataFrames with an explicit order column.

`within` names the columns of a group; each group is an array of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.guards import same


def _over(within: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*within).orderBy(*order)


def slice_rows(df: DataFrame, ord: str, start: int, end: int | None = None) -> DataFrame:
    """Rows whose place is from start to before end."""
    out = df.filter(F.col(ord) >= start)
    return out if end is None else out.filter(F.col(ord) < end)


def reversed_rows(df: DataFrame, ord: str, within: list[str]) -> DataFrame:
    """New places, from the last to the first."""
    return df.withColumn(ord, (F.row_number().over(_over(within, F.col(ord).desc())) - 1).cast("bigint"))


def dedup_rows(df: DataFrame, key: list[str], ord: list[str]) -> DataFrame:
    """The first row of each key.  A partial aggregation keeps hot keys out of one task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*ord))
    return df.groupBy(*key).agg(first.alias("__r")).select(*key, "__r.*").select(*df.columns)


def chunk_rows(df: DataFrame, ord: str, size: int, exact: bool = False, within: list[str] | None = None) -> DataFrame:
    """df with `chunk`, a number for each run of so many rows."""
    out = df.withColumn("chunk", F.floor(F.col(ord) / size).cast("bigint"))
    if not exact:
        return out
    full = out.groupBy(*(within or []), "chunk").agg(F.count("*").alias("__n")).filter(F.col("__n") == size).drop("__n")
    return out.join(full, [*(within or []), "chunk"], "left_semi")


def window_rows(df: DataFrame, ord: str, value: str, size: int, within: list[str], out: str = "window") -> DataFrame:
    """Rows that begin a run of so many neighbours, with their values."""
    frame = _over(within, ord).rowsBetween(0, size - 1)
    return df.withColumn(out, F.collect_list(value).over(frame)).filter(F.size(out) == size)


def zip_rows(left: DataFrame, right: DataFrame, ord: str, exact: bool = False) -> DataFrame:
    """Rows at one place side by side, as many as the shorter frame has; exact makes a difference an error."""
    if not exact:
        return left.join(right, ord)
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), ord, "full")
    return both.withColumn("__l", F.assert_true(F.col("__l") & F.col("__r"), F.lit("arrays must have the same length"))).filter(F.col("__l").isNull()).drop("__l", "__r")


def split_rows(df: DataFrame, ord: list[str], at: Column, within: list[str], out: str = "piece") -> DataFrame:
    """Rows between separators, with the number of their piece; separators go."""
    piece = F.sum(F.when(at, 1).otherwise(0)).over(_over(within, *ord).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, piece.cast("bigint")).filter(~at)


def runs(df: DataFrame, key: list[str], ord: list[str], within: list[str], out: str = "run") -> DataFrame:
    """df with the number of each row's run of equal neighbours (gaps and islands)."""
    over = _over(within, *ord)
    changed = F.lit(False)
    for k in key:
        changed = changed | ~same(F.lag(k).over(over), F.col(k))
    first = F.row_number().over(over) == 1
    return df.withColumn("__new", F.when(first | changed, 1).otherwise(0)).withColumn(
        out, (F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("bigint")
    ).drop("__new")


def dedup_runs_keep_last(df: DataFrame, key: str, ord: list[str], within: list[str]) -> DataFrame:
    """The later of neighbours with equal keys."""
    over = _over(within, *ord)
    last = F.lead(F.lit(True)).over(over).isNull()
    return df.withColumn("__keep", last | ~same(F.lead(key).over(over), F.col(key))).filter("__keep").drop("__keep")


def trim_rows(df: DataFrame, test: Column, ord: str, within: list[str]) -> DataFrame:
    """Without the rows at both ends that pass the test."""
    bounds = Window.partitionBy(*within)
    inner = F.when(~test, F.col(ord))
    marked = df.withColumns({"__a": F.min(inner).over(bounds), "__z": F.max(inner).over(bounds)})
    return marked.filter((F.col(ord) >= F.col("__a")) & (F.col(ord) <= F.col("__z"))).drop("__a", "__z")


def join_text(df: DataFrame, value: str, ord: list[str], within: list[str], separator: str = ", ", out: str = "joined") -> DataFrame:
    """Each group's texts put together in order."""
    items = F.array_sort(F.collect_list(F.struct(*ord, value)))
    return df.groupBy(*within).agg(F.array_join(F.transform(items, lambda s: s[value]), separator).alias(out))


def to_dict_rows(df: DataFrame, key: list[str], value: str, ord: list[str]) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*ord)).alias(value))


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upper_median(df: DataFrame, value: str, group: list[str], out: str = "median") -> DataFrame:
    """The element at n // 2 of each group's sorted values, by counts of equal values.

    Values are counted first, so a large group with few different values
    doesn't meet in one task as a whole.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    items = F.array_sort(F.collect_list(F.struct(value, "__n")))
    merged = counts.groupBy(*group).agg(items.alias("__v"), F.sum("__n").alias("__all"))
    walked = F.aggregate(
        "__v", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(df.schema[value].dataType).alias("v")),
        lambda s, x: F.when(s["n"] > F.floor(F.col("__all") / 2), s).otherwise(F.struct((s["n"] + x["__n"]).alias("n"), x[value].alias("v"))),
    )
    return merged.select(*group, walked["v"].alias(out))
