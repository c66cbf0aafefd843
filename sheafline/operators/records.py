"""Transforms of records inside document conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_POINTS = 1 << 20


def densify(points: DataFrame, group: list[str], index: str, value: str, ord: str) -> DataFrame:
    """One row for each index from 0 to the group's largest; gaps are null, of repeated points the last counts."""
    last = points.filter((F.col(index) >= 0) & (F.col(index) < MOST_POINTS)).groupBy(*group, index).agg(F.max_by(value, ord).alias(value))
    top = last.groupBy(*group).agg(F.max(index).alias("__top"))
    grid = top.select(*group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__top").cast("bigint"))).alias(index))
    return grid.join(last, [*group, index], "left")


def pivot_series(rows: DataFrame, category: str, series: str, value: str, names: list[str], fill: str = "") -> DataFrame:
    """A row for each category and a column for each named series; naming them keeps this one aggregation."""
    wide = rows.groupBy(category).pivot(series, names).agg(F.first(value, ignorenulls=True))
    return wide.select(category, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(fill)).alias(n) for n in names])


def complete_groups(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups all of whose values are numbers."""
    return rows.groupBy(*group).agg(F.bool_and(F.coalesce(F.expr(f"try_cast({value} as double)").isNotNull(), F.lit(False))).alias("complete"))


def row_spans(cells: DataFrame, group: list[str], row: str, merge: str) -> DataFrame:
    """cells with `span`: 1 and the `continue` cells that follow a `restart` in its column; orphans stay ordinary."""
    over = Window.partitionBy(*group).orderBy(row)
    until = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.when(F.coalesce(F.col(merge) != "continue", F.lit(True)), 1).otherwise(0)).over(until)
    marked = cells.withColumn("__island", island)
    opened = Window.partitionBy(*group, "__island")
    begins = F.max(F.when(F.col(merge) == "restart", 1).otherwise(0)).over(opened)
    spanned = F.when(F.col(merge) == "restart", F.count("*").over(opened)).when((F.col(merge) == "continue") & (begins == 1), F.lit(0)).otherwise(F.lit(1))
    return marked.withColumn("span", spanned.cast("bigint")).drop("__island")


def column_starts(cells: DataFrame, group: list[str], place: str, span: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("column", F.coalesce(F.sum(span).over(before), F.lit(0)).cast("bigint"))


def majority(rows: DataFrame, group: list[str], keys: dict[str, Column], share: float = 0.6) -> DataFrame:
    """The commonest combination of keys in each group, if it has the share; ties go to the least keys."""
    counts = rows.select(*group, *[c.alias(k) for k, c in keys.items()]).groupBy(*group, *keys).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.min_by(F.struct(*keys, "n"), F.struct(-F.col("n"), *keys)).alias("b"), F.sum("n").alias("total"))
    return best.select(*group, "b.*", "total").filter(F.col("n") >= share * F.col("total"))


def split_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def w3c_date(text: Column) -> Column:
    return F.try_to_date(F.get(F.split(text, "T"), F.lit(0)))


def without_default(value: Column, default: object) -> Column:
    return F.nullif(value, F.lit(default))


def field_instruction(text: Column) -> Column:
    """{name, argument} of a field code such as HYPERLINK "target"."""
    trimmed = F.trim(text)
    quoted = F.regexp_extract(trimmed, '^\\S+\\s+"([^"]*)"', 1)
    plain = F.regexp_extract(trimmed, r"^\S+\s+([^\s\"]+)", 1)
    return F.struct(F.upper(F.regexp_extract(trimmed, r"^(\S+)", 1)).alias("name"), F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit(""))).alias("argument"))


def anchored_comments(anchors: DataFrame, comments: DataFrame, id: str, kind: str, ord: str) -> DataFrame:
    """comments with the first opening and the first closing place of their anchors; those without an opening are dropped."""
    first = anchors.groupBy(id).agg(
        F.min(F.when(F.col(kind) == "open", F.col(ord))).alias("opens"), F.min(F.when(F.col(kind) == "close", F.col(ord))).alias("closes")
    ).filter("opens is not null")
    return comments.join(first, id)


def namespace(ids: DataFrame, anchors: DataFrame, refs: DataFrame, name: str = "name") -> DataFrame:
    """Anchors that references need and no id takes."""
    needed = refs.select(name).distinct()
    return anchors.select(name).distinct().join(needed, name, "left_semi").join(ids.select(name).distinct(), name, "left_anti")


def integrity(ids: DataFrame, refs: DataFrame, part: str, id: str) -> DataFrame:
    """(problem, key, n): ids that repeat in a part, and references without an id."""
    repeated = ids.groupBy(part, id).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), F.col(id).cast("string").alias("key"), "n")
    lost = refs.join(ids.select(id).distinct(), id, "left_anti").groupBy(id).agg(F.count("*").alias("n")).select(F.lit("dangling").alias("problem"), F.col(id).cast("string").alias("key"), "n")
    return repeated.unionByName(lost)


def grid_places(cells: DataFrame, group: list[str], ord: str, columns: int) -> DataFrame:
    """Rows and columns of cells that simply flow."""
    return cells.withColumns({"y": F.floor(F.col(ord) / columns).cast("bigint"), "x": (F.col(ord) % columns).cast("bigint")})


def outline_parents(headings: DataFrame, group: list[str], levels: int, ord: str = "ord", level: str = "level") -> DataFrame:
    """headings with `parent`, the place of the nearest heading before of a higher rank; skipped levels don't matter."""
    before = Window.partitionBy(*group).orderBy(ord).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col(level) <= k, F.col(ord))).over(before) for k in range(1, levels)}
    marked = headings.withColumns({f"__p{k}": c for k, c in last.items()})
    parent = F.coalesce(*[F.when(F.col(level) == k + 1, F.col(f"__p{k}")) for k in last])
    return marked.withColumn("parent", parent).drop(*[f"__p{k}" for k in last])


def emphasis(bold: Column, italic: Column, others: list[Column]) -> Column:
    """{bold, italic} of a style that sets nothing else (null or false), so that plain markup can say all of it; else none."""
    alone = F.lit(True)
    for c in others:
        alone = alone & (c.isNull() | (c.cast("string") == "false"))
    b, i = F.coalesce(bold, F.lit(False)), F.coalesce(italic, F.lit(False))
    return F.when(alone & (b | i), F.struct(b.alias("bold"), i.alias("italic")))


def bound_bookmarks(refs: DataFrame, ids: DataFrame, places: DataFrame, name: str, ord: str) -> DataFrame:
    """(name, ord) of the bookmarks to put in: names that are referred to and have no bookmark, at the first place that bears them."""
    lost = refs.select(name).distinct().join(ids.select(name).distinct(), name, "left_anti")
    return places.groupBy(name).agg(F.min(ord).alias(ord)).join(lost, name, "left_semi")


def lost_targets(relations: DataFrame, parts: DataFrame, target: str, mode: str) -> DataFrame:
    """Relations within a package whose part it lacks; those marked External lead elsewhere."""
    inner = relations.filter(~F.col(mode).eqNullSafe(F.lit("External")))
    return inner.join(parts.select(target).distinct(), target, "left_anti")
