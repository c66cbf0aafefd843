"""Rewriting content: defaults, rules on elements and rules on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selectors import KEY, Selector


def set_default(elements: DataFrame, kind: str, field: str, value: str) -> DataFrame:
    """A field's value where elements of a kind don't have their own."""
    lacks = (F.col("elem") == kind) & ~F.map_contains_key("fields", field)
    return elements.withColumn("fields", F.when(lacks, F.map_concat("fields", F.create_map(F.lit(field), F.lit(value)))).otherwise(F.col("fields")))


def show(elements: DataFrame, selector: Selector, rewrite: Callable[[], dict[str, Column]]) -> DataFrame:
    """Matches with new columns; an element is rewritten once, so a rule can't follow itself."""
    p = selector.predicate()
    if p is None:
        hits = selector.rows(elements).select(*KEY, F.lit(True).alias("__hit"))
        marked = elements.join(hits, KEY, "left")
        p = F.coalesce(F.col("__hit"), F.lit(False))
        return marked.withColumns({c: F.when(p, v).otherwise(F.col(c)) for c, v in rewrite().items()}).drop("__hit")
    return elements.withColumns({c: F.when(p, v).otherwise(F.col(c)) for c, v in rewrite().items()})


def show_text(runs: DataFrame, within: list[str], ord: str, text: str, pattern: str, replacement: str) -> DataFrame:
    """Neighbouring texts of a group as one, with all matches replaced, even those across borders; replacement is plain text."""
    items = F.array_sort(F.collect_list(F.struct(ord, text)))
    joined = F.array_join(F.transform(items, lambda s: s[text]), "")
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return runs.groupBy(*within).agg(F.regexp_replace(joined, F.lit(pattern), F.lit(plain)).alias(text))


def collapse_spaces(rows: DataFrame, within: list[str], ord: str, text: str) -> DataFrame:
    """Without blank texts that follow a text ending in a blank, or begin or end a group."""
    over = Window.partitionBy(*within).orderBy(ord)
    blank = F.trim(F.col(text)) == ""
    before, after = F.lag(text).over(over), F.lead(text).over(over)
    drop = blank & (before.isNull() | before.rlike(r"\s$") | after.isNull())
    return rows.withColumn("__drop", drop).filter(~F.col("__drop")).drop("__drop")


def plain_text(elements: DataFrame, of: Selector, text_kind: str = "text") -> DataFrame:
    """(doc_id, ord, text): the texts below each match, in order."""
    outer = of.rows(elements).select("doc_id", F.col("ord").alias("__o"), F.col("end_ord").alias("__z"))
    inner = elements.filter(F.col("elem") == text_kind).select("doc_id", F.col("ord").alias("__i"), F.element_at("fields", "body").alias("__t"))
    both = outer.join(inner, "doc_id").filter((F.col("__i") > F.col("__o")) & (F.col("__i") < F.col("__z")))
    items = F.array_sort(F.collect_list(F.struct("__i", "__t")))
    return both.groupBy("doc_id", F.col("__o").alias("ord")).agg(F.array_join(F.transform(items, lambda s: s["__t"]), "").alias("text"))


def group_runs(rows: DataFrame, within: list[str], ord: str, kind: str, item: str) -> DataFrame:
    """(within, kind, first, last, items): neighbours of one kind together."""
    from .frames import runs

    marked = runs(rows, [kind], [ord], within)
    items = F.transform(F.array_sort(F.collect_list(F.struct(ord, item))), lambda s: s[item])
    return marked.groupBy(*within, kind, "run").agg(F.min(ord).alias("first"), F.max(ord).alias("last"), items.alias("items")).drop("run")
