"""A query language over element tables.

Selectors compose with |, &, before, after and within.  query() compiles one to
predicates over the table: field tests are plain filters; before and after need
one place a document, found by an aggregation; within is a range semi join on
the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "ord"]


class Selector:
    def __or__(self, other: Selector) -> Selector:
        return Or((self, other))

    def __and__(self, other: Selector) -> Selector:
        return And((self, other))

    def before(self, end: Selector, inclusive: bool = True) -> Selector:
        return Side(self, end, True, inclusive)

    def after(self, start: Selector, inclusive: bool = True) -> Selector:
        return Side(self, start, False, inclusive)

    def within(self, ancestor: Selector) -> Selector:
        return Within(self, ancestor)

    def predicate(self) -> Column | None:
        """The selector as one condition on a row, if it is one."""
        return None

    def rows(self, elements: DataFrame) -> DataFrame:
        p = self.predicate()
        if p is None:
            raise NotImplementedError
        return elements.filter(p)


@dataclass(frozen=True, eq=False)
class Elem(Selector):
    """Elements of a kind whose fields have given values; columns of the table count as fields."""

    kind: str | None
    fields: tuple[tuple[str, object], ...] = ()

    def where(self, **fields: object) -> Elem:
        return Elem(self.kind, (*self.fields, *fields.items()))

    def predicate(self) -> Column:
        tests = [F.col("elem") == self.kind] if self.kind else []
        for name, value in self.fields:
            field = F.col(name) if name in ("level", "label", "ord", "end_ord") else F.try_element_at("fields", F.lit(name))
            tests.append(field.eqNullSafe(F.lit(value)))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True, eq=False)
class Label(Selector):
    name: str

    def predicate(self) -> Column:
        return F.col("label") == self.name


@dataclass(frozen=True, eq=False)
class Location(Selector):
    doc_id: int
    ord: int

    def predicate(self) -> Column:
        return (F.col("doc_id") == self.doc_id) & (F.col("ord") == self.ord)


@dataclass(frozen=True, eq=False)
class Where(Selector):
    """Any condition on the table's columns."""

    condition: Column

    def predicate(self) -> Column:
        return self.condition


@dataclass(frozen=True, eq=False)
class Or(Selector):
    parts: tuple[Selector, ...]

    def predicate(self) -> Column | None:
        ps = [p.predicate() for p in self.parts]
        return None if any(p is None for p in ps) else reduce(lambda a, b: a | b, ps)

    def rows(self, elements: DataFrame) -> DataFrame:
        if self.predicate() is not None:
            return elements.filter(self.predicate())
        keys = reduce(lambda a, b: a.unionByName(b), [p.rows(elements).select(*KEY) for p in self.parts]).distinct()
        return elements.join(keys, KEY, "left_semi")


@dataclass(frozen=True, eq=False)
class And(Selector):
    parts: tuple[Selector, ...]

    def predicate(self) -> Column | None:
        ps = [p.predicate() for p in self.parts]
        return None if any(p is None for p in ps) else reduce(lambda a, b: a & b, ps)

    def rows(self, elements: DataFrame) -> DataFrame:
        plain = [p.predicate() for p in self.parts if p.predicate() is not None]
        rest = [p for p in self.parts if p.predicate() is None]
        out = elements.filter(reduce(lambda a, b: a & b, plain)) if plain else elements
        for p in rest:
            out = out.join(p.rows(elements).select(*KEY), KEY, "left_semi")
        return out


@dataclass(frozen=True, eq=False)
class Side(Selector):
    """Matches up to, or from, the first match of a bound in the document; without one, all."""

    of: Selector
    bound: Selector
    before_: bool
    inclusive: bool

    def rows(self, elements: DataFrame) -> DataFrame:
        first = self.bound.rows(elements).groupBy("doc_id").agg(F.min("ord").alias("__bound"))
        o, b = F.col("ord"), F.col("__bound")
        side = (o <= b if self.inclusive else o < b) if self.before_ else (o >= b if self.inclusive else o > b)
        return self.of.rows(elements).join(first, "doc_id", "left").filter(b.isNull() | side).drop("__bound")


@dataclass(frozen=True, eq=False)
class Within(Selector):
    """Matches strictly inside a match of the ancestor: one that begins before has the greatest end beyond them."""

    of: Selector
    ancestor: Selector

    def rows(self, elements: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        outer = self.ancestor.rows(elements).select("doc_id", F.col("ord").alias("__at"), F.col("end_ord").alias("__end"))
        both = self.of.rows(elements).withColumn("__at", F.col("ord")).unionByName(outer, allowMissingColumns=True)
        # of a match and an ancestor at one place the match comes first: an element isn't inside itself
        over = Window.partitionBy("doc_id").orderBy("__at", F.col("__end").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reach = both.withColumn("__reach", F.max("__end").over(over))
        return reach.filter(F.col("__end").isNull() & (F.col("__reach") > F.col("__at"))).drop("__at", "__end", "__reach")


def elem(kind: str | None = None, /, **fields: object) -> Elem:
    return Elem(kind, tuple(fields.items()))


def query(elements: DataFrame, selector: Selector) -> DataFrame:
    """All matches; order by doc_id and ord where order matters."""
    return selector.rows(elements)


def query_first(elements: DataFrame, selector: Selector) -> DataFrame:
    """Each document's first match."""
    rows = selector.rows(elements)
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("doc_id", "r.*")


def query_unique(elements: DataFrame, selector: Selector) -> DataFrame:
    """The one match in each document; more or none are an error."""
    p = selector.predicate()
    marked = elements.withColumn("__hit", p) if p is not None else elements.join(selector.rows(elements).select(*KEY, F.lit(True).alias("__hit")), KEY, "left")
    rest = [c for c in elements.columns if c != "doc_id"]
    hit = F.coalesce("__hit", F.lit(False))
    one = marked.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.when(hit, F.col("ord"))).alias("r"), F.count_if(hit).alias("n"))
    wrong = F.when(F.col("n") == 0, F.lit("no element matches the selector")).otherwise(F.lit("more than one element matches the selector"))
    checked = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(wrong))
    return one.select("doc_id", checked.alias("r")).select("doc_id", "r.*")


def query_label(elements: DataFrame, name: str) -> DataFrame:
    """The one element with a label, of all documents; more or none are an error."""
    rows = elements.filter(F.col("label") == name)
    one = rows.agg(F.first(F.struct(*elements.columns)).alias("r"), F.count("*").alias("n"))
    wrong = F.when(F.col("n") == 0, F.lit("no element has the label")).otherwise(F.lit("more than one element has the label"))
    return one.select(F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(wrong)).alias("r")).select("r.*")


def locate(elements: DataFrame, selector: Selector) -> DataFrame:
    return query_unique(elements, selector).select(*KEY)


def query_labelled(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("label").isNotNull())


def label_count(elements: DataFrame) -> DataFrame:
    return query_labelled(elements).groupBy("label").agg(F.count("*").alias("n"))


def count_before(elements: DataFrame, selector: Selector, at: Selector) -> DataFrame:
    """For each match of `at`: how many matches of the selector stand at or before it."""
    hits = selector.rows(elements).select(*KEY).withColumn("__hit", F.lit(1))
    marks = at.rows(elements).select(*KEY).withColumn("__mark", F.lit(True))
    both = hits.join(marks, KEY, "full")
    from pyspark.sql import Window

    over = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("n_before", F.coalesce(F.sum("__hit").over(over), F.lit(0))).filter("__mark").select(*KEY, "n_before")


def field_values(rows: DataFrame, field: str, one: bool = False) -> DataFrame:
    """A field of matches as `value`; rows without it go, and `one` insists on a single row."""
    out = rows.filter(F.map_contains_key("fields", field)).select(*KEY, F.element_at("fields", field).alias("value"))
    if one:
        n = out.limit(2).count()
        if n != 1:
            raise ValueError(f"expected exactly one element, found {'more' if n else 'none'}")
    return out


def with_metadata(elements: DataFrame, extra: DataFrame) -> DataFrame:
    """elements with rows(doc_id, ord, value) of kind metadata; places are between those of others."""
    rows = extra.select(
        "doc_id", "ord", (F.col("ord") + 1).alias("end_ord"), F.lit("metadata").alias("elem"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("label"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("fields"),
    )
    return elements.unionByName(rows)


def nearest_forward(elements: DataFrame, key: Column, bases: DataFrame) -> DataFrame:
    """bases(doc_id, ord, key) with `target`: the place of the next element of this key, from the start again after the end."""
    from pyspark.sql import Window

    candidates = elements.select("doc_id", F.col("ord").alias("at"), key.alias("key"))
    first = candidates.groupBy("doc_id", "key").agg(F.min("at").alias("__first"))
    marks = candidates.select("doc_id", "key", F.col("at").alias("ord"), F.col("at"), F.lit(False).alias("__base")).unionByName(
        bases.select("doc_id", "key", "ord", F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("__base"))
    )
    over = Window.partitionBy("doc_id", "key").orderBy("ord", "__base").rowsBetween(1, Window.unboundedFollowing)
    found = marks.withColumn("__next", F.first("at", ignorenulls=True).over(over)).filter("__base")
    return found.join(first, ["doc_id", "key"]).select("doc_id", "ord", "key", F.coalesce("__next", "__first").alias("target"))
