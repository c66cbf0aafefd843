"""Element tables: the nodes of documents in order, each with the interval of its descendants.

Columns: doc_id, ord (from 0, dense in a document), end_ord (one past the last
descendant), elem (the kind), level, label, fields (map<string, string>).
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "ord", "end_ord", "elem", "level", "label", "fields"]


def close_levels(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(doc_id, ord, level, ...) with end_ord: the next node of the same or a higher rank ends a node.

    One running minimum for each level from 1 to `levels`: linear in a document's rows.
    """
    back = Window.partitionBy("doc_id").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    stops = [F.min(F.when(F.col("level") <= k, F.col("ord"))).over(back) for k in range(1, levels + 1)]
    marked = nodes.withColumns({f"__stop{k}": s for k, s in enumerate(stops, 1)} | {"__end": F.max("ord").over(whole) + 1})
    stop = F.coalesce(*[F.when(F.col("level") == k, F.col(f"__stop{k}")) for k in range(1, levels + 1)], F.col("__end"))
    return marked.withColumn("end_ord", stop.cast("bigint")).drop("__end", *[f"__stop{k}" for k in range(1, levels + 1)])


def from_orders(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A document for each customer: the customer is a heading of level 1, orders are of level 2, their items of level 3."""
    none = F.lit(None).cast("bigint")
    fields = lambda *kv: F.create_map(*[F.lit(x) if k % 2 == 0 else x for k, x in enumerate(kv)])
    c = customer.select(
        F.col("c_custkey").alias("doc_id"), none.alias("o"), none.alias("l"), none.alias("p"), F.lit("heading").alias("elem"), F.lit(1).alias("level"),
        F.concat(F.lit("customer-"), "c_custkey").alias("label"), fields("body", F.col("c_name"), "segment", F.col("c_mktsegment")).alias("fields"),
    )
    o = orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"), none.alias("l"), none.alias("p"), F.lit("heading").alias("elem"), F.lit(2).alias("level"),
        F.concat(F.lit("order-"), "o_orderkey").alias("label"), fields("body", F.col("o_orderpriority"), "status", F.col("o_orderstatus")).alias("fields"),
    )
    i = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("l"), F.col("l_partkey").alias("p"), F.lit("item").alias("elem"),
        F.lit(3).alias("level"), F.lit(None).cast("string").alias("label"), fields("body", F.col("l_returnflag"), "status", F.col("l_linestatus")).alias("fields"),
    )
    place = Window.partitionBy("doc_id").orderBy(F.col("o").asc_nulls_first(), F.col("l").asc_nulls_first(), F.col("p").asc_nulls_first(), F.element_at("fields", "body"), F.try_element_at("fields", F.lit("status")))
    nodes = c.unionByName(o).unionByName(i).withColumn("ord", (F.row_number().over(place) - 1).cast("bigint"))
    return close_levels(nodes, 3).select(*COLUMNS)


def from_turns(conversations: DataFrame) -> DataFrame:
    """A document for each conversation: turns of a user are headings of level 1, answers below them of level 2."""
    level = F.when(F.col("role") == "user", 1).otherwise(2)
    place = Window.partitionBy("conv_id").orderBy("turn", "role")
    nodes = conversations.select(
        F.col("conv_id").alias("doc_id"), (F.row_number().over(place) - 1).cast("bigint").alias("ord"), F.col("role").alias("elem"), level.alias("level"),
        F.lit(None).cast("string").alias("label"), F.create_map(F.lit("body"), F.col("text")).alias("fields"),
    )
    return close_levels(nodes, 2).select(*COLUMNS)


# Elements of HTML that have no end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[str, object]] = []
        self.open: list[int] = []

    def _add(self, elem: str, fields: list[tuple[str, str]]) -> int:
        k = len(self.rows)
        self.rows.append({"ord": k, "end_ord": k + 1, "elem": elem, "level": len(self.open) + 1, "label": dict(fields).get("id"), "fields": fields})
        return k

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        k = self._add(tag, [(a, v or "") for a, v in dict(attrs).items()])
        if tag not in VOID:
            self.open.append(k)

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[k]["elem"] == tag for k in self.open):
            while self.rows[k := self.open.pop()]["elem"] != tag:
                self.rows[k]["end_ord"] = len(self.rows)
            self.rows[k]["end_ord"] = len(self.rows)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add("text", [("body", data)])

    def done(self) -> list[dict[str, object]]:
        self.close()
        for k in self.open:
            self.rows[k]["end_ord"] = len(self.rows)
        return self.rows


def html_nodes(html: str | None) -> list[dict[str, object]]:
    parser = _Nodes()
    parser.feed(html or "")
    return parser.done()


NODE = "struct<ord: bigint, end_ord: bigint, elem: string, level: int, label: string, fields: map<string, string>>"
_ARROW_NODE = pa.struct({
    "ord": pa.int64(), "end_ord": pa.int64(), "elem": pa.string(), "level": pa.int32(), "label": pa.string(), "fields": pa.map_(pa.string(), pa.string()),
})


def from_html(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """The tags and texts of web pages; a page is parsed whole, in Arrow batches."""

    @F.arrow_udf(f"array<{NODE}>")
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([html_nodes(x) for x in b.to_pylist()], pa.list_(_ARROW_NODE))

    return pages.select(F.col(id).alias("doc_id"), F.explode(parsed(F.col(html))).alias("n")).select("doc_id", "n.*").select(*COLUMNS)
