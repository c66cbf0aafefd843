"""The registered queries, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, calc, datetimes, numbering, numbers, strings
from ..functions.guards import all_of, any_of, assert_eq, assert_ne, assert_that, divide, minus, negative, panic, plus, same, times
from ..operators import arrays, dicts, elements, folds, frames, lookups, merge, order, records, rewrite, selectors, textdiff
from ..operators.selectors import Label, Location, elem
from ..operators.tables import shared_folder
from ..sources import readers, sinks
from ..streaming.watch import event_batches
from .rounds import fixpoint

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


# --- arrays: nested, one array an order ------------------------------------------------------

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_QUANTITIES = f"""SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY {', '.join(_LINE)}) AS q, list(l_returnflag ORDER BY {', '.join(_LINE)}) AS f
FROM lineitem GROUP BY l_orderkey"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, q array<bigint>, f array<string>): each order's quantities and flags in order of its lines."""
    items = F.array_sort(F.collect_list(F.struct(*_LINE, F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"))))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    return rows.select("l_orderkey", F.transform("items", lambda s: s["q"]).alias("q"), F.transform("items", lambda s: s["f"]).alias("f"))


def _text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def _nested(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.array_join(x.cast("array<string>"), ",")), ";")


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, CAST(len(q) AS BIGINT) AS n, q[1] AS first, q[-1] AS last, coalesce(q[3], -1) AS third,
  coalesce(q[-2], -1) AS last_but_one FROM o""")
def arr_access(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _orders(spark, d).select(
        "l_orderkey", arrays.length(q).alias("n"), arrays.first(q).alias("first"), arrays.last(q).alias("last"),
        arrays.at(q, 2, -1).alias("third"), arrays.at(q, -2, -1).alias("last_but_one"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, array_to_string(list_filter(q, lambda x: x < 20), ',') AS low,
  array_to_string(list_transform(q, lambda x: x * x), ',') AS squares, list_filter(q, lambda x: x > 40)[1] AS first_high,
  CAST(list_position(list_transform(q, lambda x: x > 40), true) - 1 AS BIGINT) AS high_at, list_contains(q, 7) AS has_seven FROM o""")
def arr_filter_map(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _orders(spark, d).select(
        "l_orderkey", _text(arrays.filter_(q, lambda x: x < 20)).alias("low"), _text(arrays.map_(q, lambda x: x * x)).alias("squares"),
        arrays.find(q, lambda x: x > 40).alias("first_high"), arrays.position(q, lambda x: x > 40).alias("high_at"), arrays.contains(q, F.lit(7)).alias("has_seven"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, array_to_string(list_append(q, 99), ',') AS pushed, array_to_string(q[:-2], ',') AS popped,
  array_to_string(list_concat([99], q), ',') AS inserted, array_to_string(list_concat(q[:-2], [99, q[-1]]), ',') AS before_last,
  array_to_string(q[2:], ',') AS removed, array_to_string(q[2:3], ',') AS sliced, array_to_string(list_reverse(q), ',') AS reversed FROM o WHERE len(q) >= 3""")
def arr_edit(spark: SparkSession, d: str) -> DataFrame:
    q, nn = F.col("q"), F.lit(99).cast("bigint")
    return _orders(spark, d).filter(F.size("q") >= 3).select(
        "l_orderkey", _text(arrays.push(q, nn)).alias("pushed"), _text(arrays.pop(q)["rest"]).alias("popped"), _text(arrays.insert(q, 0, nn)).alias("inserted"),
        _text(arrays.insert(q, -1, nn)).alias("before_last"), _text(arrays.remove(q, 0)["rest"]).alias("removed"),
        _text(arrays.slice_(q, 1, 3)).alias("sliced"), _text(arrays.rev(q)).alias("reversed"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, array_to_string(list_sort(q), ',') AS ascending,
  array_to_string(list_transform(list_sort(list_transform(q, lambda x, i: {{'k': x % 10, 'i': i, 'x': x}})), lambda s: s.x), ',') AS by_digit,
  array_to_string(list_reverse_sort(q), ',') AS descending FROM o""")
def arr_sorted(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _orders(spark, d).select(
        "l_orderkey", _text(arrays.sorted_(q)).alias("ascending"), _text(arrays.sorted_(q, lambda x: x % 10)).alias("by_digit"),
        _text(arrays.sorted_by(q, lambda a, b: a >= b)).alias("descending"),
    )


@query(f"""WITH o AS ({_QUANTITIES}), u AS (SELECT l_orderkey, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM o),
  k AS (SELECT l_orderkey, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT l_orderkey, string_agg(x, ',' ORDER BY i) AS flags FROM k GROUP BY 1""")
def arr_dedup_nested(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("l_orderkey", F.array_join(arrays.dedup(F.col("f"), lambda x: F.upper(x)), ",").alias("flags"))


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_sum(q) AS BIGINT) + 1000 AS folded,
  CAST(list_max(q) AS BIGINT) AS reduced, len(list_filter(q, lambda x: x > 45)) > 0 AS some, len(list_filter(q, lambda x: x > 5)) = len(q) AS every,
  CAST(list_product(q[1:3]) AS BIGINT) AS product FROM o""")
def arr_folds(spark: SparkSession, d: str) -> DataFrame:
    q, zero, one = F.col("q"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return _orders(spark, d).select(
        "l_orderkey", arrays.sum_(q, zero).alias("total"), arrays.fold(q, zero + 1000, lambda s, x: s + x).alias("folded"),
        arrays.reduce_(q, lambda a, b: F.greatest(a, b)).alias("reduced"), arrays.any_(q, lambda x: x > 45).alias("some"),
        arrays.all_(q, lambda x: x > 5).alias("every"), arrays.product(F.slice(q, 1, 3), one).alias("product"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey,
  array_to_string(list_transform(range(0, len(q), 2), lambda i: array_to_string(q[i + 1:i + 2], ',')), ';') AS chunks,
  array_to_string(list_transform(range(0, len(q) - len(q) % 2, 2), lambda i: array_to_string(q[i + 1:i + 2], ',')), ';') AS exact,
  array_to_string(list_transform(range(0, greatest(len(q) - 2, 0), 1), lambda i: array_to_string(q[i + 1:i + 3], ',')), ';') AS windows FROM o""")
def arr_chunks_nested(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _orders(spark, d).select(
        "l_orderkey", _nested(arrays.chunks(q, 2)).alias("chunks"), _nested(arrays.chunks(q, 2, exact=True)).alias("exact"), _nested(arrays.windows(q, 3)).alias("windows")
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey,
  array_to_string(list_transform(range(0, least(len(q) - 1, len(f)), 1), lambda i: concat(q[i + 2], f[i + 1])), ',') AS zipped,
  array_to_string(list_transform(q, lambda x, i: concat(i + 9, ':', x)), ',') AS numbered,
  array_to_string(f, '-') AS joined, CASE WHEN len(f) > 1 THEN array_to_string(f[:-2], ', ') || ' and ' || f[-1] ELSE f[1] END AS listed,
  array_to_string(f, '|') AS spaced FROM o""")
def arr_zip_join(spark: SparkSession, d: str) -> DataFrame:
    q, f = F.col("q"), F.col("f")
    zipped = arrays.zip_(F.slice(q, F.lit(2), F.size(q)), f)
    return _orders(spark, d).select(
        "l_orderkey", _text(F.transform(zipped, lambda s: F.concat(s["_0"].cast("string"), s["_1"]))).alias("zipped"),
        _text(F.transform(arrays.enumerate_(q, 10), lambda s: F.concat_ws(":", s["index"], s["value"]))).alias("numbered"),
        arrays.join(f, "-").alias("joined"), arrays.join(f, ", ", last=" and ").alias("listed"), F.array_join(arrays.intersperse(f, F.lit("|")), "").alias("spaced"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, replace(array_to_string(list_transform(f, lambda x: CASE WHEN x = 'N' THEN ';' ELSE x END), ','), ',', '') AS pieces FROM o""")
def arr_split_nested(spark: SparkSession, d: str) -> DataFrame:
    pieces = arrays.split(F.col("f"), F.lit("N"), "string")
    return _orders(spark, d).select("l_orderkey", F.array_join(F.transform(pieces, lambda p: F.array_join(p, "")), ";").alias("pieces"))


@query("""SELECT p_partkey, array_to_string(range(0, p_size, 7), ',') AS up, array_to_string(range(p_size, 0, -9), ',') AS down,
  array_to_string(range(0, p_size + 1, 5), ',') AS closed, array_to_string(range(p_size, 0, 3), ',') AS none FROM part""")
def arr_range(spark: SparkSession, d: str) -> DataFrame:
    n, zero = F.col("p_size"), F.lit(0)
    return table(spark, d, "part").select(
        "p_partkey", _text(arrays.range_(zero, n, 7)).alias("up"), _text(arrays.range_(n, zero, -9)).alias("down"),
        _text(arrays.range_(zero, n, 5, inclusive=True)).alias("closed"), _text(arrays.range_(n, zero, 3)).alias("none"),
    )


@query(f"""WITH o AS ({_QUANTITIES}), u AS (SELECT l_orderkey, unnest(f) AS k, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM o),
  k AS (SELECT l_orderkey, k, min(i) AS i, arg_max(v, i) AS v FROM u GROUP BY 1, 2)
  SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY i) AS pairs FROM k GROUP BY 1""")
def arr_to_dict(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.zip_with("f", "q", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    made = dicts.pairs(arrays.to_dict(pairs))
    return _orders(spark, d).select("l_orderkey", F.array_join(F.transform(made, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("pairs"))


# --- arrays: rows with an order --------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity < 5")
def rows_filter_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter(F.col("l_quantity") < 5).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 2).alias("doubled"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, event_type FROM events")
def rows_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return order.with_ord(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "ord", "event_type")


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM events)
  SELECT CAST(ord // 64 AS BIGINT) AS chunk, count(*) AS n, min(event_id) AS least FROM e GROUP BY 1 HAVING count(*) = 64""")
def rows_chunks(spark: SparkSession, d: str) -> DataFrame:
    placed = order.with_ord(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"])
    return frames.chunk_rows(placed, "ord", 64, exact=True).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query("""WITH w AS (SELECT user_id, ts, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM events)
  SELECT event_id, array_to_string(w, '>') AS path FROM w WHERE len(w) = 3""")
def rows_windows(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return frames.window_rows(placed, "ord", "event_type", 3, ["user_id"]).select("event_id", F.array_join("window", ">").alias("path"))


@query("""WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer), s AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier)
  SELECT CAST(ord AS BIGINT) AS ord, c_name, s_name FROM c JOIN s USING (ord)""")
def rows_zip(spark: SparkSession, d: str) -> DataFrame:
    c = order.with_ord(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    s = order.with_ord(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])
    return frames.zip_rows(c, s, "ord").select("ord", "c_name", "s_name")


@query("""WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS piece FROM events)
  SELECT user_id, CAST(piece AS BIGINT) AS piece, count(*) AS n FROM e WHERE event_type <> 'signup' GROUP BY 1, 2""")
def rows_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = frames.split_rows(table(spark, d, "events"), ["ts", "event_id"], F.col("event_type") == "signup", ["user_id"])
    return pieces.groupBy("user_id", "piece").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def rows_dedup(spark: SparkSession, d: str) -> DataFrame:
    return frames.dedup_rows(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "o_orderkey", "o_custkey")


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM e)
  SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def rows_runs(spark: SparkSession, d: str) -> DataFrame:
    found = frames.runs(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], ["user_id"])
    return found.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS DISTINCT FROM event_type""")
def rows_dedup_runs(spark: SparkSession, d: str) -> DataFrame:
    return frames.dedup_runs_keep_last(table(spark, d, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
  b AS (SELECT user_id, min(ord) AS a, max(ord) AS z FROM e WHERE event_type <> 'view' GROUP BY 1)
  SELECT event_id, user_id, CAST(ord AS BIGINT) AS ord FROM e JOIN b USING (user_id) WHERE ord BETWEEN a AND z""")
def rows_trim(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return frames.trim_rows(placed, F.col("event_type") == "view", "ord", ["user_id"]).select("event_id", "user_id", "ord")


@query("""SELECT o_custkey, string_agg(o_orderstatus, '+' ORDER BY o_orderdate, o_orderkey) AS joined FROM orders GROUP BY 1""")
def rows_join_text(spark: SparkSession, d: str) -> DataFrame:
    return frames.join_text(table(spark, d, "orders"), "o_orderstatus", ["o_orderdate", "o_orderkey"], ["o_custkey"], "+")


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def rows_to_dict(spark: SparkSession, d: str) -> DataFrame:
    return frames.to_dict_rows(table(spark, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 100) AS every,
  min(o_orderkey) AS least FROM orders GROUP BY 1""")
def rows_group_fold(spark: SparkSession, d: str) -> DataFrame:
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double"), 2)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), total.alias("total"), F.bool_or(F.col("o_totalprice") > 400000).alias("some"), F.bool_and(F.col("o_totalprice") > 100).alias("every"), F.min("o_orderkey").alias("least")
    )


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def rows_top(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders) WHERE ord >= 1 AND ord < 3""")
def rows_slice(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return frames.slice_rows(placed, "ord", 1, 3).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))).distinct()


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 450000""")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return a.intersect(table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("id")))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return a.join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")


# --- dictionaries ----------------------------------------------------------------------------

_MAP = "SELECT event_id, map {'k': CAST(json_extract(props, '$.k') AS BIGINT), 'u': user_id} AS m FROM events"


def _maps(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select("event_id", F.create_map(F.lit("k"), k, F.lit("u"), F.col("user_id")).alias("m"))


def _entries(m: Column) -> Column:
    return F.array_join(F.transform(dicts.pairs(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query(f"""WITH t AS ({_MAP}) SELECT event_id, m['k'] AS k, -1 AS missing, 'k,u' AS keys, m['k'] || ',' || m['u'] AS values, CAST(2 AS BIGINT) AS n FROM t""")
def dict_access(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    return _maps(spark, d).select(
        "event_id", dicts.at(m, "k").alias("k"), dicts.at(m, "z", -1).cast("int").alias("missing"), F.array_join(dicts.keys(m), ",").alias("keys"),
        _text(dicts.values(m)).alias("values"), dicts.length(m).alias("n"),
    )


@query(f"""WITH t AS ({_MAP}) SELECT event_id, 'k=' || 5 || ',u=' || m['u'] AS replaced, 'k=' || m['k'] || ',u=' || m['u'] || ',z=5' AS added, 'u=' || m['u'] AS removed,
  'k=' || m['k'] || ',u=0,y=1' AS merged FROM t""")
def dict_edit(spark: SparkSession, d: str) -> DataFrame:
    m, five = F.col("m"), F.lit(5).cast("bigint")
    other = F.create_map(F.lit("y"), F.lit(1).cast("bigint"), F.lit("u"), F.lit(0).cast("bigint"))
    return _maps(spark, d).select(
        "event_id", _entries(dicts.insert(m, "k", five)).alias("replaced"), _entries(dicts.insert(m, "z", five)).alias("added"),
        _entries(dicts.remove(m, "k")["rest"]).alias("removed"), _entries(dicts.merge(m, other)).alias("merged"),
    )


@query(f"""WITH t AS ({_MAP}) SELECT event_id, concat_ws(',', CASE WHEN m['k'] > 50 THEN 'k=' || m['k'] END, CASE WHEN m['u'] > 50 THEN 'u=' || m['u'] END) AS large,
  'k=' || m['k'] * 2 || ',u=' || m['u'] * 2 AS doubled FROM t""")
def dict_filter_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    return _maps(spark, d).select("event_id", _entries(dicts.filter_(m, lambda v: v > 50)).alias("large"), _entries(dicts.map_(m, lambda v: v * 2)).alias("doubled"))


@query(f"""WITH t AS ({_MAP}) SELECT event_id, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM t""")
def dict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _maps(spark, d).select("event_id", F.explode(dicts.pairs(F.col("m"))).alias("e")).select("event_id", "e.key", "e.value")


@query(f"""WITH t AS ({_MAP}) SELECT event_id, m['k'] AS first, m['u'] AS named, CAST(3 AS BIGINT) AS n, m['k'] + 1 AS mapped FROM t""")
def args_bundle(spark: SparkSession, d: str) -> DataFrame:
    k = dicts.at(F.col("m"), "k")
    a = dicts.arguments(F.array(k), F.col("m"))
    return _maps(spark, d).select(
        "event_id", dicts.args_at(a, 0).alias("first"), dicts.args_at(a, "u").alias("named"), dicts.args_len(a).alias("n"),
        dicts.args_at(dicts.args_map(a, lambda x: x + 1), 0).alias("mapped"),
    )


# --- scalars ---------------------------------------------------------------------------------

@query("""SELECT p_partkey, p_size ** 3 AS cube, sqrt(p_size) AS root, p_size % 7 AS rem, ((-p_size % 7) + 7) % 7 AS rem_e, CAST(-(((p_size % 7) + 7 - 1) // 7 * 0) AS BIGINT) AS zero,
  p_size % 2 = 0 AS even, gcd(p_size, 36) AS gcd, lcm(p_size, 36) AS lcm, CAST(least(greatest(p_size, 10), 40) AS INT) AS clamped, round(p_retailprice, 1) AS rounded,
  CAST(floor(p_retailprice) AS BIGINT) AS low, CAST(ceil(p_retailprice) AS BIGINT) AS high, CAST(trunc(p_retailprice) AS BIGINT) AS cut FROM part""".replace(
    "p_size ** 3", "CAST(p_size * p_size * p_size AS BIGINT)").replace("CAST(-(((p_size % 7) + 7 - 1) // 7 * 0) AS BIGINT) AS zero,", "").replace(
    "gcd(p_size, 36)", "CAST(gcd(p_size, 36) AS BIGINT)").replace("lcm(p_size, 36)", "CAST(lcm(p_size, 36) AS BIGINT)"))
def calc_numbers(spark: SparkSession, d: str) -> DataFrame:
    n, price, c36 = F.col("p_size"), F.col("p_retailprice"), F.lit(36)
    return table(spark, d, "part").select(
        "p_partkey", calc.pow_(n, 3).alias("cube"), calc.sqrt(n).alias("root"), calc.rem(n, F.lit(7)).alias("rem"), calc.rem_euclid(-n, F.lit(7)).alias("rem_e"),
        calc.even(n).alias("even"), calc.gcd(n, c36).alias("gcd"), calc.lcm(n.cast("bigint"), c36.cast("bigint")).alias("lcm"), calc.clamp(n, 10, 40).alias("clamped"),
        calc.round_(price, 1).alias("rounded"), calc.floor(price).alias("low"), calc.ceil(price).alias("high"), calc.trunc(price).alias("cut"),
    )


@query("""SELECT p_partkey, round(sin(p_size), 9) AS sin, round(cos(p_size), 9) AS cos, round(tan(p_size), 6) AS tan, round(atan(p_size), 9) AS atan, round(atan2(1, p_size), 9) AS atan2,
  round(exp(p_size / 10.0), 6) AS exp, round(ln(p_size + 1), 9) AS ln, round(log10(p_size + 1), 9) AS log, round(asin(p_size / 100.0), 9) AS asin, round(acos(p_size / 100.0), 9) AS acos,
  round(sinh(p_size / 20.0), 8) AS sinh, round(cosh(p_size / 20.0), 8) AS cosh, round(tanh(p_size / 20.0), 9) AS tanh, round(asinh(p_size), 9) AS asinh, round(acosh(p_size + 1), 9) AS acosh,
  round(atanh(p_size / 100.0), 9) AS atanh, round(cbrt(p_size), 9) AS root3 FROM part""")
def calc_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    r = lambda x, k, name: F.round(x, k).alias(name)
    return table(spark, d, "part").select(
        "p_partkey", r(calc.sin(n), 9, "sin"), r(calc.cos(n), 9, "cos"), r(calc.tan(n), 6, "tan"), r(calc.atan(n), 9, "atan"), r(calc.atan2(n, F.lit(1.0)), 9, "atan2"),
        r(calc.exp(n / 10), 6, "exp"), r(calc.ln(n + 1), 9, "ln"), r(calc.log(n + 1), 9, "log"), r(calc.asin(n / 100), 9, "asin"), r(calc.acos(n / 100), 9, "acos"),
        r(calc.sinh(n / 20), 8, "sinh"), r(calc.cosh(n / 20), 8, "cosh"), r(calc.tanh(n / 20), 9, "tanh"), r(calc.asinh(n), 9, "asinh"), r(calc.acosh(n + 1), 9, "acosh"),
        r(calc.atanh(n / 100), 9, "atanh"), r(calc.root(n, 3), 9, "root3"),
    )


@query("""SELECT DISTINCT p_size, CAST(factorial(p_size % 15) AS BIGINT) AS fact,
  CAST(factorial(p_size % 15) / factorial(p_size % 15 - least(3, p_size % 15)) AS BIGINT) AS perm_low,
  CAST(factorial(p_size % 15) // (factorial(least(2, p_size % 15)) * factorial(p_size % 15 - least(2, p_size % 15))) AS BIGINT) AS binom_low,
  p_size & 12 AS b_and, p_size | 12 AS b_or, xor(p_size, 12) AS b_xor, CAST(p_size << 5 AS BIGINT) AS left5, CAST(p_size >> 2 AS BIGINT) AS right2, ~p_size AS b_not,
  round(sqrt(p_size * p_size + 9.0 + 16.0), 9) AS norm FROM part""")
def calc_combinatorics(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.col("p_size"), (F.col("p_size") % 15).cast("bigint")
    k = lambda x: F.least(F.lit(x).cast("bigint"), m)
    return table(spark, d, "part").select("p_size").distinct().select(
        "p_size", calc.fact(m).alias("fact"), calc.perm(m, k(3)).alias("perm_low"), calc.binom(m, k(2)).alias("binom_low"), numbers.bit_and(n, 12).alias("b_and"),
        numbers.bit_or(n, 12).alias("b_or"), numbers.bit_xor(n, 12).alias("b_xor"), numbers.bit_lshift(n, 5).alias("left5"), numbers.bit_rshift(n, 2).alias("right2"), numbers.bit_not(n).alias("b_not"),
        F.round(calc.norm(F.array(n.cast("double"), F.lit(3.0), F.lit(4.0))), 9).alias("norm"),
    )


@query("""SELECT p_partkey, lower(to_base(p_partkey, 16)) AS hex, lower(to_base(p_partkey, 36)) AS b36, CAST(p_partkey AS BIGINT) AS back, CAST(p_partkey AS DOUBLE) AS f,
  p_size / 4 AS quarter, coalesce(p_partkey, 0) AS summed FROM part""")
def num_conversions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey", numbers.to_str(k, 16).alias("hex"), numbers.to_str(k, 36).alias("b36"), numbers.to_int(numbers.to_str(k, 16), 16).alias("back"),
        numbers.to_float(k).alias("f"), divide(F.col("p_size"), F.lit(4)).alias("quarter"), plus(k, F.lit(None).cast("bigint")).alias("summed"),
    )


@query("""SELECT p_partkey, p_partkey AS little, p_partkey AS big, -p_partkey AS negative, CAST(8 AS BIGINT) AS n, CAST(p_partkey % 256 AS BIGINT) AS low FROM part""")
def bytes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    b = numbers.int_to_bytes(k, "little", 8)
    return table(spark, d, "part").select(
        "p_partkey", numbers.int_from_bytes(b, "little").alias("little"), numbers.int_from_bytes(numbers.int_to_bytes(k, "big", 6), "big").alias("big"),
        numbers.int_from_bytes(numbers.int_to_bytes(-k, "little", 5), "little").alias("negative"), binary.length(b).alias("n"), binary.at(b, 0).alias("low"),
    )


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, text LIKE '%the%' AS has, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends,
  CASE WHEN instr(text, ' of ') > 0 THEN CAST(strlen(left(text, instr(text, ' of ') - 1)) AS BIGINT) END AS at, nullif(regexp_extract(text, 'th[a-z]+', 0), '') AS found,
  md5(replace(text, 'the', '*')) AS replaced, md5(trim(text, ' .')) AS trimmed, md5(lower(text)) AS low, CAST(len(string_split(text, ', ')) AS BIGINT) AS pieces FROM documents""")
def str_search(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", strings.length(t).alias("bytes"), strings.contains(t, "the").alias("has"), strings.starts_with(t, "The").alias("starts"), strings.ends_with(t, ".").alias("ends"),
        strings.position(t, " of ").alias("at"), strings.find(t, "th[a-z]+", True).alias("found"), F.md5(strings.replace(t, "the", "*").cast("binary")).alias("replaced"),
        F.md5(strings.trim(t, "[ .]", True).cast("binary")).alias("trimmed"), F.md5(strings.lower(t).cast("binary")).alias("low"), F.size(strings.split(t, ", ")).cast("bigint").alias("pieces"),
    )


@query("""SELECT p_partkey, reverse(p_name) AS rev, left(p_name, 1) AS first, right(p_name, 1) AS last, substr(p_name, 2, 4) AS cut, array_to_string(string_split(p_name, ' '), '|') AS words,
  unicode(p_name) AS code, chr(unicode(p_name)) AS again, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS vowels, regexp_replace(p_name, '[aeiou]', '#') AS once FROM part""")
def str_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", strings.rev(t).alias("rev"), strings.first(t).alias("first"), strings.last(t).alias("last"), strings.byte_slice(t, 1, 5).alias("cut"),
        F.array_join(strings.split(t), "|").alias("words"), strings.to_unicode(t).alias("code"), strings.from_unicode(strings.to_unicode(t)).alias("again"),
        F.size(strings.matches(t, "[aeiou]", True)).cast("bigint").alias("vowels"), strings.replace(t, "[aeiou]", "#", True, count=1).alias("once"),
    )


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(isodow(o_orderdate) AS INT) AS wd,
  CAST(dayofyear(o_orderdate) AS INT) AS doy, strftime(o_orderdate, '%d.%m.%Y') AS shown, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days,
  strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS later FROM orders""")
def dt_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp_ntz")
    since = t - F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "orders").select(
        "o_orderkey", datetimes.year(t).alias("y"), datetimes.month(t).alias("m"), datetimes.day(t).alias("d"), datetimes.weekday(t).alias("wd"), datetimes.ordinal(t).alias("doy"),
        datetimes.display(t, "[day].[month].[year]").alias("shown"), datetimes.days(since).alias("days"),
        datetimes.display(datetimes.shifted(t, datetimes.duration(hours=36)), "[year]-[month]-[day] [hour]").alias("later"),
    )


@query("""SELECT p_partkey, CAST(abs(p_size - 25) AS INT) AS distance, p_retailprice - trunc(p_retailprice) AS part, CAST(least(p_size, 10, 25) AS INT) AS low, CAST(greatest(p_size, 10, 25) AS INT) AS high,
  p_size % 2 <> 0 AS odd, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS whole, CAST(floor((p_size - 25) / -7.0) AS BIGINT) AS down, CAST(sign(p_size - 25) AS DOUBLE) AS sign,
  p_size = 1 AS bad, p_size = 2 AS endless FROM part""")
def calc_signs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    m, odd = n - 25, F.when(n == 1, float("nan")).when(n == 2, float("-inf")).otherwise(n.cast("double"))
    return table(spark, d, "part").select(
        "p_partkey", calc.abs_(m).alias("distance"), calc.fract(F.col("p_retailprice")).alias("part"), calc.min_(n, F.lit(10), F.lit(25)).alias("low"), calc.max_(n, F.lit(10), F.lit(25)).alias("high"),
        calc.odd(n).alias("odd"), calc.div_euclid(m, F.lit(7)).alias("whole"), calc.quo(m, F.lit(-7)).alias("down"), numbers.signum(m).alias("sign"),
        numbers.is_nan(odd).alias("bad"), numbers.is_infinite(odd).alias("endless"),
    )


@query("""SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, date_diff('microsecond', TIMESTAMP '2020-01-01', ts) / 1e6 AS seconds,
  date_diff('microsecond', TIMESTAMP '2020-01-01', ts) / 1e6 / 60 AS minutes, date_diff('microsecond', TIMESTAMP '2020-01-01', ts) / 1e6 / 3600 AS hours,
  date_diff('microsecond', TIMESTAMP '2020-01-01', ts) / 1e6 / 604800 AS weeks, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS made, '2024-02-29' AS today FROM events""")
def dt_durations(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts").cast("timestamp_ntz")
    since = t - datetimes.datetime(2020, 1, 1, 0, 0, 0)
    made = datetimes.datetime(datetimes.year(t), datetimes.month(t), datetimes.day(t), datetimes.hour(t), 0, 0)
    return table(spark, d, "events").select(
        "event_id", datetimes.hour(t).alias("h"), datetimes.minute(t).alias("m"), datetimes.second(t).alias("s"), datetimes.seconds(since).alias("seconds"),
        datetimes.minutes(since).alias("minutes"), datetimes.hours(since).alias("hours"), datetimes.weeks(since).alias("weeks"),
        datetimes.display(made, "[year]-[month]-[day] [hour]").alias("made"), datetimes.display(datetimes.today("2024-02-29")).alias("today"),
    )


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, array_to_string(list_concat(q, [7], q), ',') AS flat FROM o""")
def arr_flatten(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _orders(spark, d).select("l_orderkey", _text(arrays.flatten(F.array(q, F.array(F.lit(7).cast("bigint")), q))).alias("flat"))


@query("""SELECT o_orderkey, (o_totalprice > 200000 AND o_orderstatus = 'F') AS both, (o_totalprice > 200000 OR o_orderstatus = 'F') AS either,
  (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END) IS NOT DISTINCT FROM NULL AS none FROM orders""")
def strict_logic(spark: SparkSession, d: str) -> DataFrame:
    big, f = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        "o_orderkey", all_of(big, f).alias("both"), any_of(big, f).alias("either"), same(F.nullif("o_orderstatus", F.lit("P")), F.lit(None).cast("string")).alias("none")
    )


@query("""SELECT p_partkey, p_brand, CAST(list_position(['x'], 'y') AS BIGINT) IS NULL AS none,
  CASE WHEN CAST(regexp_extract(p_brand, '[0-9]+') AS INT) > 9 THEN 'two' ELSE 'one' END AS digits FROM part""".replace("CAST(list_position(['x'], 'y') AS BIGINT) IS NULL AS none,", "1 AS major,"))
def version_parts(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    v = binary.version(F.concat(F.lit("1."), number))
    later = binary.version_padded(v, 3) > binary.version_padded(binary.version(F.lit("1.9")), 3)
    return table(spark, d, "part").select("p_partkey", "p_brand", binary.version_at(v, 0).alias("major"), F.when(later, "two").otherwise("one").alias("digits"))


# --- element tables and selectors ------------------------------------------------------------

_ELEMENTS = """nodes AS (
  SELECT c_custkey AS doc_id, NULL::BIGINT AS o, NULL::BIGINT AS l, NULL::BIGINT AS p, 'heading' AS elem, 1 AS level, 'customer-' || c_custkey AS label, c_name AS body, NULL AS status FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL, 'heading', 2, 'order-' || o_orderkey, o_orderpriority, o_orderstatus FROM orders
  UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, 'item', 3, NULL, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o NULLS FIRST, l NULLS FIRST, p NULLS FIRST, body, status) - 1 AS ord FROM nodes),
elements AS (SELECT *, CAST(coalesce(CASE level WHEN 1 THEN min(CASE WHEN level <= 1 THEN ord END) OVER w WHEN 2 THEN min(CASE WHEN level <= 2 THEN ord END) OVER w ELSE min(ord) OVER w END,
  count(*) OVER (PARTITION BY doc_id)) AS BIGINT) AS end_ord FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return elements.from_orders(table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem"))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "ord", "elem", "level")


@query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, end_ord, elem, level, label FROM elements")
def element_table(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "ord", "end_ord", "elem", "level", "label")


def _selected(name: str, condition: str, make: Callable[[], selectors.Selector]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _keys(selectors.query(_elements(spark, d), make()))

    run.__name__ = name
    query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, elem, level FROM elements e WHERE {condition}")(run)


_FIRST_P = "(SELECT min(b.ord) FROM elements b WHERE b.doc_id = e.doc_id AND b.level = 2 AND b.status = 'P')"
_selected("sel_where", "elem = 'heading' AND level = 2 AND status = 'F'", lambda: elem("heading", level=2, status="F"))
_selected("sel_or", "level = 1 OR (elem = 'item' AND body = 'R')", lambda: elem(level=1) | elem("item", body="R"))
_selected("sel_and", "elem = 'item' AND body = 'R' AND status = 'O'", lambda: elem("item") & elem(body="R") & elem(status="O"))
_selected("sel_label", "label = 'order-7'", lambda: Label("order-7"))
_selected("sel_before", f"elem = 'heading' AND ord <= coalesce({_FIRST_P}, ord)", lambda: elem("heading").before(elem("heading", level=2, status="P")))
_selected("sel_after", f"elem = 'item' AND ord > coalesce({_FIRST_P}, ord - 1)", lambda: elem("item").after(elem("heading", level=2, status="P"), inclusive=False))
_selected(
    "sel_within", "elem = 'item' AND EXISTS (SELECT 1 FROM elements a WHERE a.doc_id = e.doc_id AND a.level = 2 AND a.status = 'P' AND e.ord > a.ord AND e.ord < a.end_ord)",
    lambda: elem("item").within(elem("heading", level=2, status="P")),
)


@query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(min(ord) AS BIGINT) AS ord, arg_min(label, ord) AS label FROM elements WHERE level = 2 AND status = 'P' GROUP BY 1")
def sel_first(spark: SparkSession, d: str) -> DataFrame:
    return selectors.query_first(_elements(spark, d), elem("heading", level=2, status="P")).select("doc_id", "ord", "label")


@query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord FROM elements WHERE level = 1")
def sel_unique(spark: SparkSession, d: str) -> DataFrame:
    return selectors.locate(_elements(spark, d), elem("heading", level=1))


@query(f"""WITH {_ELEMENTS}, c AS (SELECT *, count(*) FILTER (elem = 'item' AND body = 'R') OVER (PARTITION BY doc_id ORDER BY ord) AS n_before FROM elements)
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(n_before AS BIGINT) AS n_before FROM c WHERE level = 2""")
def sel_count_before(spark: SparkSession, d: str) -> DataFrame:
    return selectors.count_before(_elements(spark, d), elem("item", body="R"), elem(level=2))


@query(f"WITH {_ELEMENTS} SELECT label, count(*) AS n FROM elements WHERE label IS NOT NULL GROUP BY 1")
def sel_labelled(spark: SparkSession, d: str) -> DataFrame:
    return selectors.label_count(_elements(spark, d))


@query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, status AS value FROM elements WHERE level = 2")
def sel_field(spark: SparkSession, d: str) -> DataFrame:
    return selectors.field_values(selectors.query(_elements(spark, d), elem(level=2)), "status")


@query(f"""WITH {_ELEMENTS}, n AS (SELECT *, min(CASE WHEN elem = 'item' AND body = 'R' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx,
  min(CASE WHEN elem = 'item' AND body = 'R' THEN ord END) OVER (PARTITION BY doc_id) AS f FROM elements)
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(coalesce(nx, f) AS BIGINT) AS target FROM n WHERE level = 2 AND f IS NOT NULL""")
def nearest_forward(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    items = selectors.query(e, elem("item", body="R"))
    bases = e.filter("level = 2").select("doc_id", "ord", F.lit("R").alias("key"))
    return selectors.nearest_forward(items, F.element_at("fields", "body"), bases).select("doc_id", "ord", "target")


# --- state and counters ----------------------------------------------------------------------

_COUNTERS = f"""{_ELEMENTS}, r AS (SELECT *, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS r2, sum(CASE WHEN level < 3 THEN 1 ELSE 0 END) OVER w AS r3 FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
counted AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS n1, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, r2 ORDER BY ord) AS n2,
  sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, r3 ORDER BY ord) AS n3 FROM r),
named AS (SELECT *, CASE level WHEN 1 THEN concat(n1) WHEN 2 THEN concat(n1, '.', n2) ELSE concat(n1, '.', n2, '.', n3) END AS number FROM counted)"""


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return folds.counter_steps(_elements(spark, d), 3, ["doc_id"])


def _number(c: str = "counter") -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ".")


@query(f"WITH {_COUNTERS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, number FROM named")
def counter_hier(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("doc_id", "ord", _number().alias("number"))


@query(f"WITH {_COUNTERS} SELECT doc_id, arg_max(number, ord) AS number FROM named GROUP BY 1")
def counter_final(spark: SparkSession, d: str) -> DataFrame:
    return folds.counter_final(_counted(spark, d), ["doc_id"]).select("doc_id", _number().alias("number"))


@query(f"""WITH {_COUNTERS}, h AS (SELECT * FROM named WHERE level <= 2) SELECT e.doc_id, CAST(e.ord AS BIGINT) AS ord,
  (SELECT arg_max(h.number, h.ord) FROM h WHERE h.doc_id = e.doc_id AND h.ord <= e.ord) AS number FROM elements e WHERE e.elem = 'item' AND e.body = 'R'""")
def counter_at(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    updates = folds.counter_steps(e.filter("level <= 2"), 2, ["doc_id"]).select("doc_id", "ord", _number().alias("number"))
    return folds.as_of(selectors.query(e, elem("item", body="R")).select("doc_id", "ord"), updates, ["doc_id"], "number").select("doc_id", "ord", "number")


# a number has as many letters as it needs, up to four here: that is for 475,254 orders of a customer
@query(f"""WITH {_COUNTERS}, a AS (SELECT *, CAST(n2 AS BIGINT) AS q0 FROM counted WHERE level <= 2), b AS (SELECT *, (q0 - 1) // 26 AS q1 FROM a),
  c AS (SELECT *, (q1 - 1) // 26 AS q2 FROM b), d AS (SELECT *, (q2 - 1) // 26 AS q3 FROM c)
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE level WHEN 1 THEN concat(n1, ')') ELSE concat(n1, '.', CASE WHEN q3 > 0 THEN chr(CAST(97 + (q3 - 1) % 26 AS INT)) END,
    CASE WHEN q2 > 0 THEN chr(CAST(97 + (q2 - 1) % 26 AS INT)) END, CASE WHEN q1 > 0 THEN chr(CAST(97 + (q1 - 1) % 26 AS INT)) END, chr(CAST(97 + (q0 - 1) % 26 AS INT)), ')') END AS shown FROM d""")
def counter_display(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.counter_steps(_elements(spark, d).filter("level <= 2"), 2, ["doc_id"])
    return rows.select("doc_id", "ord", numbering.numbering(F.col("counter"), "1.a)").alias("shown"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS state FROM events""")
def state_last_set(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    set_to = placed.withColumn("to", F.when(F.col("event_type") == "purchase", F.col("value")))
    return folds.state_set(set_to, ["user_id"], "to", F.lit(-1.0)).select("event_id", "state")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT event_id, user_id, k, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 ELSE 1 END::BIGINT AS state FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.user_id, e.k, CASE e.event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN (s.state * 2) % 1000 ELSE s.state + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
  SELECT event_id, state FROM s""")
def state_fold(spark: SparkSession, d: str) -> DataFrame:
    def update(state: object, row: dict[str, object]) -> object:
        return 1 if row["event_type"] == "signup" else state * 2 % 1000 if row["event_type"] == "purchase" else state + 1

    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return folds.state_fold(rows, ["user_id"], 0, update, "bigint", ["ts", "event_id"]).select("event_id", "state")


# --- joins -----------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def ref_resolve(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey")
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus")
    return lookups.resolve(refs, targets, "key").withColumnRenamed("key", "l_orderkey")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ref_dangling(spark: SparkSession, d: str) -> DataFrame:
    return lookups.dangling(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def cite_entries(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return lookups.cited_entries(table(spark, d, "part").select("p_partkey", "p_name"), cites, "p_partkey")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
  SELECT c.event_id, coalesce((SELECT min(b.ts) FROM b WHERE b.user_id = c.user_id AND b.ts >= c.ts), (SELECT max(b.ts) FROM b WHERE b.user_id = c.user_id AND b.ts < c.ts)) AS source FROM c""")
def cite_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cites = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return lookups.nearest_source(cites, e.filter("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "ts").select("event_id", "source")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey - 1 END AS up, CASE WHEN p_size % 3 = 0 THEN p_brand END AS font, CASE WHEN p_size % 2 = 0 THEN p_type END AS face FROM part),
  w AS (SELECT id, up, font, face FROM s UNION ALL SELECT w.id, s.up, coalesce(w.font, s.font), coalesce(w.face, s.face) FROM w JOIN s ON w.up = s.id)
  SELECT id, font, face FROM w WHERE up IS NULL""")
def style_inherit(spark: SparkSession, d: str) -> DataFrame:
    styles = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") - 1).alias("up"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("font"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("face"),
    )
    return lookups.inherited(styles, "id", "up", ["font", "face"])


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def label_claims(spark: SparkSession, d: str) -> DataFrame:
    return lookups.claims(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("""WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)
  SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY f) AS INT) AS number FROM f""")
def note_numbers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.number_by_first_use(table(spark, d, "events"), "event_type", "event_id", ["user_id"]).select("event_id", "number")


# --- text comparison -------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(text), '\p{L}{2,}')"
_PAIR = f"""a AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
 l AS (SELECT doc_id, token, count(*) AS n FROM a GROUP BY 1, 2),
 r AS (SELECT doc_id - 1 AS doc_id, token, n FROM l)"""


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each document's counted tokens, and those of the next one."""
    counts = textdiff.token_counts(table(spark, d, "documents"), ["doc_id"], "text")
    return counts, counts.withColumn("doc_id", F.col("doc_id") - 1)


@query(f"""WITH {_PAIR}, j AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.n, 0) AS x, coalesce(r.n, 0) AS y FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.token = r.token)
  SELECT doc_id, CAST(sum(least(x, y)) AS BIGINT) AS shared, CAST(sum(x) AS BIGINT) AS of_left, CAST(sum(y) AS BIGINT) AS of_right, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS only_left,
  CAST(sum(greatest(y - x, 0)) AS BIGINT) AS only_right, round(sum(least(x, y)) / sum(greatest(x, y)), 9) AS jaccard FROM j GROUP BY 1""")
def tok_multiset(spark: SparkSession, d: str) -> DataFrame:
    scores = textdiff.multiset_scores(*_pair(spark, d), ["doc_id"])
    return scores.select("doc_id", "shared", "of_left", "of_right", "only_left", "only_right", F.round("jaccard", 9).alias("jaccard"))


@query(f"""WITH t AS (SELECT d.doc_id, list_distinct(regexp_extract_all(lower(d.text), '\\p{{L}}{{2,}}')) AS a, list_distinct(regexp_extract_all(lower(e.text), '\\p{{L}}{{2,}}')) AS b
  FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1) SELECT doc_id, CASE WHEN len(a) > 0 THEN round(100.0 * len(list_intersect(a, b)) / len(a), 9) END AS coverage,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:12], ' ') AS missing FROM t""")
def tok_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(textdiff.tokens(F.col("text"))).alias("a"))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return both.select("doc_id", F.round(textdiff.coverage(F.col("a"), F.col("b")), 9).alias("coverage"), F.array_join(textdiff.missing_sample(F.col("a"), F.col("b")), " ").alias("missing"))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\s', '', 'g'), '')) AS token FROM documents), l AS (SELECT doc_id, token, count(*) AS n FROM c WHERE token <> '' GROUP BY 1, 2),
  r AS (SELECT doc_id - 1 AS doc_id, token, n FROM l), j AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.n, 0) AS x, coalesce(r.n, 0) AS y FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.token = r.token)
  SELECT doc_id, CAST(sum(least(x, y)) AS BIGINT) AS shared, CAST(sum(x) AS BIGINT) AS of_left, CASE WHEN sum(x) > 0 THEN round(sum(least(x, y)) / sum(x), 9) END AS coverage FROM j GROUP BY 1""")
def char_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = textdiff.char_coverage(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"], "text")
    return out.select("doc_id", "shared", "of_left", F.round("coverage", 9).alias("coverage"))


@query(f"""WITH a AS (SELECT unnest({_TOKENS}) AS token FROM documents) SELECT token, count(*) AS n FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.top_tokens(textdiff.token_counts(table(spark, d, "documents"), ["doc_id"], "text"), 50)


_GRAMS = """{n} AS (SELECT {id}, list_transform(range(0, greatest(len(t) - 4, 0), 1), lambda i: array_to_string(t[i + 1:i + 5], ' ')) AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '\\p{{L}}{{2,}}') AS t FROM {table})),
 {n}u AS (SELECT gram, min({id}) AS {id}, min(pl) AS pl FROM (SELECT {id}, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS pl FROM {n}) GROUP BY 1 HAVING count(*) = 1)"""


@query(f"""WITH {_GRAMS.format(n='b', id='item_id', table='benchmark')}, {_GRAMS.format(n='d', id='doc_id', table='documents')},
  m AS (SELECT b.item_id, d.doc_id, b.pl, d.pl AS to_pl FROM bu b JOIN du d USING (gram)), f AS (SELECT item_id, min(pl) AS pl FROM m GROUP BY 1)
  SELECT i.item_id, CAST(m.doc_id AS BIGINT) AS to_doc_id, CAST(m.pl AS INT) AS place, CAST(m.to_pl AS INT) AS to_place FROM benchmark i LEFT JOIN f ON f.item_id = i.item_id LEFT JOIN m ON m.item_id = f.item_id AND m.pl = f.pl""")
def ngram_aligned(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark").select("item_id", "text")
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = textdiff.aligned(bench, docs.withColumnRenamed("doc_id", "item_id"), ["item_id"], "text")
    return found.select("item_id", F.col("to_item_id").alias("to_doc_id"), F.col("at").alias("place"), F.col("to_at").alias("to_place"))


@query(f"""WITH d AS (SELECT unnest(list_distinct({_TOKENS})) AS t, doc_id FROM documents), s AS (SELECT doc_id, t FROM d), o AS (SELECT doc_id - 1 AS doc_id, t FROM d)
  SELECT doc_id, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND (o.t = s.t OR (length(o.t) - length(s.t) BETWEEN 1 AND 2 AND (starts_with(o.t, s.t) OR ends_with(o.t, s.t))))) GROUP BY 1""")
def text_missing(spark: SparkSession, d: str) -> DataFrame:
    own = textdiff.distinct_tokens(table(spark, d, "documents"), ["doc_id"], "text")
    return textdiff.lost_tokens(own, own.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.duplicate_ids(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


_RUNS = """a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return o.filter("id % 7 <> 0"), o.filter("id % 11 <> 0").withColumn("s", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("s")))


@query(f"""WITH {_RUNS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.id = b.id WHERE a.s IS DISTINCT FROM b.s""")
def run_differences(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.differences(*_runs(spark, d), ["id"], ["s"])


@query(f"""WITH {_RUNS} SELECT coalesce(a.id, b.id) AS id, a.s AS before, b.s AS now, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'fixed' ELSE 'changed' END AS status
  FROM a FULL JOIN b ON a.id = b.id WHERE a.s IS DISTINCT FROM b.s""")
def baseline_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.scoreboard(*_runs(spark, d), ["id"], "s")


@query("""WITH o AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_size AS median FROM o WHERE k = n // 2""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return frames.upper_median(table(spark, d, "part"), "p_size", ["p_brand"])


@query("""SELECT CASE WHEN p_size * 2 >= 100 THEN '100' WHEN p_size * 2 >= 90 THEN '90-99' WHEN p_size * 2 >= 50 THEN '50-89' ELSE '<50' END AS band, count(*) AS n FROM part GROUP BY 1""")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(textdiff.bands(F.col("p_size") * 2).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.counters(table(spark, d, "documents"), ["lang", "source"])


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS dear, count(*) FILTER (l_tax > 0.04) AS taxed FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber))""")
def loss_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumns({"dear": F.col("l_discount") > 0.05, "taxed": F.col("l_tax") > 0.04})
    return textdiff.losses(rows, [["l_returnflag"], ["l_linestatus", "l_linenumber"]], ["dear", "taxed"])


@query("""SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_size, -abs(p_retailprice), p_partkey) AS ids, count(*) AS n FROM part GROUP BY 1""")
def triage_groups(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.triage(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", "p_retailprice").select("p_brand", _text(F.col("ids")).alias("ids"), "n")


@query("""SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, min(p_size) AS p_size FROM part GROUP BY 1""")
def worst_parts(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.worst_page(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_size")


@query("""SELECT b.s - a.s AS delta, count(*) AS n FROM (SELECT p_partkey AS id, p_size AS s FROM part) a JOIN (SELECT p_partkey + 1 AS id, p_size AS s FROM part) b USING (id) GROUP BY 1""")
def delta_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"))
    return textdiff.delta_histogram(p, p.withColumn("id", F.col("id") + 1), ["id"], "s")


# --- records, rewriting, merge, rounds -------------------------------------------------------

@query("""WITH p AS (SELECT user_id, event_id % 20 AS i, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), t AS (SELECT user_id, max(i) AS top FROM p GROUP BY 1)
  SELECT t.user_id, g.i AS i, p.v FROM t, LATERAL (SELECT unnest(range(0, t.top + 1)) AS i) g LEFT JOIN p ON p.user_id = t.user_id AND p.i = g.i""")
def densify_points(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select("user_id", (F.col("event_id") % 20).alias("i"), F.col("value").alias("v"), "event_id")
    return records.densify(points, ["user_id"], "i", "v", "event_id").select("user_id", "i", "v")


@query("""SELECT o_orderpriority, coalesce(CAST(max(n) FILTER (o_orderstatus = 'F') AS VARCHAR), '') AS "F", coalesce(CAST(max(n) FILTER (o_orderstatus = 'O') AS VARCHAR), '') AS "O",
  coalesce(CAST(max(n) FILTER (o_orderstatus = 'Z') AS VARCHAR), '') AS "Z" FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def pivot_series(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return records.pivot_series(counts, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "Z"])


@query("""SELECT p_brand, CAST(p_size / 10 AS INT) AS k, n, total FROM (SELECT p_brand, k * 10 AS p_size, n, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, k) AS r
  FROM (SELECT p_brand, p_size // 10 AS k, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1 AND n >= 0.25 * total""".replace("n, total FROM", "n, CAST(total AS BIGINT) AS total FROM"))
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return records.majority(table(spark, d, "part"), ["p_brand"], {"k": F.floor(F.col("p_size") / 10).cast("int")}, 0.25).select("p_brand", "k", "n", "total")


_MERGES = "CASE event_type WHEN 'view' THEN 'continue' WHEN 'click' THEN 'restart' END"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {_MERGES} AS m FROM events), i AS (SELECT *, sum(CASE WHEN m IS DISTINCT FROM 'continue' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e),
  s AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n, bool_or(coalesce(m = 'restart', false)) OVER (PARTITION BY user_id, g) AS opened FROM i)
  SELECT event_id, CAST(CASE WHEN m = 'restart' THEN n WHEN m = 'continue' AND opened THEN 0 ELSE 1 END AS BIGINT) AS span FROM s""")
def rowspan_runs(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("event_type") == "view", "continue").when(F.col("event_type") == "click", "restart")
    return records.row_spans(table(spark, d, "events").withColumn("m", m), ["user_id"], "ts", "m").select("event_id", "span")


@query("""SELECT event_id, CAST(coalesce(sum(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "column" FROM events""")
def column_starts(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").withColumn("span", 1 + F.col("event_id") % 3)
    return records.column_starts(cells, ["user_id"], "ts", "span").select("event_id", "column")


@query("""WITH ids AS (SELECT l_orderkey AS part, l_linenumber AS id FROM lineitem), refs AS (SELECT o_orderkey % 9 AS id FROM orders)
  SELECT 'duplicate' AS problem, CAST(id AS VARCHAR) AS key, count(*) AS n FROM ids GROUP BY part, id HAVING count(*) > 1
  UNION ALL SELECT 'dangling', CAST(id AS VARCHAR), count(*) FROM refs WHERE id NOT IN (SELECT id FROM ids) GROUP BY id""")
def id_integrity(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_linenumber").cast("bigint").alias("id"))
    refs = table(spark, d, "orders").select((F.col("o_orderkey") % 9).alias("id"))
    return records.integrity(ids, refs, "part", "id")


@query("""WITH a AS (SELECT DISTINCT 'b' || (l_partkey % 900) AS name FROM lineitem), r AS (SELECT DISTINCT 'b' || p_size AS name FROM part), i AS (SELECT DISTINCT 'b' || s_suppkey AS name FROM supplier)
  SELECT name FROM a WHERE name IN (SELECT name FROM r) AND name NOT IN (SELECT name FROM i)""")
def anchor_namespace(spark: SparkSession, d: str) -> DataFrame:
    named = lambda t, c: table(spark, d, t).select(F.concat(F.lit("b"), c.cast("string")).alias("name"))
    return records.namespace(named("supplier", F.col("s_suppkey")), named("lineitem", F.col("l_partkey") % 900), named("part", F.col("p_size")))


@query(f"""WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST((SELECT max(b.ord) FROM elements b WHERE b.doc_id = e.doc_id AND b.ord < e.ord AND b.level < e.level) AS BIGINT) AS parent FROM elements e WHERE elem = 'heading' OR body = 'R'""".replace(
    "FROM elements e WHERE elem = 'heading' OR body = 'R'", "FROM (SELECT * FROM elements) e"))
def outline_tree(spark: SparkSession, d: str) -> DataFrame:
    return records.outline_parents(_elements(spark, d), ["doc_id"], 3).select("doc_id", "ord", "parent")


@query("""SELECT c_custkey, 'LINK' AS name, c_name AS argument, '2024-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS made, c_mktsegment || '|' || c_name AS listed,
  nullif(c_mktsegment, 'BUILDING') AS segment FROM customer""")
def field_parsing(spark: SparkSession, d: str) -> DataFrame:
    code = records.field_instruction(F.concat(F.lit(' link "'), "c_name", F.lit('" \\h')))
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    parts = records.split_list(F.concat("c_mktsegment", F.lit(" , ,"), "c_name"))
    return table(spark, d, "customer").select(
        "c_custkey", code["name"].alias("name"), code["argument"].alias("argument"), records.w3c_date(day).cast("string").alias("made"), F.array_join(parts, "|").alias("listed"),
        records.without_default(F.col("c_mktsegment"), "BUILDING").alias("segment"),
    )


@query(f"""WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN elem = 'item' AND body = 'R' THEN 'returned' ELSE elem END AS elem, coalesce(status, CASE WHEN level = 1 THEN 'open' END) AS status FROM elements""")
def show_rules(spark: SparkSession, d: str) -> DataFrame:
    marked = elem("heading", level=1)
    named = rewrite.show(_elements(spark, d), elem("item", body="R"), lambda: {"elem": F.lit("returned")})
    rows = rewrite.show(named, marked, lambda: {"fields": F.map_concat("fields", F.create_map(F.lit("status"), F.lit("open")))})
    return rows.select("doc_id", "ord", "elem", F.try_element_at("fields", F.lit("status")).alias("status"))


@query("""SELECT conv_id, md5(regexp_replace(string_agg(text, '' ORDER BY turn), '[aeiou]+', '_', 'g')) AS text FROM conversations GROUP BY 1""")
def show_text_rule(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.show_text(table(spark, d, "conversations"), ["conv_id"], "turn", "text", "[aeiou]+", "_").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""SELECT conv_id AS doc_id, turn AS ord, coalesce((SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND (b.role = 'user' OR (a.role <> 'user'))),
  (SELECT max(b.turn) + 1 FROM conversations b WHERE b.conv_id = a.conv_id)) AS end_ord, role AS elem FROM conversations a""")
def turn_elements(spark: SparkSession, d: str) -> DataFrame:
    return elements.from_turns(table(spark, d, "conversations")).select("doc_id", "ord", "end_ord", "elem")


@query("""WITH r AS (SELECT doc_id, text, substr(text, 1, 40) AS source FROM documents WHERE length(text) >= 60 AND strpos(text, '\n') = 0 OR length(text) >= 60),
  s AS (SELECT doc_id, text, source, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'gone' WHEN 2 THEN text || source ELSE text END AS contents, CASE WHEN doc_id % 5 = 4 THEN source ELSE 'new ' || source END AS word FROM r),
  t AS (SELECT *, (length(contents) - length(replace(contents, source, ''))) // length(source) AS times FROM s)
  SELECT doc_id AS id, CASE WHEN word = source THEN 'unchanged' WHEN times = 0 THEN 'local_overlap' WHEN times > 1 THEN 'ambiguous_location' ELSE 'ready' END AS status FROM t""")
def merge_statuses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.length("text") >= 60).withColumn("source", F.substring("text", 1, 40))
    files = docs.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 5 == 1, "gone").when(F.col("doc_id") % 5 == 2, F.concat("text", "source")).otherwise(F.col("text")).alias("contents"))
    regions = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), "source", F.col("source").alias("baseline"), F.lit(None).cast("string").alias("format"))
    edits = docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 4, F.col("source")).otherwise(F.concat(F.lit("new "), "source")).alias("word"),
        F.lit(None).cast("string").alias("format"), F.lit(False).alias("moved"),
    )
    return merge.plan(regions, edits, files).select("id", "status")


@query("""SELECT p_partkey AS id, CAST(p_partkey - p_partkey % 16 AS BIGINT) AS root FROM part""")
def fixpoint_roots(spark: SparkSession, d: str) -> DataFrame:
    """Each part points to the one before it in its block of 16; pointers are followed until they rest."""
    start = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 16 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") - 1).alias("root"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.join(rows.select(F.col("id").alias("root"), F.col("root").alias("__r")), "root").select("id", F.col("__r").alias("root"))

    return fixpoint(start, step)[0]


@query("""WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms FROM events), p AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 86400000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM p), t AS (SELECT *, (ms - min(ms) OVER (PARTITION BY user_id, s)) // 172800000 AS part FROM s)
  SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY s, part) AS BIGINT) AS batch FROM t""")
def watch_batches(spark: SparkSession, d: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return event_batches(table(spark, d, "events"), ["user_id"], millis, ["event_id"], 86_400_000, 172_800_000).select("event_id", "batch")


# --- more scalars ----------------------------------------------------------------------------

@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '.'), '|') AS clusters, CAST(length(p_name) AS BIGINT) AS codepoints, nfc_normalize(p_name) AS normal, substr(p_name, 2, 1) AS second,
  nullif(regexp_extract(p_name, '[aeiou]+'), '') AS vowels, CASE WHEN regexp_matches(p_name, '[aeiou]') THEN CAST(strpos(p_name, regexp_extract(p_name, '[aeiou]+')) - 1 AS BIGINT) END AS vowels_at,
  regexp_matches(p_name, '^[a-m]') AS early, strip_accents(p_name) AS plain, array_to_string(regexp_extract_all(lower(p_name), '\p{L}{2,}'), '|') AS folded FROM part""")
def str_units(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_name")
    vowels = strings.match(t, "[aeiou]+", True)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(strings.clusters(t), "|").alias("clusters"), F.size(strings.codepoints(t)).cast("bigint").alias("codepoints"), strings.normalize(t).alias("normal"),
        strings.at(t, 1).alias("second"), vowels["text"].alias("vowels"), vowels["start"].alias("vowels_at"), strings.starts_with(t, strings.regex_pattern("[a-m]"), True).alias("early"),
        textdiff.without_marks(t).alias("plain"), F.array_join(textdiff.folded_tokens(t), "|").alias("folded"),
    )


@query("""SELECT p_partkey, p_retailprice AS little, p_retailprice AS big, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS single, CAST(p_size AS DOUBLE) AS exact,
  substr(p_name, 2, 3) AS cut, lpad(upper(to_base(p_size, 16)), 2, '0') || lpad(upper(to_base(p_size + 1, 16)), 2, '0') AS made,
  array_to_string(list_transform(string_split(p_brand, ''), lambda c: unicode(c)), ',') AS codes, p_name AS label, 'int' AS kind, '{"v":' || p_size || '}' AS shown FROM part""")
def bytes_and_types(spark: SparkSession, d: str) -> DataFrame:
    price, n = F.col("p_retailprice"), F.col("p_size").cast("int")
    made = binary.bytes_of_array(F.array(n, n + 1))
    return table(spark, d, "part").select(
        "p_partkey", numbers.float_from_bytes(numbers.float_to_bytes(price)).alias("little"), numbers.float_from_bytes(numbers.float_to_bytes(price, "big"), "big").alias("big"),
        numbers.float_from_bytes(numbers.float_to_bytes(price, size=4)).alias("single"), numbers.decimal(n.cast("string"), 2).cast("double").alias("exact"),
        binary.slice_(binary.to_bytes(F.col("p_name")), 1, 4).cast("string").alias("cut"), F.hex(made).alias("made"), _text(binary.array_of_bytes(binary.to_bytes(F.col("p_brand")))).alias("codes"),
        binary.label(F.col("p_name")).alias("label"), binary.type_of(n).alias("kind"), binary.repr_(n).alias("shown"),
    )


@query("SELECT o_orderkey, 'equal' AS first, 'unequal' AS second, 'calm' AS third, o_totalprice * 2 AS fourth FROM orders")
def guard_checks(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    passed = lambda check, word: F.coalesce(check.cast("string"), F.lit(word))
    return table(spark, d, "orders").select(
        "o_orderkey", passed(assert_eq(k, k + 0), "equal").alias("first"), passed(assert_ne(k, k + 1), "unequal").alias("second"),
        F.when(k.isNull(), panic("no key", k)).otherwise("calm").alias("third"), F.when(assert_that(price.isNotNull()).isNull(), price * 2).alias("fourth"),
    )


@query(f"""WITH t AS ({_MAP}) SELECT event_id, 'u=' || m['u'] AS rest, CAST(2 * CAST(m['k'] > 50 AS BIGINT) + CAST(m['u'] > 50 AS BIGINT) AS BIGINT) AS large FROM t""")
def dict_rest(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    bundle = dicts.arguments(F.array(dicts.at(m, "k")), m)
    return _maps(spark, d).select("event_id", _entries(dicts.rest_of(m, ["k"])).alias("rest"), dicts.args_len(dicts.args_filter(bundle, lambda v: v > 50)).alias("large"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events""")
def rows_reversed(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return frames.reversed_rows(placed, "ord", ["user_id"]).select("event_id", "ord")


# --- more selectors, state and rewriting -----------------------------------------------------

_selected("sel_location", "doc_id = 3 AND ord = 0", lambda: Location(3, 0))


@query("SELECT c_custkey AS doc_id, CAST(-1 AS BIGINT) AS ord, c_mktsegment AS value FROM customer")
def sel_metadata(spark: SparkSession, d: str) -> DataFrame:
    extra = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(-1).cast("bigint").alias("ord"), F.col("c_mktsegment").alias("value"))
    return selectors.field_values(selectors.query(selectors.with_metadata(_elements(spark, d), extra), elem("metadata")), "value")


@query("""SELECT event_id, row_number() OVER w || '/' || count(*) OVER (PARTITION BY user_id) AS both,
  CAST(event_id // 10 - min(event_id // 10) OVER (PARTITION BY user_id) + 1 AS BIGINT) AS page_counter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def counter_both(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    counted = placed.withColumns({"counter": F.array(F.col("ord") + 1), "page": F.floor(F.col("event_id") / 10)})
    paged = folds.page_counter(folds.both(counted, ["user_id"]), ["user_id"])
    return paged.select("event_id", F.array_join(F.col("both").cast("array<string>"), "/").alias("both"), "page_counter")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT user_id FROM e)
    UNION ALL SELECT e.user_id, e.k, e.event_id, CASE t WHEN 'click' THEN a + 1 WHEN 'purchase' THEN 5 WHEN 'signup' THEN a * 2 % 1000 ELSE a END,
      CASE t WHEN 'click' THEN NULL WHEN 'purchase' THEN NULL WHEN 'signup' THEN NULL ELSE coalesce(b, 0) + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
  SELECT event_id, concat_ws('.', a, b) AS counter FROM s WHERE k > 0""")
def counter_updates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "signup", "twice").otherwise("step")
    rows = table(spark, d, "events").select(
        "event_id", "user_id", "ts", kind.alias("kind"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("level"), F.array(F.lit(5).cast("bigint")).alias("numbers")
    )
    done = folds.counter_fold(rows, ["user_id"], ["ts", "event_id"], {"twice": lambda now: [now[0] * 2 % 1000]})
    return done.select("event_id", _number().alias("counter"))


@query(f"WITH {_ELEMENTS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN elem = 'heading' THEN coalesce(status, 'none') ELSE status END AS status FROM elements")
def set_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = rewrite.set_default(_elements(spark, d), "heading", "status", "none")
    return rows.select("doc_id", "ord", F.try_element_at("fields", F.lit("status")).alias("status"))


@query("""WITH e AS (SELECT *, row_number() OVER w - 1 AS ord, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ord) AS run FROM e)
  SELECT user_id, event_type, CAST(min(ord) AS BIGINT) AS first, CAST(max(ord) AS BIGINT) AS last, string_agg(event_id, ',' ORDER BY ord) AS items FROM r GROUP BY user_id, event_type, run""")
def group_neighbours(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return rewrite.group_runs(placed, ["user_id"], "ord", "event_type", "event_id").withColumn("items", _text(F.col("items")))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' ' WHEN 'click' THEN 'a ' ELSE 'b' END AS t, user_id, ts FROM events),
  n AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS nx FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, t FROM n WHERE NOT (t = ' ' AND (p IS NULL OR p LIKE '% ' OR nx IS NULL))""")
def space_collapsing(spark: SparkSession, d: str) -> DataFrame:
    placed = order.ord_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    t = F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "click", "a ").otherwise("b")
    return rewrite.collapse_spaces(placed.withColumn("t", t), ["user_id"], "ord", "t").select("event_id", "t")


@query(f"""WITH {_ELEMENTS} SELECT h.doc_id, CAST(h.ord AS BIGINT) AS ord, string_agg(i.body, '' ORDER BY i.ord) AS text
  FROM elements h JOIN elements i ON i.doc_id = h.doc_id AND i.elem = 'item' AND i.ord > h.ord AND i.ord < h.end_ord WHERE h.level = 2 GROUP BY 1, 2""")
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.plain_text(_elements(spark, d), elem("heading", level=2), "item")


# --- more comparison and records -------------------------------------------------------------

@query("""WITH r AS (SELECT p_brand, unnest(regexp_extract_all(p_name, '[a-z]+')) AS run FROM part), i AS (SELECT p_brand, run, unnest(range(1, length(run))) AS i FROM r)
  SELECT p_brand, substr(run, i, 2) AS token, count(*) AS n FROM i GROUP BY 1, 2""")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.pair_counts(table(spark, d, "part"), ["p_brand"], "p_name", "[a-z]")


@query(f"WITH {_PAIR} SELECT doc_id, token, l.n, r.n AS found FROM l JOIN r USING (doc_id, token) WHERE r.n < l.n")
def token_deficits(spark: SparkSession, d: str) -> DataFrame:
    return textdiff.deficits(*_pair(spark, d), ["doc_id"])


@query("SELECT p_partkey, p_size, p_size * 7 % 50 AS before, p_size * 7 % 50 - p_size AS lost FROM part ORDER BY lost DESC, p_partkey LIMIT 20")
def largest_drops(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "part").select("p_partkey", "p_size")
    return textdiff.drops(now, now.withColumn("p_size", F.col("p_size") * 7 % 50), ["p_partkey"], "p_size", 20)


@query("""WITH e AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 7 <> 0),
  f AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 11 <> 0)
  SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, CASE WHEN f.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' ELSE 'changed' END AS problem
  FROM e FULL JOIN f ON e.doc_id = f.doc_id WHERE e.h IS DISTINCT FROM f.h""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wanted = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("text")), 256).alias("digest"))
    return textdiff.manifest_problems(wanted, docs.filter("doc_id % 11 <> 0").withColumn("content", F.col("text").cast("binary")), "doc_id", "content", "digest")


@query("SELECT p_brand, bool_and(p_size <> 7) AS complete FROM part GROUP BY 1")
def complete_series(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("v", F.when(F.col("p_size") == 7, "none").otherwise(F.col("p_size").cast("string")))
    return records.complete_groups(rows, ["p_brand"], "v")


@query("""SELECT s_suppkey, s_name, min(event_id) FILTER (event_type = 'click') AS opens, min(event_id) FILTER (event_type = 'purchase') AS closes
  FROM supplier JOIN events ON user_id = s_suppkey GROUP BY 1, 2 HAVING min(event_id) FILTER (event_type = 'click') IS NOT NULL""")
def comment_anchors(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "close")
    anchors = table(spark, d, "events").select(F.col("user_id").alias("s_suppkey"), kind.alias("kind"), "event_id")
    return records.anchored_comments(anchors, table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "kind", "event_id")


@query("SELECT event_id, CAST(event_id // 7 AS BIGINT) AS y, CAST(event_id % 7 AS BIGINT) AS x FROM events")
def grid_flow(spark: SparkSession, d: str) -> DataFrame:
    return records.grid_places(table(spark, d, "events"), [], "event_id", 7).select("event_id", "y", "x")


@query("""WITH r AS (SELECT doc_id, text, substr(text, 1, 40) AS source FROM documents WHERE length(text) >= 60)
  SELECT doc_id, md5('new ' || text) AS contents FROM r WHERE doc_id % 3 = 0 AND (length(text) - length(replace(text, source, ''))) // 40 = 1""")
def merge_applied(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.length("text") >= 60).withColumn("source", F.substring("text", 1, 40))
    files = docs.select(F.col("doc_id").alias("file"), F.col("text").alias("contents"))
    regions = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), "source", F.col("source").alias("baseline"), F.lit(None).cast("string").alias("format"))
    word = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new "), "source")).otherwise(F.col("source"))
    edits = docs.select(F.col("doc_id").alias("id"), word.alias("word"), F.lit(None).cast("string").alias("format"), F.lit(False).alias("moved"))
    return merge.apply(merge.plan(regions, edits, files), files).select(F.col("file").alias("doc_id"), F.md5(F.col("contents").cast("binary")).alias("contents"))


# --- sources and sinks -----------------------------------------------------------------------

def _round_trip(kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        coded = readers.encoded(F.struct("p_partkey", "p_name", "p_size"), kind)
        tree = table(spark, d, "part").select(readers.decoded(coded, kind).alias("v"))
        return tree.select(*[F.variant_get("v", f"$.{c}", t).alias(c) for c, t in (("p_partkey", "bigint"), ("p_name", "string"), ("p_size", "int"))])

    run.__name__ = f"src_{kind}"
    query("SELECT p_partkey, p_name, p_size FROM part")(run)


for _kind in ("json", "yaml", "toml", "cbor"):
    _round_trip(_kind)


@query("SELECT p_partkey, 'part' AS tag, CAST(p_size AS VARCHAR) AS size, p_name AS body FROM part")
def src_xml(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('">'), F.col("p_name"), F.lit("</part>"))
    tree = table(spark, d, "part").select("p_partkey", readers.decoded(text, "xml").alias("v"))
    return tree.select("p_partkey", *[F.variant_get("v", p, "string").alias(c) for c, p in (("tag", "$[0].tag"), ("size", "$[0].attrs.size"), ("body", "$[0].children[0]"))])


def _written(spark: SparkSession, write: Callable[[str], None]) -> str:
    path = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    write(path)
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return readers.csv(spark, _written(spark, lambda path: rows.write.option("header", True).csv(path)), header=True)


@query("SELECT n_name AS name, n_name || ' of ' || n_regionkey AS value FROM nation")
def src_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" of "), "n_regionkey").alias("value"))
    path = _written(spark, lambda path: sinks.write_bundle(rows, path))
    text = F.rtrim(F.replace("value", F.lit("\n"), F.lit("")))
    return readers.read(spark, f"{path}/*/*.txt").select(F.regexp_extract(text, "^(.*) of ", 1).alias("name"), text.alias("value"))


@query("SELECT 'n' || n_nationkey AS key, 'book' AS kind, n_name AS title, CAST(n_regionkey + 1990 AS VARCHAR) AS year FROM nation")
def src_bibliography(spark: SparkSession, d: str) -> DataFrame:
    entry_ = F.concat(F.lit("@book{n"), "n_nationkey", F.lit(", title = {"), "n_name", F.lit("}, year = "), F.col("n_regionkey") + 1990, F.lit("}"))
    path = _written(spark, lambda path: sinks.write_text(table(spark, d, "nation").select(entry_.alias("value")), path))
    found = readers.bibliography(spark, f"{path}/*.txt")
    return found.select("key", "kind", F.element_at("fields", "title").alias("title"), F.element_at("fields", "year").alias("year"))


@query("""SELECT r_name AS severity, count(*) AS n, '[' || string_agg('{"what":"' || n_name || '","detail":"' || n_nationkey || '"}', ',' ORDER BY n_name) || ']' AS details
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def sink_losses(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sinks.loss_report(both.select(F.col("r_name").alias("severity"), F.col("n_name").alias("what"), F.col("n_nationkey").cast("string").alias("detail")))


@query("SELECT 'out.pdf: ' || string_agg(replace(n_name, ' ', '\\ '), ' ' ORDER BY n_name) AS value FROM nation")
def sink_make_rule(spark: SparkSession, d: str) -> DataFrame:
    return sinks.make_rule(table(spark, d, "nation"), "out.pdf", "n_name")


@query("SELECT lang, source, count(*) AS occurrences FROM documents GROUP BY 1, 2")
def sink_facts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.fidelity(table(spark, d, "documents"), ["lang", "source"])


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.serialised(table(spark, d, "region").select("r_regionkey", "r_name"))


# --- more of documents and packages ----------------------------------------------------------

@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?:') AND page_id % 3 = 0")
def links_lost(spark: SparkSession, d: str) -> DataFrame:
    """Every third page's link is missing in the output, the others stand there as entities."""
    pages = table(spark, d, "pages").select("page_id", "url")
    parts = pages.select("page_id", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('Target="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"'))).otherwise("none").alias("part"))
    return textdiff.lost_links(pages, parts, ["page_id"], "url", "part")


@query("""WITH p AS (SELECT user_id, event_id % 8 AS x, event_id // 8 % 12 AS y, abs(event_id * 7 % 256 - event_id * 13 % 256) AS apart FROM events),
  t AS (SELECT user_id, sum(apart) AS s, count(*) AS n FROM p GROUP BY user_id, x // 2, y // 2)
  SELECT user_id, round(1 - sum(s) / (255.0 * sum(n)), 9) AS agreement, round(min(1 - s / (255.0 * n)), 9) AS worst FROM t GROUP BY 1""")
def picture_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pixels = table(spark, d, "events").select("user_id", (k % 8).alias("x"), (F.floor(k / 8) % 12).alias("y"), (k * 7 % 256).alias("a"), (k * 13 % 256).alias("b"))
    scored = textdiff.tile_agreement(pixels, ["user_id"], 8, 12)
    return scored.select("user_id", F.round("agreement", 9).alias("agreement"), F.round("worst", 9).alias("worst"))


@query("""SELECT event_type AS kind, 'r' || event_id % 3 AS reason, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS text_chars FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2""")
def raster_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = F.concat(F.lit("RASTERIZE kind="), "event_type", F.lit(" reason=r"), k % 3, F.lit(" text_chars="), k % 100)
    lines = table(spark, d, "events").select(F.when(k % 5 == 0, "done kind=x").otherwise(said).alias("line"))
    return textdiff.logged_totals(lines, "line", "RASTERIZE", ["kind", "reason"], "text_chars")


@query("""SELECT p_partkey, CASE WHEN alone THEN bold END AS bold, CASE WHEN alone THEN italic END AS italic FROM (SELECT p_partkey, p_size % 2 = 0 AS bold, p_size % 3 = 0 AS italic,
  p_size <= 25 AND p_partkey % 7 <> 0 AND (p_size % 2 = 0 OR p_size % 3 = 0) AS alone FROM part)""")
def emphasis_only(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    found = records.emphasis(n % 2 == 0, n % 3 == 0, [F.when(n > 25, F.col("p_brand")), F.col("p_partkey") % 7 == 0])
    return table(spark, d, "part").select("p_partkey", found["bold"].alias("bold"), found["italic"].alias("italic"))


@query("""SELECT 'b' || o_custkey AS name, min(o_orderkey) AS ord FROM orders WHERE o_custkey IN (SELECT p_size FROM part) AND o_custkey NOT IN (SELECT s_suppkey * 2 FROM supplier) GROUP BY 1""")
def bookmarks_bound(spark: SparkSession, d: str) -> DataFrame:
    named = lambda t, c: table(spark, d, t).select(F.concat(F.lit("b"), c.cast("string")).alias("name"))
    places = table(spark, d, "orders").select(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("ord"))
    return records.bound_bookmarks(named("part", F.col("p_size")), named("supplier", F.col("s_suppkey") * 2), places, "name", "ord")


@query("""SELECT o_orderkey, o_custkey AS target FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def targets_lost(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "P", "External")
    relations = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("target"), mode.alias("mode"))
    return records.lost_targets(relations, table(spark, d, "supplier").select(F.col("s_suppkey").alias("target")), "target", "mode").select("o_orderkey", "target")


@query(f"""WITH o AS ({_QUANTITIES}) SELECT l_orderkey, array_to_string(list_concat(list_concat([0], CASE WHEN len(q) > 2 THEN q ELSE [] END), q), ',') AS spread,
  'first=' || q[1] || ',last=' || q[-1] AS made, q[1] - q[-1] AS apart, q[1] * q[-1] AS product, -q[1] AS under FROM o""")
def spread_and_build(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    first, last = arrays.first(q), arrays.last(q)
    return _orders(spark, d).select(
        "l_orderkey", _text(arrays.spread(F.array(F.lit(0).cast("bigint")), F.when(F.size(q) > 2, q), q)).alias("spread"), _entries(dicts.construct(first=first, last=last)).alias("made"),
        minus(first, last).alias("apart"), times(first, last).alias("product"), negative(first).alias("under"),
    )


def entry(spark: SparkSession) -> DataFrame:
    """The headings after each customer's first big order, as JSON."""
    d = "/root/testdata/sf0.001"
    rows = selectors.query(_elements(spark, d), elem("heading", level=2).after(elem("heading", level=2, status="P")))
    return rows.select("doc_id", "ord", F.to_json(F.struct("elem", "level", "label", "fields")).alias("value")).orderBy("doc_id", "ord")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
