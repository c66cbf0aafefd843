"""Letters of numbers beyond 26."""

import duckdb

from sheafline.plans import queries as core

DATA = "/root/testdata/sf0.001"


def letters(n):
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = "abcdefghijklmnopqrstuvwxyz"[k] + out
    return out


def test_more_than_26_orders(spark, tmp_path):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    customer = read("customer").orderBy("c_custkey").limit(2)
    one, other = (r.c_custkey for r in customer.collect())
    row = read("orders").limit(1)
    many = row.drop("o_orderkey", "o_custkey").crossJoin(spark.range(1, 731).selectExpr("id AS o_orderkey", f"IF(id <= 705, {one}L, {other}L) AS o_custkey"))
    orders = many.select(*[many[c].cast(t) for c, t in row.dtypes])
    for name, df in (("customer", customer), ("orders", orders), ("lineitem", read("lineitem").limit(0))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.doc_id, r.ord, r.shown) for r in core.queries()["counter_display"](spark, str(tmp_path)).collect())
    assert got == [(c, k, f"1.{letters(k)})" if k else "1)") for c, n in ((one, 705), (other, 25)) for k in range(n + 1)]
    assert [got[k][2] for k in (26, 27, 702, 703)] == ["1.z)", "1.aa)", "1.zz)", "1.aaa)"]
    duck = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        duck.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(duck.sql(f"SELECT doc_id, ord, shown FROM ({core.oracle_sql()['counter_display']})").fetchall()) == got
