"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sheafline.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float | np.floating) and np.isnan(v):
            return "NULL"
        if isinstance(v, float | np.floating):
            return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(float(v), 9))
        return repr(int(v)) if isinstance(v, int | np.integer) and not isinstance(v, bool | np.bool_) else str(v)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = core.queries()[name](spark, DATA).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark):
    assert core.entry(spark).count() > 0
