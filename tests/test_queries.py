"""Every registered query against its DuckDB oracle on the supplied tables (sf0.001),
and the rows-only queries for a non-empty, stable result."""

import math

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from kindling.plans.catalog import QUERIES

from .conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _canon(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return str(v)
        return 0 if isinstance(v, float) and v == 0 else v   # -0.0 is 0, as is a whole number read as float beside NULLs

    rows = [tuple(norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = _canon(queries()[name](spark, SF_SMALL).toPandas())
    want = _canon(duck.execute(oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_rows_only_queries(spark, name):
    df = queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_every_query_has_oracle_or_is_listed():
    no_sql = set(QUERIES) - set(oracle_sql())
    assert no_sql == {"tree_importance", "forest_scores", "tune_tree"}
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and {"model", "is_default", "mae", "rmse", "r2"} <= set(df.columns)


def test_deep_refinement_on_supplied_tables(spark):
    """Force several refinement levels on sf0.01 tables and compare with DuckDB."""
    from kindling.operators.selection import exact_quantiles
    from kindling.operators.split import split_cut, train_test_split

    from .conftest import SF_ORACLE

    con = duckdb.connect()
    li = spark.read.parquet(f"{SF_ORACLE}/lineitem.parquet")
    got = exact_quantiles(li, "l_extendedprice", [0.1, 0.5, 0.99], final_max=50, buckets=16).first()
    want = con.execute(f"select quantile_cont(l_extendedprice, [0.1, 0.5, 0.99]) "
                       f"from '{SF_ORACLE}/lineitem.parquet'").fetchone()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    grouped = {r.l_returnflag: r.q0 for r in exact_quantiles(li, "l_quantity", [0.5], group_cols=["l_returnflag"],
                                                             final_max=50, buckets=8).collect()}
    gwant = dict(con.execute(f"select l_returnflag, quantile_cont(l_quantity, 0.5) "
                             f"from '{SF_ORACLE}/lineitem.parquet' group by 1").fetchall())
    assert grouped == gwant
    o = spark.read.parquet(f"{SF_ORACLE}/orders.parquet")
    n, n_test, _ = split_cut(o, ["o_orderkey"], 0.25, 1, final_max=20, buckets=8)
    _, test = train_test_split(o, "o_orderkey", 0.25, 1, final_max=20, buckets=8)
    row = test.agg({"o_orderkey": "sum", "*": "count"}).first()
    assert (n, n_test) == (15000, 3750) and (row["count(1)"], row["sum(o_orderkey)"]) == (3750, 28289462)
