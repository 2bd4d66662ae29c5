"""Every query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from hourloom.plans import registry

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    v = v.item() if hasattr(v, "item") else v
    return repr(int(v) if isinstance(v, float) and v == int(v) else v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_as_its_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, D).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_forest_beats_nothing_and_reloads(spark):
    assert registry.QUERIES["rf_reload_equal"](spark, D).first().differing == 0
    m = {r.model: r.mae for r in registry.QUERIES["rf_metrics"](spark, D).collect()}
    assert m["random_forest"] < m["naive"]


def test_forests_are_ranked_over_folds(spark):
    rows = registry.QUERIES["rf_candidate_ranking"](spark, D).collect()
    kinds = {("naive", h, 0) for h in "AB"} | {("random_forest", h, k) for h in "AB" for k in (8, 12)}
    assert {(r.model, r.history, r.depth) for r in rows} == kinds and len({r.n for r in rows}) == 1
    assert [r.mae for r in rows] == sorted(r.mae for r in rows) and len({r.mae for r in rows if r.model == "random_forest"}) == 4
