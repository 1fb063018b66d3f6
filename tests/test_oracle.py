"""Registered queries vs their DuckDB oracles on the smallest driver tables.

Runs a representative subset by default; set THREADSCOPE_ALL_ORACLES=1 to
run every registered pair.
"""

import os

import duckdb
import pytest

import __spark_entry__ as E
from threadscope.session import TABLES

SF = "/root/testdata/sf0.001"
SUBSET = ["m12_summary_base", "m10_summary_fallbacks", "f4_s7_enrich_flatten_data",
          "a5_j6_sentiment_by_severity_data", "j1_match_names", "w7_train_test_split",
          "e1_macro_metrics", "m7_predict_polarity", "j5_keyword_join_data_index", "w1_f1_top_posts_then_filter"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("THREADSCOPE_ALL_ORACLES") else SUBSET


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "__float__") and type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable_and_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in sorted(cols)]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["post_id", "title", "summary", "total_comments", "positive", "negative", "neutral"]
