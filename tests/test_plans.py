"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E

from threadscope.operators import enrich as EN
from threadscope.operators import sampling as SA
from threadscope.session import read_table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_uses_partial_window_group_limit(spark):
    p = plan(E.queries()["w1_f1_top_posts_then_filter"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_time_filter_and_columns_reach_the_scan(spark):
    p = plan(E.queries()["w1_f1_top_posts_then_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    d = read_table(spark, SF, "documents").select("doc_id")
    assert "ReadSchema: struct<doc_id:bigint>" in plan(d)


def test_keyword_rules_stay_in_codegen_without_python(spark):
    p = plan(E.queries()["x1_platform_default"](spark, SF))
    assert "*(" in p and "EvalPython" not in p and "Exchange" not in p


def test_index_keyword_join_is_an_equi_join_of_hits(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    d = spark.createDataFrame([("glitch",), ("lag",), ("not working",)], "keyword string")
    p = plan(EN.match_keywords(docs, ["doc_id"], "text", d, method="index"))
    assert "CartesianProduct" not in p
    assert "NestedLoop" not in p and ("HashJoin [_kw#" in p or "SortMergeJoin [_kw#" in p)
    assert "Generate explode" not in p  # no row a character


def test_split_avoids_global_sort(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    p = plan(SA.train_test_split(df, "k", 0.2, 42))
    assert "rangepartitioning" not in p and "SinglePartition" not in p


def test_rouge_n_is_two_sums_over_one_gram_table(spark):
    from threadscope.operators import rouge
    pairs = spark.createDataFrame([(1, "a b c a", "a b d"), (2, "", "x"), (3, None, None), (4, "a", "a")], "id int, cand string, ref string")
    df = rouge.rouge_n(pairs, "id", "cand", "ref")
    p = plan(df)
    assert p.count("Exchange hashpartitioning") == 2 and "Join" not in p and p.count("Generate inline") == 1
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1].rouge1_p, rows[1].rouge2_p) == (2 / 4, 1 / 3) and (rows[1].rouge1_r, rows[1].rouge2_r) == (2 / 3, 1 / 2)
    assert rows[4].rouge1_f == 1.0 and rows[4].rouge2_f == rows[2].rouge1_f == rows[3].rouge1_f == 0.0
