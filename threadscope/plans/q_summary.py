"""Summary chain on conversations (X21, X22, J9, A7-A10, J3, J4, X20, X23,
M9-M13, S10, M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summary as S
from ..sources.testdata import conversation_comments, conversation_posts
from . import oracle_summary as O
from .registry import register


def _inputs(spark, sf):
    return conversation_posts(spark, sf), conversation_comments(spark, sf)


@register("m12_summary_base", O.summary_sql(n=5))
def m12_summary_base(spark, sf):
    posts, comments = _inputs(spark, sf)
    return S.summarize(posts, comments, cluster="none", n=5)


# One hot discussion: every comment of every conversation under one post, in
# (conversation, turn) order.  Exercises the skew-safe paths (bucketed
# prefix sums, bucketed duplicate fold) where one key holds all rows.
_HOT_COMMENTS = """
  SELECT CAST(0 AS BIGINT) AS post_id, CAST(conv_id * 100 + turn - 1 AS INTEGER) AS pos, coalesce(text, '') AS text
  FROM conversations WHERE turn > 0"""
_HOT_POSTS_SQL = O.summary_sql(n=5, comments_sql=_HOT_COMMENTS).replace(
    "p AS (SELECT conv_id AS post_id, text AS title FROM conversations WHERE turn = 0)",
    "p AS (SELECT CAST(0 AS BIGINT) AS post_id, 'all conversations' AS title)")


@register("m12_summary_one_hot_discussion", _HOT_POSTS_SQL)
def m12_summary_one_hot_discussion(spark, sf):
    c = conversation_comments(spark, sf)
    hot = c.select(F.lit(0).cast("long").alias("post_id"),
                   ((c["post_id"] * 100) + c["pos"]).cast("int").alias("pos"), "text")
    posts = spark.range(1).select(F.lit(0).cast("long").alias("post_id"),
                                  F.lit("all conversations").alias("title"))
    # small buckets so that even the test tables split the hot key
    return S.summarize(posts, hot, n=5, bucket_width=64)
