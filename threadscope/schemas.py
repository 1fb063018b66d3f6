"""Canonical schemas (posts, comments, nested post files)."""

from __future__ import annotations

from pyspark.sql import types as T

SENTIMENT = T.StructType([
    T.StructField("polarity", T.DoubleType()),
    T.StructField("subjectivity", T.DoubleType()),
    T.StructField("actual_polarity", T.DoubleType()),
    T.StructField("actual polarity", T.DoubleType()),
    T.StructField("actual subjectivity", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

COMMENT = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sentiment", SENTIMENT),
    T.StructField("platform_mentioned", T.ArrayType(T.StringType())),
    T.StructField("has_solution", T.BooleanType()),
    T.StructField("is_op_response", T.BooleanType()),
])

POST_FILE = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("author", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("platform", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("sentiment", SENTIMENT),
    T.StructField("potential_games", T.ArrayType(T.StringType())),
    T.StructField("bug_keywords_found", T.ArrayType(T.StringType())),
    T.StructField("is_resolved", T.BooleanType()),
    T.StructField("comments", T.ArrayType(COMMENT)),
])

METRICS = "`Evaluation Metrics` string, Polarity double, Subjectivity double"
TRAINING = "text string, label int"
