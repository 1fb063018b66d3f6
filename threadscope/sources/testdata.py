"""Adapters: the driver's tables seen as posts, comments, catalogs.

conversations: turn 0 = post (title = its text, author = role), turns > 0
  = comments (pos = turn - 1).
documents: posts (forum = source, score = n_chars, title empty).
events: dated, scored posts (forum = event_type, score = value, ts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def conversation_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("num_comments"))
    p = c.where(F.col("turn") == 0)
    return (p.join(turns, "conv_id", "left").select(
        F.col("conv_id").alias("post_id"), F.col("text").alias("title"),
        F.lit("").alias("text"), F.length("text").cast("long").alias("score"),
        F.lit(None).cast("double").alias("upvote_ratio"),
        F.col("num_comments").cast("long").alias("num_comments"),
        F.col("role").alias("author"), F.lit("conversations").alias("subreddit"),
        F.lit(None).cast("timestamp").alias("created_ts")))


def conversation_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    return c.select(
        F.col("conv_id").alias("post_id"), (F.col("turn") - 1).cast("int").alias("pos"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("comment_id"),
        "text", F.length("text").cast("long").alias("score"), F.col("role").alias("author"),
        F.lit(None).cast("timestamp").alias("created_ts"))


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("post_id"), F.lit("").alias("title"), "text",
        F.col("n_chars").alias("score"), F.lit(None).cast("double").alias("upvote_ratio"),
        (F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1).cast("long").alias("num_comments"),
        F.col("lang").alias("author"), F.col("source").alias("subreddit"),
        F.lit(None).cast("timestamp").alias("created_ts"))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("post_id"), F.col("event_type").alias("subreddit"),
        F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("created_ts"),
        F.get_json_object("props", "$.k").cast("long").alias("num_comments"))
