"""Counts and distributions (A1-A6, A13-A15, T2).  All are hash aggregates
with map-side partial aggregation; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules


def totals(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A1/A2 (also A15): total posts and total comments."""
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    both = posts.select(one.alias("_p"), zero.alias("_c")).unionByName(
        comments.select(zero.alias("_p"), one.alias("_c")))
    return both.agg(F.sum("_p").alias("total_posts"), F.sum("_c").alias("total_comments"))


def most_common(counts: DataFrame, count_col: str = "n", first_seen: str = "first_seen") -> DataFrame:
    """Rank by count descending, ties by first appearance.

    The window has no partition key on purpose: it runs over the already
    aggregated table (one row per category).
    """
    w = Window.orderBy(F.col(count_col).desc(), F.col(first_seen))
    return counts.withColumn("rank", F.row_number().over(w).cast("int"))


def platform_counts(posts: DataFrame, order_col: str = "post_id") -> DataFrame:
    """A3: a post counts once per platform it mentions."""
    x = posts.select(order_col, F.posexplode("platform").alias("k", "platform"))
    g = x.groupBy("platform").agg(F.count("*").alias("n"),
                                  F.min(F.struct(order_col, "k")).alias("first_seen"))
    return most_common(g).drop("first_seen")


def severity_counts(posts: DataFrame, order_col: str = "post_id") -> DataFrame:
    """A4: severity distribution, 'unspecified' included."""
    g = posts.groupBy("severity").agg(F.count("*").alias("n"), F.min(order_col).alias("first_seen"))
    return most_common(g).drop("first_seen")


def sentiment_by_severity(posts: DataFrame, levels=None) -> DataFrame:
    """A5 + J6: mean polarity per listed severity (others ignored), empty -> 0,
    shown with two decimals."""
    levels = levels or rules.SEVERITY_LEVELS
    spark = posts.sparkSession
    dim = spark.createDataFrame([(lv, i) for i, lv in enumerate(levels)], "severity string, ord int")
    a = posts.groupBy("severity").agg(F.avg("sentiment.polarity").alias("_m"))
    raw = F.coalesce(F.col("_m"), F.lit(0.0))
    m = F.round(raw, 2) + F.lit(0.0)
    # Two-decimal display; a small negative mean prints as "-0.00".
    shown = F.when((raw < 0) & (m == 0), F.lit("-0.00")).otherwise(F.format_string("%.2f", m))
    return (dim.join(a, "severity", "left")
            .select("severity", m.alias("avg_polarity"),
                    F.concat(F.initcap("severity"), F.lit(": "), shown).alias("display")))


def posts_per_forum(forums: DataFrame, posts: DataFrame, forum_col: str = "subreddit") -> DataFrame:
    """Posts found per listed forum; a forum without posts counts 0."""
    g = posts.groupBy(forum_col).agg(F.count("*").alias("n_posts"))
    return (forums.join(g, forums["forum"] == g[forum_col], "left")
            .select("forum", F.coalesce("n_posts", F.lit(0)).cast("long").alias("n_posts")))


def distinct_mentions(col) -> "F.Column":
    """Distinct mentions, sorted (the reference's set order is unspecified)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(c))


def labelled_count(df: DataFrame, truth_col: str) -> DataFrame:
    """Number of labelled items; fails the job when there are none."""
    n = F.count(F.col(truth_col))
    return df.agg(F.when(n == 0, F.raise_error(F.lit("no labelled data found")))
                  .otherwise(n).cast("long").alias("n_labelled"))
