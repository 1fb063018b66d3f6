"""Windows, caps, samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_k

PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def _hash_key(seed, key_cols) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def top_posts(posts: DataFrame, as_of: str, period: str = "year", limit: int = 1000,
              forum_col: str = "subreddit") -> DataFrame:
    """Per forum, the ``limit`` highest-scored posts of the period before
    ``as_of`` (ties by post_id).  Apply F1 *after* this (limit first)."""
    start = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAYS")
    recent = posts.where((F.col("created_ts") >= start) & (F.col("created_ts") < F.to_timestamp(F.lit(as_of))))
    return top_k(recent, [forum_col], [F.col("score").desc(), F.col("post_id")], limit, "rank")


def filter_posts(posts: DataFrame, min_score=10, min_comments=5) -> DataFrame:
    """F1: score >= min_score and num_comments >= min_comments."""
    return posts.where((F.col("score") >= min_score) & (F.col("num_comments") >= min_comments))


def first_comments(comments: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` top-level comments of each post, before F2."""
    return top_k(comments, ["post_id"], [F.col("pos")], n)


def distinct_first_seen(df: DataFrame, key: str, order_cols) -> DataFrame:
    """Each distinct ``key`` with its first position (a hash aggregate)."""
    order_cols = list(order_cols)
    return df.groupBy(key).agg(F.min(F.struct(*order_cols)).alias("first_seen"))


def limit_first(distinct: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct items (TakeOrderedAndProject)."""
    return distinct.orderBy("first_seen").limit(n)


def sample_posts(posts: DataFrame, n: int = 200, seed: int = 42, key: str = "post_id") -> DataFrame:
    """T5: a repeatable sample of ``n`` posts without replacement."""
    return posts.orderBy(_hash_key(seed, [key]), key).limit(n)


def sample_comments(comments: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """At most ``n`` pseudo-random comments per post, no replacement."""
    return top_k(comments, ["post_id"], [_hash_key(seed, ["comment_id"]), F.col("comment_id")], n)


def union_posts(*dfs: DataFrame, dedupe: bool = False) -> DataFrame:
    """Append without dedupe (the default), or dedupe on post_id."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.dropDuplicates(["post_id"]) if dedupe else out


def hash_threshold(df: DataFrame, h: Column, k: int, prefix: int = 4, collect_limit: int = 10_000) -> str | None:
    """The k-th smallest hex hash, found without a global sort.

    Each pass counts rows per hash prefix (at most 16**prefix groups, a
    bounded table), locates the prefix holding the k-th row and narrows to
    it; once that slice is small enough its hashes are collected.  Where more
    rows than that share one whole hash (equal keys), the hash is the answer.
    """
    if k <= 0:
        return None
    d = df.select(h.alias("_h"))
    lo, depth = "", 0
    while depth < 32:  # hex digits of a hash
        part = d.where(F.col("_h").startswith(lo)) if lo else d
        cnt = part.limit(collect_limit + 1).count()
        if cnt <= collect_limit:
            hs = sorted(r[0] for r in part.collect())
            return hs[k - 1]
        depth += prefix
        hist = (part.groupBy(F.substring("_h", 1, depth).alias("p")).count().collect())
        acc = 0
        for p, c in sorted(hist):
            if acc + c >= k:
                lo, k = p, k - acc
                break
            acc += c
    return lo


def train_test_split(df: DataFrame, key_cols, test_fraction: float = 0.2, seed: int = 42,
                     out_col: str = "split", split_by: str = "row") -> DataFrame:
    """ceil(test_fraction * n) rows, or with ``split_by="key"`` keys with all their rows, go to 'test', chosen by the
    rank of md5(seed#key).

    The threshold is found by ``hash_threshold`` (histogram passes), so no global sort or single-partition window runs; rows
    follow it inside the row.  Rows of the one key that the border falls into are told apart by a second hash, of their
    place in a written copy."""
    if split_by not in ("row", "key"):
        raise ValueError(f"unknown split_by {split_by!r}")
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    h = _hash_key(seed, key_cols)
    # The count and the histogram passes read only the hashes: materialise
    # that one narrow column once instead of recomputing ``df`` per pass.
    hashes = df.select(h.alias("_h"))
    hashes = (hashes.distinct() if split_by == "key" else hashes).checkpoint()
    n = hashes.count()
    k = math.ceil(test_fraction * n)
    thr = hash_threshold(hashes, F.col("_h"), k)
    test = F.lit(False) if thr is None else (h <= F.lit(thr))
    if thr is not None and split_by == "row":
        counts = hashes.agg(F.count_if(F.col("_h") < thr).alias("below"), F.count_if(F.col("_h") == thr).alias("equal")).first()
        wanted = k - counts["below"]
        if wanted < counts["equal"]:
            df = df.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
            second = F.md5(F.col("_at").cast("string"))
            cut = hash_threshold(df.where(h == F.lit(thr)).select(second.alias("_h")), F.col("_h"), wanted)
            test = (h < F.lit(thr)) | ((h == F.lit(thr)) & (second <= F.lit(cut)))
            return df.withColumn(out_col, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_at")
    return df.withColumn(out_col, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def split_posts(posts: DataFrame, comments: DataFrame, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """W7 by post: ``split`` on both tables; a post and its comments never part.  Comments follow their post's id, without a join."""
    h = _hash_key(seed, ["post_id"])
    hashes = posts.select(h.alias("_h")).distinct().checkpoint()
    thr = hash_threshold(hashes, F.col("_h"), math.ceil(test_fraction * hashes.count()))
    side = F.when(h <= F.lit(thr), "test").otherwise("train") if thr is not None else F.lit("train")
    return posts.withColumn("split", side), comments.withColumn("split", side)


def labelled_records(posts: DataFrame, comments: DataFrame, truth: str = "actual_polarity") -> tuple[DataFrame, DataFrame]:
    """The labelled record of every post: id, title, sentiment and (if it has one) its true polarity, with those of its comments that
    have a text and a true polarity of their own."""
    p = posts.select("post_id", F.coalesce("title", F.lit("")).alias("title"), "sentiment", F.col(f"sentiment.{truth}").alias(truth))
    c = comments.where(F.col("text").isNotNull() & F.col(f"sentiment.{truth}").isNotNull()).select(
        "post_id", "pos", "comment_id", "text", "sentiment")
    return p, c


def write_split_records(posts: DataFrame, comments: DataFrame, path: str, test_fraction: float = 0.2, seed: int = 42,
                        truth: str = "actual_polarity") -> dict[str, str]:
    """Labelled records as JSON lines in ``<path>/train`` and ``<path>/test``, split by post."""
    from ..sources.posts_io import write_posts_json
    p, c = split_posts(*labelled_records(posts, comments, truth), test_fraction, seed)
    out = {}
    for side in ("train", "test"):
        out[side] = f"{path.rstrip('/')}/{side}"
        write_posts_json(p.where(F.col("split") == side).drop("split"), c.where(F.col("split") == side).drop("split"), out[side])
    return out


def training_rows(posts: DataFrame, comments: DataFrame, truth: str = "actual_polarity") -> DataFrame:
    """Labelled post titles and comment texts as (text, label 0/1/2)."""
    p = posts.where(F.col(truth).isNotNull() & F.col("title").isNotNull()).select(
        F.lit("post").alias("kind"), "post_id", F.lit(-1).alias("pos"),
        F.col("title").alias("text"), (F.col(truth) + 1).cast("int").alias("label"))
    c = comments.where(F.col(truth).isNotNull() & F.col("text").isNotNull()).select(
        F.lit("comment").alias("kind"), "post_id", F.col("pos").cast("int").alias("pos"),
        "text", (F.col(truth) + 1).cast("int").alias("label"))
    return p.unionByName(c)
