"""Comment-level operators on ``conversations`` and post filters/windows on
``documents`` and ``events`` (F1-F3, F5, F9, J2, W1, W2, X9-X12, A1, A2,
A6, A15, U1).

The driver's text has no dead markers, blanks, handles or URLs, so the
queries derive them from the ids by a fixed rule (the same rule in Spark
and in SQL); every row is kept and processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrich as EN
from ..operators import sampling as SA
from ..operators import stats as ST
from ..operators.summary import valid_comments
from ..session import read_table
from ..sources.testdata import (conversation_comments, conversation_posts, document_posts,
                                event_posts)
from . import sqlgen as G
from .registry import register

# Marker rule, identical in both engines.
_MARK_SQL = """
  CASE WHEN turn % 5 = 0 THEN '[deleted]'
       WHEN turn % 7 = 3 THEN ' [removed] '
       WHEN conv_id % 11 = 0 THEN NULL
       ELSE text END"""
_AUTHOR_SQL = "CASE WHEN conv_id % 6 = 1 AND turn = 2 THEN NULL ELSE role END"
_COMMENTS_SQL = f"""
(SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos,
        CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id,
        {_MARK_SQL} AS text, {_AUTHOR_SQL} AS author
 FROM conversations WHERE turn > 0)"""


def _marked_comments(spark, sf):
    c = conversation_comments(spark, sf)
    turn = F.col("pos") + 1
    text = (F.when(turn % 5 == 0, F.lit("[deleted]"))
            .when(turn % 7 == 3, F.lit(" [removed] "))
            .when(F.col("post_id") % 11 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("text")))
    author = F.when((F.col("post_id") % 6 == 1) & (turn == 2), F.lit(None).cast("string")) \
        .otherwise(F.col("author"))
    return c.withColumn("text", text).withColumn("author", author)


@register("f2_drop_dead_comments",
          f"SELECT post_id, pos, comment_id FROM {_COMMENTS_SQL} c "
          f"WHERE author IS NOT NULL AND coalesce(text, '') NOT IN ('[deleted]', '[removed]')")
def f2_drop_dead_comments(spark, sf):
    return EN.drop_dead_comments(_marked_comments(spark, sf)).select("post_id", "pos", "comment_id")


_STRIPPED = G.strip("coalesce(text, '')")


@register("f3_valid_comments",
          f"SELECT post_id, pos, coalesce(text, '') AS text FROM {_COMMENTS_SQL} c "
          f"WHERE {_STRIPPED} NOT IN ('[deleted]', '[removed]')")
def f3_valid_comments(spark, sf):
    return valid_comments(_marked_comments(spark, sf)).select("post_id", "pos", "text")


@register("w2_f2_first_comments_then_filter",
          f"""SELECT post_id, pos, comment_id FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos) AS rn FROM {_COMMENTS_SQL} c)
WHERE rn <= 3 AND author IS NOT NULL AND coalesce(text, '') NOT IN ('[deleted]', '[removed]')""")
def w2_f2_first_comments_then_filter(spark, sf):
    first = SA.first_comments(_marked_comments(spark, sf), n=3)
    return EN.drop_dead_comments(first).select("post_id", "pos", "comment_id")


def _posts_null_authors(spark, sf):
    p = conversation_posts(spark, sf)
    return p.withColumn("author", F.when(F.col("post_id") % 4 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("author")))


@register("j2_attach_post", """
SELECT c.conv_id AS post_id, CAST(c.turn - 1 AS INTEGER) AS pos,
       coalesce(c.role = CASE WHEN p.conv_id % 4 = 0 THEN NULL ELSE p.role END, false) AS is_op_response
FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) p ON c.conv_id = p.conv_id
WHERE c.turn > 0""")
def j2_attach_post(spark, sf):
    c = conversation_comments(spark, sf)
    return EN.attach_post(c, _posts_null_authors(spark, sf)).select("post_id", "pos", "is_op_response")


@register("f5_enrich_comments", f"""
WITH c AS (SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos,
                  CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, text, role
           FROM conversations WHERE turn > 0),
p AS (SELECT conv_id AS post_id, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE role END AS pa
      FROM conversations WHERE turn = 0)
SELECT c.post_id, c.pos, c.comment_id,
  round(coalesce(s.pol, 0.0), 6) AS polarity, round(coalesce(s.subj, 0.0), 6) AS subjectivity,
  {G.platform('c.text')} AS platform_mentioned,
  {G.has_any('c.text', ['solution', 'fix', 'solved', 'resolved'])} AS has_solution,
  coalesce(c.role = p.pa, false) AS is_op_response
FROM c LEFT JOIN p USING (post_id)
LEFT JOIN {G.lexicon_scores('c', 'post_id, pos', 'text')} s USING (post_id, pos)""")
def f5_enrich_comments(spark, sf):
    e = EN.enrich_comments(conversation_comments(spark, sf), _posts_null_authors(spark, sf))
    return e.select("post_id", "pos", "comment_id",
                    F.round("sentiment.polarity", 6).alias("polarity"),
                    F.round("sentiment.subjectivity", 6).alias("subjectivity"),
                    F.array_join("platform_mentioned", ",").alias("platform_mentioned"),
                    "has_solution", "is_op_response")


@register("f9_deleted_author_default", """
SELECT conv_id AS post_id, CASE WHEN conv_id % 4 = 0 THEN '[deleted]' ELSE role END AS author
FROM conversations WHERE turn = 0""")
def f9_deleted_author_default(spark, sf):
    p = EN.enrich_posts(_posts_null_authors(spark, sf))
    return p.select("post_id", "author")


_WS_SQL = "CASE WHEN turn % 3 = 0 THEN chr(9) || '  ' || text || ' ' || chr(10) ELSE text END"


@register("x9_strip", f"""
SELECT conv_id, turn, {G.strip(_WS_SQL)} AS stripped FROM conversations""")
def x9_strip(spark, sf):
    c = read_table(spark, sf, "conversations")
    ws = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\t  "), "text", F.lit(" \n"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.strip(ws).alias("stripped"))


_HANDLE_SQL = ("'@u' || CAST(conv_id AS VARCHAR) || ' ' || text || ' http://ex.com/' || "
               "CAST(turn AS VARCHAR) || ' @ x@y @'")


@register("x10_mask_handles_urls", f"""
SELECT conv_id, turn, array_to_string(list_transform(string_split({_HANDLE_SQL}, ' '),
  lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user'
                 WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ') AS masked
FROM conversations""")
def x10_mask_handles_urls(spark, sf):
    c = read_table(spark, sf, "conversations")
    t = F.concat(F.lit("@u"), F.col("conv_id").cast("string"), F.lit(" "), "text",
                 F.lit(" http://ex.com/"), F.col("turn").cast("string"), F.lit(" @ x@y @"))
    return c.select("conv_id", "turn", X.mask_handles_urls(t).alias("masked"))


@register("x11_clean_markup", """
SELECT conv_id, turn, translate('#tag_' || CAST(turn AS VARCHAR) || ' ' || text, '_#', ' ') AS cleaned
FROM conversations""")
def x11_clean_markup(spark, sf):
    c = read_table(spark, sf, "conversations")
    t = F.concat(F.lit("#tag_"), F.col("turn").cast("string"), F.lit(" "), "text")
    return c.select("conv_id", "turn", X.clean_markup(t).alias("cleaned"))


@register("x12_epoch_to_iso", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso FROM events""")
def x12_epoch_to_iso(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", X.epoch_to_iso(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso"))


@register("a1_a2_a15_totals", """
SELECT (SELECT count(*) FROM conversations WHERE turn = 0) AS total_posts,
       (SELECT count(*) FROM conversations WHERE turn > 0) AS total_comments""")
def a1_a2_a15_totals(spark, sf):
    return ST.totals(conversation_posts(spark, sf), conversation_comments(spark, sf))


@register("a6_posts_per_forum", """
WITH f AS (SELECT DISTINCT source AS forum FROM documents UNION ALL SELECT 'src_missing')
SELECT f.forum, CAST(count(d.doc_id) AS BIGINT) AS n_posts
FROM f LEFT JOIN documents d ON d.source = f.forum GROUP BY f.forum""")
def a6_posts_per_forum(spark, sf):
    posts = document_posts(spark, sf)
    forums = posts.select(F.col("subreddit").alias("forum")).distinct().unionByName(
        spark.createDataFrame([("src_missing",)], "forum string"))
    return ST.posts_per_forum(forums, posts)


@register("u1_union_posts_no_dedupe", """
WITH l1 AS (SELECT DISTINCT source AS forum FROM documents WHERE lang = 'en'),
l2 AS (SELECT DISTINCT source AS forum FROM documents WHERE lang = 'fr'),
f AS (SELECT forum FROM l1 UNION ALL SELECT forum FROM l2)
SELECT f.forum, CAST(count(*) AS BIGINT) AS n_posts FROM f JOIN documents d ON d.source = f.forum
GROUP BY f.forum""")
def u1_union_posts_no_dedupe(spark, sf):
    d = read_table(spark, sf, "documents")
    posts = document_posts(spark, sf)
    parts = []
    for lang in ("en", "fr"):
        forums = d.where(F.col("lang") == lang).select(F.col("source").alias("forum")).distinct()
        parts.append(posts.join(forums, posts["subreddit"] == forums["forum"]).drop("forum"))
    u = SA.union_posts(*parts)
    return u.groupBy(F.col("subreddit").alias("forum")).agg(F.count("*").alias("n_posts"))


@register("f1_filter_posts", """
SELECT doc_id AS post_id FROM documents
WHERE n_chars >= 1000 AND len(string_split(coalesce(text, ''), chr(10))) - 1 >= 5""")
def f1_filter_posts(spark, sf):
    return SA.filter_posts(document_posts(spark, sf), min_score=1000, min_comments=5).select("post_id")


@register("w1_f1_top_posts_then_filter", """
SELECT post_id, subreddit, score, rank FROM (
  SELECT event_id AS post_id, event_type AS subreddit, value AS score,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_comments,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank
  FROM events
  WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS AND ts < TIMESTAMP '2024-01-31 00:00:00')
WHERE rank <= 50 AND score >= 20 AND num_comments >= 10""")
def w1_f1_top_posts_then_filter(spark, sf):
    top = SA.top_posts(event_posts(spark, sf), as_of="2024-01-31 00:00:00", period="week", limit=50)
    return SA.filter_posts(top, min_score=20, min_comments=10).select(
        "post_id", "subreddit", "score", F.col("rank").cast("int").alias("rank"))


@register("w6_positional_index", f"""
SELECT post_id, pos, row_number() OVER (PARTITION BY post_id ORDER BY pos) - 1 AS idx
FROM {_COMMENTS_SQL} c WHERE {_STRIPPED} NOT IN ('[deleted]', '[removed]')""")
def w6_positional_index(spark, sf):
    """0-based index of each valid comment within its post (skew-safe
    bucketed prefix count, not a single-partition window per post)."""
    from ..operators.windows import dense_index
    v = valid_comments(_marked_comments(spark, sf)).select("post_id", "pos")
    return dense_index(v, ["post_id"], "pos", "idx")
