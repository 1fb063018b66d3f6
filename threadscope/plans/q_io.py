"""Round trips through files.

Each query writes data derived from the driver's tables to a fresh folder
under the shared checkpoint directory and reads it back; the oracle is the
same data computed straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MO
from ..operators import summary as SU
from ..session import read_table, scratch_path
from ..sources import discussions as DI
from ..sources import files as FI
from ..sources import posts_io as PIO
from ..sources.testdata import conversation_comments, conversation_posts
from . import oracle_summary as OS
from . import sqlgen as G
from .q_catalog import _MATCH_SQL, s11_render_mapping
from .q_eval import _TRAINING_SQL, _table, _table_sql, _training
from .registry import register


@register("s1_s6_posts_json_roundtrip", """
SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos,
       CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, text
FROM conversations WHERE turn > 0""")
def s1_s6_posts_json_roundtrip(spark, sf):
    path = scratch_path(spark, "posts-json")
    posts = conversation_posts(spark, sf).drop("created_ts")
    com = conversation_comments(spark, sf).select("post_id", "pos", "comment_id", "text", "score", "author")
    PIO.write_posts_json(posts, com, path)
    _, c = PIO.read_posts(spark, path)
    return c.select(F.col("post_id").cast("long").alias("post_id"), F.col("pos").cast("int").alias("pos"),
                    "comment_id", "text")


@register("s12_predictions_to_new_path", f"""
SELECT post_id, CAST(polarity AS DOUBLE) AS polarity FROM {G.vote_sql(
    "(SELECT conv_id AS post_id, text AS title FROM conversations WHERE turn = 0)", 'post_id', 'title', 16, 8)}""")
def s12_predictions_to_new_path(spark, sf):
    posts = conversation_posts(spark, sf).withColumn(
        "sentiment", F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity")))
    com = conversation_comments(spark, sf).withColumn(
        "sentiment", F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity")))
    pp = MO.predict_polarity(posts, ["post_id"], "title", size=16, overlap=8)
    cp = MO.predict_polarity(com, ["comment_id"], "text", size=16, overlap=8)
    p2, c2 = MO.apply_predictions(posts, com, pp, cp)
    path = scratch_path(spark, "predictions")       # never the path being read
    PIO.write_posts_json(p2.drop("created_ts"), c2.drop("created_ts"), path)
    p, _ = PIO.read_posts(spark, path)
    return p.select(F.col("post_id").cast("long").alias("post_id"), F.col("sentiment.polarity").alias("polarity"))


@register("s5_s8_training_csv_roundtrip", f"WITH {_TRAINING_SQL} SELECT text, label FROM tr")
def s5_s8_training_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "train-csv")
    FI.write_delimited(_training(spark, sf).select("text", "label"), path)
    return FI.read_training(spark, path)


@register("s4_s9_metrics_tsv_roundtrip", _table_sql() +
          ' SELECT "Evaluation Metrics", round(Polarity, 6) AS Polarity, round(Subjectivity, 6) AS Subjectivity FROM tbl')
def s4_s9_metrics_tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "metrics-tsv")
    FI.write_delimited(_table(spark, sf), path, sep="\t")
    m = FI.read_metrics(spark, path)
    return m.select("Evaluation Metrics", F.round("Polarity", 6).alias("Polarity"),
                    F.round("Subjectivity", 6).alias("Subjectivity"))


@register("s9_m13_summary_tsv_roundtrip", f"""
WITH s AS ({OS.summary_sql(n=5)})
SELECT title AS "Title", total_comments AS "Total Comments", positive AS "Positive Comments",
       negative AS "Negative Comments", neutral AS "Neutral Comments", summary AS "Key Points" FROM s""")
def s9_m13_summary_tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "summary-tsv")
    rows = SU.report_rows(SU.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf)))
    FI.write_delimited(rows, path, sep="\t")
    schema = ("Title string, `Total Comments` long, `Positive Comments` long, `Negative Comments` long, "
              "`Neutral Comments` long, `Key Points` string")
    return (spark.read.schema(schema).option("sep", "\t").option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


@register("s3_s11_lines_roundtrip", f"""
SELECT CASE WHEN match IS NOT NULL THEN title || ': r/' || match ELSE title || ': No subreddit found' END AS line
FROM ({_MATCH_SQL})""")
def s3_s11_lines_roundtrip(spark, sf):
    path = scratch_path(spark, "lines")
    FI.write_lines(s11_render_mapping(spark, sf), "line", path)
    return FI.read_lines(spark, path).select("line")


@register("f11_permissive_json_lines", """
SELECT CAST(conv_id AS VARCHAR) AS post_id, text AS title FROM conversations
WHERE turn = 0 AND NOT starts_with(text, 'E')""")
def f11_permissive_json_lines(spark, sf):
    """Every post is written; those whose title starts with 'E' are written
    as broken JSON, which the PERMISSIVE reader skips."""
    path = scratch_path(spark, "bad-json")
    p = conversation_posts(spark, sf)
    line = F.when(F.col("title").startswith("E"), F.concat(F.lit('{"post_id": "'), F.col("post_id").cast("string"),
                                                          F.lit('", "title": ')))
    line = line.otherwise(F.to_json(F.struct(F.col("post_id").cast("string").alias("post_id"), "title")))
    p.select(line.alias("value")).write.text(path)
    posts, _ = PIO.read_posts(spark, path)
    return posts.select("post_id", "title")


def _discussion_lines(spark, sf):
    """Each conversation as one JSON line: ["junk", {title?, comments: nested lists}]."""
    c = conversation_comments(spark, sf)
    cj = c.select("post_id", "pos", F.to_json(F.struct("comment_id", "text", "author")).alias("j"))
    nested = (cj.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("pos", "j"))).getField("j").alias("cs"))
              .select("post_id", F.aggregate(F.reverse("cs"), F.lit(""), lambda acc, x: F.when(
                  acc == "", F.concat(F.lit("["), x, F.lit("]"))).otherwise(
                  F.concat(F.lit("["), x, F.lit(', "x", 7, '), acc, F.lit("]")))).alias("comments")))
    p = conversation_posts(spark, sf).select("post_id", "title")
    d = p.join(nested, "post_id", "left").withColumn("comments", F.coalesce("comments", F.lit("[]")))
    title = F.when(F.col("post_id") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"title": '), F.to_json(F.array("title")).substr(F.lit(2), F.length(F.to_json(F.array("title"))) - 2),
                 F.lit(", ")))
    return d.select(F.concat(F.lit('["junk", {'), title, F.lit('"comments": '), F.col("comments"), F.lit("}]"))
                    .alias("value"))


@register("u4_f12_s2_nested_discussions_summary", f"""
WITH s AS ({OS.summary_sql(n=5)})
SELECT CASE WHEN post_id % 4 = 0 THEN 'Discussion 2' ELSE title END AS title, summary,
       total_comments, positive, negative, neutral FROM s""")
def u4_f12_s2_nested_discussions_summary(spark, sf):
    path = scratch_path(spark, "discussions")
    _discussion_lines(spark, sf).write.text(path)
    posts, comments = PIO.read_discussions(spark, path)
    return SU.summarize(posts, comments).drop("post_id")


_POSTS_SQL = "SELECT conv_id AS post_id, text AS title FROM conversations WHERE turn = 0"
_COMMENTS_SQL = """SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos,
  CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, text FROM conversations WHERE turn > 0"""


def _both_sides(posts, comments):
    """Posts (pos -1) and comments as one table."""
    p = posts.select(F.col("post_id").cast("long").alias("post_id"), F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("comment_id"),
                     F.col("title").alias("text"))
    return p.unionByName(comments.select(F.col("post_id").cast("long").alias("post_id"), F.col("pos").cast("int").alias("pos"), "comment_id", "text"))


_BOTH_SQL = f"""SELECT post_id, CAST(-1 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS comment_id, title AS text FROM ({_POSTS_SQL})
UNION ALL SELECT post_id, pos, comment_id, text FROM ({_COMMENTS_SQL})"""


@register("s6_s1_both_sides_read_back", _BOTH_SQL)
def s6_s1_both_sides_read_back(spark, sf):
    path = scratch_path(spark, "posts-both")
    com = conversation_comments(spark, sf).select("post_id", "pos", "comment_id", "text", "score", "author")
    PIO.write_posts_json(conversation_posts(spark, sf).drop("created_ts"), com, path)
    return _both_sides(*PIO.read_posts(spark, path))


@register("s12_comment_predictions_to_new_path", f"""
WITH com AS ({_COMMENTS_SQL}) SELECT com.post_id, com.comment_id, CAST(v.polarity AS DOUBLE) AS polarity
FROM com JOIN {G.vote_sql('com', 'post_id, comment_id', 'text', 16, 8)} v USING (post_id, comment_id)""")
def s12_comment_predictions_to_new_path(spark, sf):
    zero = F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"))
    posts = conversation_posts(spark, sf).withColumn("sentiment", zero)
    com = conversation_comments(spark, sf).withColumn("sentiment", zero)
    pp = MO.predict_polarity(posts, ["post_id"], "title", size=16, overlap=8)
    cp = MO.predict_polarity(com, ["post_id", "comment_id"], "text", size=16, overlap=8)
    p2, c2 = MO.apply_predictions(posts, com, pp, cp)
    path = scratch_path(spark, "comment-predictions")
    PIO.write_posts_json(p2.drop("created_ts"), c2.drop("created_ts"), path)
    _, c = PIO.read_posts(spark, path)
    return c.select(F.col("post_id").cast("long").alias("post_id"), "comment_id", F.col("sentiment.polarity").alias("polarity"))


def _post_records(spark, sf):
    """(post_id, record): every conversation as the JSON of a post with its comments."""
    com = (conversation_comments(spark, sf).groupBy("post_id")
           .agg(F.sort_array(F.collect_list(F.struct("pos", "comment_id", "text"))).alias("c"))
           .select("post_id", F.transform("c", lambda x: x.dropFields("pos")).alias("comments")))
    p = conversation_posts(spark, sf).select("post_id", "title").join(com, "post_id", "left")
    return p.select("post_id", F.to_json(F.struct(F.col("post_id").cast("string").alias("post_id"), "title", "comments")).alias("record"))


@register("s1_mixed_folder", _BOTH_SQL)
def s1_mixed_folder(spark, sf):
    """Every other hundred posts as a pretty array file, the others as JSON lines, in one folder."""
    path = scratch_path(spark, "mixed")
    records = _post_records(spark, sf).withColumn("file", F.floor(F.col("post_id") / 100)).checkpoint()
    arrays = records.where("file % 2 = 0").groupBy("file").agg(F.sort_array(F.collect_list("record")).alias("r"))
    (arrays.select(F.concat(F.lit("[\n  "), F.array_join("r", ",\n  "), F.lit("\n]")).alias("value"))
     .write.mode("append").option("maxRecordsPerFile", 1).text(path))
    records.where("file % 2 = 1").select(F.col("record").alias("value")).write.mode("append").text(path)
    return _both_sides(*PIO.read_posts(spark, path))


@register("s3_line_positions", """
SELECT c_mktsegment AS segment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS line_no, c_name AS line FROM customer""")
def s3_line_positions(spark, sf):
    """A file of customer names a segment, in the order of their keys; each line comes back with its number in its file."""
    path = scratch_path(spark, "numbered")
    c = read_table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.col("c_name").alias("value"))
    c = c.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").drop("c_custkey")
    c.write.partitionBy("c_mktsegment").text(path)
    lines = FI.read_lines(spark, path)
    segment = F.url_decode(F.url_decode(F.regexp_extract("file", "c_mktsegment=([^/]*)/", 1)))
    return lines.select(segment.alias("segment"), "line_no", "line")


@register("s2_jsonl_titles", """
SELECT conv_id % 8 AS part, conv_id, CASE WHEN conv_id % 3 = 0 THEN text ELSE
  'Discussion ' || CAST(row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id) AS VARCHAR) END AS title
FROM conversations WHERE turn = 0""")
def s2_jsonl_titles(spark, sf):
    """Eight files of JSON lines, one object a line; two thirds have no title and are called after their place in the file."""
    path = scratch_path(spark, "titles")
    p = conversation_posts(spark, sf).withColumn("part", F.col("post_id") % 8)
    title = F.when(F.col("post_id") % 3 == 0, F.col("title"))
    comments = F.array(F.array(F.struct(F.col("post_id").cast("string").alias("comment_id"))))
    p = p.select("part", "post_id", F.to_json(F.struct(title.alias("title"), comments.alias("comments"))).alias("value"))
    p.repartition("part").sortWithinPartitions("part", "post_id").drop("post_id").write.partitionBy("part").text(path)
    posts, comments = PIO.read_discussions(spark, path)
    part = F.regexp_extract("post_id", "part=([0-9]+)/", 1).cast("long")
    return posts.join(comments, "post_id").select(part.alias("part"), F.col("comment_id").cast("long").alias("conv_id"), "title")


@register("s2_pretty_array_discussions", _BOTH_SQL)
def s2_pretty_array_discussions(spark, sf):
    """Pretty-printed array files of a hundred discussions each, through the tolerant reader."""
    path = scratch_path(spark, "pretty")
    records = _post_records(spark, sf).groupBy(F.floor(F.col("post_id") / 100).alias("file")).agg(F.sort_array(F.collect_list("record")).alias("r"))
    (records.select(F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("\n]")).alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))
    posts, comments = PIO.read_discussions(spark, path)
    ids = comments.groupBy("post_id").agg(F.split_part(F.min("comment_id"), F.lit("_"), F.lit(1)).alias("id"))
    named = posts.join(ids, "post_id", "left")
    back = comments.join(ids, "post_id").select(F.col("id").alias("post_id"), "pos", "comment_id", "text")
    return _both_sides(named.select(F.col("id").alias("post_id"), "title"), back)


@register("u4_deep_nesting", f"SELECT post_id, pos, comment_id, text FROM ({_COMMENTS_SQL})")
def u4_deep_nesting(spark, sf):
    """Each comment of a discussion lies one list deeper than the one before, the first 1,500 lists deep."""
    path = scratch_path(spark, "deep")
    c = conversation_comments(spark, sf).select("post_id", "pos", F.to_json(F.struct("comment_id", "text")).alias("j"))
    c = c.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("pos", "j"))).getField("j").alias("r"))
    body = F.concat(F.lit("[" * 1500), F.array_join("r", ", ["), F.repeat(F.lit("]"), F.size("r") - 1), F.lit("]" * 1500))
    c.select(F.concat(F.lit('{"title": "t", "comments": '), body, F.lit("}")).alias("value")).write.text(path)
    _, comments = PIO.read_discussions(spark, path)
    post_id = F.split_part("comment_id", F.lit("_"), F.lit(1)).cast("long")
    return comments.select(post_id.alias("post_id"), "pos", "comment_id", "text")


@register("f11_skipped_count", """
WITH p AS (SELECT conv_id, text FROM conversations WHERE turn = 0)
SELECT 'posts' AS reader, count(*) FILTER (WHERE NOT starts_with(text, 'E')) AS n_read, count(*) FILTER (WHERE starts_with(text, 'E')) AS n_skipped,
       count(*) FILTER (WHERE starts_with(text, 'E')) AS n_listed FROM p
UNION ALL
SELECT 'discussions', count(*), 2 * count(*) FILTER (WHERE starts_with(text, 'E')), 2 * count(*) FILTER (WHERE starts_with(text, 'E')) FROM p""")
def f11_skipped_count(spark, sf):
    """Broken posts are counted by the scan that reads the others; of discussions, broken lines and entries that are no objects."""
    bad, path = F.col("title").startswith("E"), scratch_path(spark, "skips")
    p = conversation_posts(spark, sf)
    good = F.to_json(F.struct(F.col("post_id").cast("string").alias("post_id"), "title"))
    p.select(F.when(bad, '{"post_id": "').otherwise(good).alias("value")).write.text(path)
    found = PIO.read_posts_counted(spark, path)
    read = found.posts.agg(F.count("*").alias("n_read"))
    posts = read.select(F.lit("posts").alias("reader"), "n_read", F.lit(found.n_skipped).cast("long").alias("n_skipped"))
    posts = posts.crossJoin(F.broadcast(found.skipped.agg(F.count("*").alias("n_listed"))))  # one row each
    path = scratch_path(spark, "skips-discussions")
    p.select(F.explode(F.when(bad, F.array(F.lit('[{"title": "x"}, 7]'), F.lit('{"title": '))).otherwise(F.array(good))).alias("value")).write.text(path)
    found = DI.read(spark, path)
    other = found.counts.select(F.lit("discussions").alias("reader"), F.col("read").alias("n_read"), F.col("skipped").alias("n_skipped"))
    return posts.unionByName(other.crossJoin(F.broadcast(found.skipped.agg(F.count("*").alias("n_listed")))))
