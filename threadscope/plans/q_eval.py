"""Labels, samples, splits and evaluation on ``documents`` + ``labels`` and
``conversations`` (T5, W5, W7, U3, F6, A14, X15-X17, A16, E1, E2, E4, E5,
F8, U2, E3).

Truth: toxic=1 -> -1, else quality=1 -> 1, else 0.  Prediction: the sign
of the lexicon polarity (rounded to 9 decimals first).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import numeric as N
from ..operators import enrich as EN
from ..operators import evaluate as EV
from ..operators import rouge as RG
from ..operators import sampling as SA
from ..operators import stats as ST
from ..operators import summary as SU
from ..session import read_table, scratch_path
from ..sources import posts_io as PIO
from ..sources.testdata import conversation_comments, conversation_posts
from . import oracle_summary as OS
from . import sqlgen as G
from .q_steps import DATA_LEXICON
from .registry import register

NEG_LEXICON = [e for e in rules.DEFAULT_LEXICON if e[1] < 0]
MODELS = ["lexicon", "negative-lexicon"]


def _truth(l):
    return (F.when(l["toxic"] == 1, F.lit(-1)).when(l["quality"] == 1, F.lit(1)).otherwise(F.lit(0))
            .cast("int"))


def _pairs(spark, sf, lexicon=None):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels")
    s = EN.lexicon_sentiment(d, "text", lexicon, "s", ["doc_id"])
    return (s.join(lab, "doc_id").select(
        "doc_id", _truth(lab).alias("actual"),
        N.make_int(F.round("s.polarity", 9)).alias("predicted"),
        lab["quality"].cast("int").alias("actual_subj"),
        N.make_int(F.round("s.subjectivity", 9)).alias("predicted_subj")))


def _pairs_sql(lexicon=None):
    return f"""
pairs AS (
  SELECT l.doc_id,
    CAST(CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS actual,
    CAST(sign(round(coalesce(s.pol, 0.0), 9)) AS INTEGER) AS predicted,
    CAST(l.quality AS INTEGER) AS actual_subj,
    CAST(sign(round(coalesce(s.subj, 0.0), 9)) AS INTEGER) AS predicted_subj
  FROM documents d JOIN labels l USING (doc_id)
  LEFT JOIN {G.lexicon_scores('documents', 'doc_id', 'text', lexicon)} s USING (doc_id))"""


def _metric_ctes(prefix: str, truth: str, pred: str) -> str:
    return f"""
{prefix}_conf AS (SELECT {truth} AS actual, {pred} AS predicted, count(*) AS n FROM pairs GROUP BY ALL),
{prefix}_cls AS (SELECT actual AS cls FROM {prefix}_conf UNION SELECT predicted FROM {prefix}_conf),
{prefix}_pc AS (
  SELECT k.cls,
    coalesce(sum(CASE WHEN c.actual = k.cls AND c.predicted = k.cls THEN c.n END), 0) AS tp,
    coalesce(sum(CASE WHEN c.actual = k.cls THEN c.n END), 0) AS support,
    coalesce(sum(CASE WHEN c.predicted = k.cls THEN c.n END), 0) AS npred
  FROM {prefix}_cls k CROSS JOIN {prefix}_conf c GROUP BY k.cls),
{prefix}_m AS (
  SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
    SELECT cls, tp, support, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS p,
           CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM {prefix}_pc)),
{prefix}_macro AS (
  SELECT avg(p) AS precision, avg(r) AS recall, avg(f1) AS f1, sum(tp) / sum(support) AS accuracy
  FROM {prefix}_m),
{prefix}_weighted AS (
  SELECT sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
         sum(f1 * support) / sum(support) AS f1, sum(tp) / sum(support) AS accuracy FROM {prefix}_m)"""


def _round_all(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("x15_make_int", "WITH " + _pairs_sql().strip() + " SELECT doc_id, predicted FROM pairs")
def x15_make_int(spark, sf):
    return _pairs(spark, sf).select("doc_id", "predicted")


@register("f6_labelled_pairs", "WITH " + _pairs_sql().strip() +
          " SELECT doc_id, actual, predicted FROM pairs WHERE actual IS NOT NULL AND predicted IS NOT NULL")
def f6_labelled_pairs(spark, sf):
    p = _pairs(spark, sf)
    return p.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).select(
        "doc_id", "actual", "predicted")


@register("a16_confusion", "WITH " + _pairs_sql().strip() +
          " SELECT actual, predicted, count(*) AS n FROM pairs GROUP BY ALL")
def a16_confusion(spark, sf):
    return EV.confusion(_pairs(spark, sf))


_M = ["precision", "recall", "f1", "accuracy"]
_MSEL = ", ".join(f"round({c}, 6) AS {c}" for c in _M)


@register("e1_macro_metrics", "WITH " + _pairs_sql().strip() + "," + _metric_ctes("pol", "actual", "predicted")
          + f" SELECT {_MSEL} FROM pol_macro")
def e1_macro_metrics(spark, sf):
    return _round_all(EV.macro_metrics(_pairs(spark, sf)), _M)


@register("e2_weighted_metrics", "WITH " + _pairs_sql().strip() + "," + _metric_ctes("pol", "actual", "predicted")
          + f" SELECT {_MSEL} FROM pol_weighted")
def e2_weighted_metrics(spark, sf):
    return _round_all(EV.weighted_metrics(_pairs(spark, sf)), _M)


def _table_sql(lexicon=None):
    return ("WITH " + _pairs_sql(lexicon).strip() + "," + _metric_ctes("pol", "actual", "predicted") + ","
            + _metric_ctes("sub", "actual_subj", "predicted_subj") + """,
tbl AS (
  SELECT 'Precision' AS "Evaluation Metrics", p.precision AS Polarity, s.precision AS Subjectivity FROM pol_macro p, sub_macro s
  UNION ALL SELECT 'Recall', p.recall, s.recall FROM pol_macro p, sub_macro s
  UNION ALL SELECT 'Accuracy', p.accuracy, s.accuracy FROM pol_macro p, sub_macro s
  UNION ALL SELECT 'F1 Score', p.f1, s.f1 FROM pol_macro p, sub_macro s)""")


def _table(spark, sf, lexicon=None):
    return EV.metrics_table(_pairs(spark, sf, lexicon))


@register("e5_metrics_table", _table_sql() +
          ' SELECT "Evaluation Metrics", round(Polarity, 6) AS Polarity, round(Subjectivity, 6) AS Subjectivity FROM tbl')
def e5_metrics_table(spark, sf):
    return _round_all(_table(spark, sf), ["Polarity", "Subjectivity"])


@register("f8_tag_metrics", _table_sql() +
          " SELECT \"Evaluation Metrics\" AS Metric, round(Polarity, 6) AS Polarity, "
          "round(Subjectivity, 6) AS Subjectivity, 'lexicon' AS Model FROM tbl")
def f8_tag_metrics(spark, sf):
    return _round_all(EV.tag_metrics(_table(spark, sf), "lexicon"), ["Polarity", "Subjectivity"])


def _stack_sql():
    a = _table_sql().replace("WITH ", "", 1)
    b = _table_sql(NEG_LEXICON).replace("WITH ", "", 1)
    return f"""
WITH ta AS (WITH {a} SELECT * FROM tbl), tb AS (WITH {b} SELECT * FROM tbl),
st AS (SELECT "Evaluation Metrics" AS Metric, Polarity, Subjectivity, 'lexicon' AS Model FROM ta
       UNION ALL SELECT "Evaluation Metrics", Polarity, Subjectivity, 'negative-lexicon' FROM tb)"""


def _stacked(spark, sf):
    """Both models over one scan of the texts, their tables by two aggregations."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels")
    for i, lexicon in enumerate((None, NEG_LEXICON)):
        d = EN.lexicon_sentiment(d, "text", lexicon, f"s{i}", ["doc_id"])
    models = F.array(*[F.struct(F.lit(m).alias("Model"), N.make_int(F.round(f"s{i}.polarity", 9)).alias("predicted"),
                                N.make_int(F.round(f"s{i}.subjectivity", 9)).alias("predicted_subj")) for i, m in enumerate(MODELS)])
    pairs = d.join(lab, "doc_id").select(_truth(lab).alias("actual"), lab["quality"].cast("int").alias("actual_subj"), F.explode(models).alias("m"))
    tables = EV.metrics_tables(EV.stack_tasks(pairs.select("actual", "actual_subj", "m.*"), ["Model"]), ["Model"])
    return tables.withColumnRenamed("Evaluation Metrics", "Metric").select("Metric", "Polarity", "Subjectivity", "Model")


@register("u2_compare_models", _stack_sql() +
          " SELECT Metric, round(Polarity, 6) AS Polarity, round(Subjectivity, 6) AS Subjectivity, Model FROM st")
def u2_compare_models(spark, sf):
    return _round_all(_stacked(spark, sf), ["Polarity", "Subjectivity"])


@register("e4_metric_matrix", _stack_sql() + """
SELECT Metric, round(max(CASE WHEN Model = 'lexicon' THEN Polarity END), 6) AS "lexicon",
       round(max(CASE WHEN Model = 'negative-lexicon' THEN Polarity END), 6) AS "negative-lexicon"
FROM st GROUP BY Metric""")
def e4_metric_matrix(spark, sf):
    return _round_all(EV.metric_matrix(_stacked(spark, sf), MODELS), MODELS)


# ---- samples, splits, training rows -------------------------------------

@register("t5_sample_posts", """
SELECT doc_id FROM documents ORDER BY md5('42#' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 200""")
def t5_sample_posts(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"))
    return SA.sample_posts(d, n=200, seed=42).select(F.col("post_id").alias("doc_id"))


@register("w5_sample_comments", """
SELECT post_id, comment_id FROM (
  SELECT conv_id AS post_id, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY md5('42#' || CAST(conv_id AS VARCHAR) || '_' ||
           CAST(turn AS VARCHAR)), CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR)) AS rn
  FROM conversations WHERE turn > 0) WHERE rn <= 2""")
def w5_sample_comments(spark, sf):
    c = conversation_comments(spark, sf)
    return SA.sample_comments(c, n=2, seed=42).select("post_id", "comment_id")


def _training(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels")
    posts = d.join(lab, "doc_id").select(F.col("doc_id").alias("post_id"), F.col("text").alias("title"),
                                         _truth(lab).alias("actual_polarity"))
    c = conversation_comments(spark, sf)
    c = EN.lexicon_sentiment(c, "text", DATA_LEXICON, "s")
    c = c.withColumn("actual_polarity", N.make_int(F.round("s.polarity", 9)))
    return SA.training_rows(posts, c)


_TRAINING_SQL = f"""
tr AS (
  SELECT 'post' AS kind, d.doc_id AS post_id, -1 AS pos, d.text,
         CAST(CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 ELSE 0 END + 1 AS INTEGER) AS label
  FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL
  UNION ALL
  SELECT 'comment', c.conv_id, CAST(c.turn - 1 AS INTEGER), c.text,
         CAST(sign(round(coalesce(s.pol, 0.0), 9)) + 1 AS INTEGER)
  FROM conversations c LEFT JOIN {G.lexicon_scores('conversations', 'conv_id, turn', 'text', DATA_LEXICON)} s
    USING (conv_id, turn)
  WHERE c.turn > 0 AND c.text IS NOT NULL)"""


@register("u3_x16_training_rows", f"WITH {_TRAINING_SQL} SELECT kind, post_id, pos, text, label FROM tr")
def u3_x16_training_rows(spark, sf):
    return _training(spark, sf).select("kind", "post_id", "pos", "text", "label")


@register("x17_label_to_polarity", f"WITH {_TRAINING_SQL} SELECT kind, post_id, pos, label - 1 AS polarity FROM tr")
def x17_label_to_polarity(spark, sf):
    return _training(spark, sf).select("kind", "post_id", "pos", N.label_to_polarity("label").alias("polarity"))


@register("a14_labelled_count", f"WITH {_TRAINING_SQL} SELECT count(label) AS n_labelled FROM tr")
def a14_labelled_count(spark, sf):
    return ST.labelled_count(_training(spark, sf), "label")


@register("w7_train_test_split", f"""
WITH {_TRAINING_SQL},
r AS (SELECT kind, post_id, pos, row_number() OVER (ORDER BY md5('42#' || kind || '#' || CAST(post_id AS VARCHAR)
        || '#' || CAST(pos AS VARCHAR))) AS rk, count(*) OVER () AS n FROM tr)
SELECT kind, post_id, pos, CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def w7_train_test_split(spark, sf):
    t = _training(spark, sf)
    return SA.train_test_split(t, ["kind", "post_id", "pos"], 0.2, 42).select("kind", "post_id", "pos", "split")


@register("w7_split_by_post", f"""
WITH {_TRAINING_SQL},
k AS (SELECT DISTINCT kind, post_id FROM tr),
r AS (SELECT kind, post_id, row_number() OVER (ORDER BY md5('42#' || kind || '#' || CAST(post_id AS VARCHAR))) AS rk,
        count(*) OVER () AS n FROM k)
SELECT tr.kind, tr.post_id, tr.pos, CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
FROM tr JOIN r USING (kind, post_id)""")
def w7_split_by_post(spark, sf):
    t = _training(spark, sf)
    keys = SA.train_test_split(t.select("kind", "post_id").distinct(), ["kind", "post_id"], 0.2, 42)
    return t.join(keys, ["kind", "post_id"]).select("kind", "post_id", "pos", "split")


# ---- ROUGE ----------------------------------------------------------------

def _rouge_pairs(spark, sf):
    s = SU.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf))
    return s.select("post_id", F.col("summary").alias("cand"), F.col("title").alias("ref"))


def _rouge_n_sql(n: int) -> str:
    tk_c = G.tokens("cand", clean=False)
    tk_r = G.tokens("ref", clean=False)
    return f"""
c{n} AS (SELECT post_id, g, count(*) AS cc FROM (
  SELECT post_id, array_to_string(tk[i:i + {n} - 1], ' ') AS g FROM (
    SELECT post_id, tk, generate_subscripts(tk, 1) AS i FROM (SELECT post_id, {tk_c} AS tk FROM pr))
  WHERE i + {n} - 1 <= len(tk)) GROUP BY ALL),
r{n} AS (SELECT post_id, g, count(*) AS rc FROM (
  SELECT post_id, array_to_string(tk[i:i + {n} - 1], ' ') AS g FROM (
    SELECT post_id, tk, generate_subscripts(tk, 1) AS i FROM (SELECT post_id, {tk_r} AS tk FROM pr))
  WHERE i + {n} - 1 <= len(tk)) GROUP BY ALL),
o{n} AS (SELECT pr.post_id,
   coalesce((SELECT sum(least(cc, rc)) FROM c{n} JOIN r{n} USING (post_id, g) WHERE c{n}.post_id = pr.post_id), 0) AS ov,
   coalesce((SELECT sum(cc) FROM c{n} WHERE c{n}.post_id = pr.post_id), 0) AS nc,
   coalesce((SELECT sum(rc) FROM r{n} WHERE r{n}.post_id = pr.post_id), 0) AS nr FROM pr),
s{n} AS (SELECT post_id, CASE WHEN nc = 0 THEN 0.0 ELSE ov / nc END AS p, CASE WHEN nr = 0 THEN 0.0 ELSE ov / nr END AS r
   FROM o{n})"""


@register("e3_rouge_n_summary_vs_post", f"""
WITH s AS ({OS.summary_sql(n=5)}),
pr AS (SELECT post_id, summary AS cand, title AS ref FROM s),
{_rouge_n_sql(1)},
{_rouge_n_sql(2)}
SELECT s1.post_id, round(s1.p, 6) AS rouge1_p, round(s1.r, 6) AS rouge1_r,
  round(CASE WHEN s1.p + s1.r = 0 THEN 0.0 ELSE 2 * s1.p * s1.r / (s1.p + s1.r) END, 6) AS rouge1_f,
  round(s2.p, 6) AS rouge2_p, round(s2.r, 6) AS rouge2_r,
  round(CASE WHEN s2.p + s2.r = 0 THEN 0.0 ELSE 2 * s2.p * s2.r / (s2.p + s2.r) END, 6) AS rouge2_f
FROM s1 JOIN s2 USING (post_id)""")
def e3_rouge_n_summary_vs_post(spark, sf):
    r = RG.rouge(_rouge_pairs(spark, sf), "post_id", "cand", "ref", with_l=False)
    return _round_all(r, [f"rouge{n}_{k}" for n in (1, 2) for k in "prf"])


_LCS_SQL = f"""
WITH RECURSIVE s AS ({OS.summary_sql(n=5)}),
pr AS (SELECT post_id, {G.tokens('summary', clean=False)} AS b, {G.tokens('title', clean=False)} AS a FROM s),
dp AS (
  SELECT post_id, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS row, a, b FROM pr
  UNION ALL
  SELECT post_id, i + 1,
    list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN row[j] + 1
                ELSE greatest(row[j + 1], acc[j]) END), [0]),
    a, b
  FROM dp WHERE i < len(a)),
l AS (SELECT post_id, CAST(row[len(b) + 1] AS BIGINT) AS lcs, len(b) AS nc, len(a) AS nr FROM dp WHERE i = len(a)),
pr2 AS (SELECT post_id, lcs, CASE WHEN nc = 0 THEN 0.0 ELSE lcs / nc END AS p,
               CASE WHEN nr = 0 THEN 0.0 ELSE lcs / nr END AS r FROM l)
SELECT post_id, lcs, round(p, 6) AS rougeL_p, round(r, 6) AS rougeL_r,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS rougeL_f FROM pr2"""


@register("e3_rouge_l_summary_vs_post", _LCS_SQL)
def e3_rouge_l_summary_vs_post(spark, sf):
    """ROUGE-L via the bit-parallel LCS (Arrow-batched UDF); the oracle is
    the textbook DP as a recursive query."""
    r = RG.rouge_l(_rouge_pairs(spark, sf), "post_id", "cand", "ref")
    return _round_all(r, ["rougeL_p", "rougeL_r", "rougeL_f"])


@register("j7_truth_prediction_join", f"""
WITH {_pairs_sql().strip()},
votes AS (SELECT doc_id, polarity FROM {G.vote_sql('documents', 'doc_id', 'text', 64, 32)})
SELECT p.doc_id, p.actual, v.polarity AS predicted FROM pairs p JOIN votes v USING (doc_id)""")
def j7_truth_prediction_join(spark, sf):
    """J7 with predictions as their own table (the M7 window vote), equi-joined
    to the truth on the item id."""
    from ..operators import models as MO
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    votes = MO.predict_polarity(d, ["doc_id"], "text", size=64, overlap=32)
    truth = _pairs(spark, sf).select("doc_id", "actual")
    return truth.join(votes, "doc_id").select("doc_id", "actual", F.col("polarity").alias("predicted"))


# ---- from post files ---------------------------------------------------------

def _labelled_posts_comments(spark, sf):
    """Posts (documents with labels) and comments (conversations; every fourth without truth), with a ``sentiment`` of four values:
    the lexicon's are predicted; true are the label of a document and the sign of the data lexicon of a comment."""
    def sentiment(pol, subj, true_pol, true_subj):
        return F.struct(pol.alias("polarity"), subj.alias("subjectivity"), true_pol.cast("double").alias("actual_polarity"),
                        true_pol.cast("double").alias("actual polarity"), true_subj.cast("double").alias("actual subjectivity"))

    lab = read_table(spark, sf, "labels")
    d = EN.lexicon_sentiment(read_table(spark, sf, "documents").select("doc_id", "text"), "text", None, "s")
    posts = d.join(lab, "doc_id").select(F.concat(F.lit("d"), "doc_id").alias("post_id"), F.col("text").alias("title"), sentiment(
        F.round("s.polarity", 9), F.round("s.subjectivity", 9), _truth(lab), lab["quality"]).alias("sentiment"))
    conversations = conversation_posts(spark, sf).select(F.concat(F.lit("c"), "post_id").alias("post_id"), "title",
                                                         F.lit(None).cast(posts.schema["sentiment"].dataType).alias("sentiment"))
    c = conversation_comments(spark, sf)
    for name, lexicon in (("s", None), ("t", DATA_LEXICON)):
        c = EN.lexicon_sentiment(c, "text", lexicon, name)
    truth = F.when((F.col("pos") + 1) % 4 != 0, N.make_int(F.round("t.polarity", 9)))
    comments = c.select(F.concat(F.lit("c"), "post_id").alias("post_id"), "pos", "comment_id", "text", sentiment(
        F.round("s.polarity", 9), F.round("s.subjectivity", 9), truth, truth).alias("sentiment"))
    return posts.unionByName(conversations), comments


_LABELLED_SQL = f"""
lp AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS post_id, actual, predicted, actual_subj, predicted_subj FROM pairs),
lc AS (SELECT 'c' || CAST(c.conv_id AS VARCHAR) AS post_id, CAST(c.conv_id AS VARCHAR) || '_' || CAST(c.turn AS VARCHAR) AS comment_id,
  CASE WHEN c.turn % 4 <> 0 THEN CAST(sign(round(coalesce(t.pol, 0.0), 9)) AS INTEGER) END AS truth,
  CAST(sign(round(coalesce(s.pol, 0.0), 9)) AS INTEGER) AS predicted, CAST(sign(round(coalesce(s.subj, 0.0), 9)) AS INTEGER) AS predicted_subj, c.text
  FROM conversations c LEFT JOIN {G.lexicon_scores('conversations', 'conv_id, turn', 'text')} s USING (conv_id, turn)
  LEFT JOIN {G.lexicon_scores('conversations', 'conv_id, turn', 'text', DATA_LEXICON)} t USING (conv_id, turn) WHERE c.turn > 0)"""

_STACKED_SQL = """
SELECT 'post' AS kind, 'Polarity' AS task, actual, predicted FROM lp UNION ALL SELECT 'post', 'Subjectivity', actual_subj, predicted_subj FROM lp
UNION ALL SELECT 'comment', 'Polarity', truth, predicted FROM lc WHERE truth IS NOT NULL
UNION ALL SELECT 'comment', 'Subjectivity', truth, predicted_subj FROM lc WHERE truth IS NOT NULL"""


def _read_labelled(spark, sf):
    path = scratch_path(spark, "labelled")
    PIO.write_posts_json(*_labelled_posts_comments(spark, sf), path)
    return PIO.read_posts(spark, path)


@register("f6_pairs_from_posts_comments", f"WITH {_pairs_sql().strip()}, {_LABELLED_SQL}, st AS ({_STACKED_SQL}) "
          "SELECT kind, task, CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted, count(*) AS n FROM st GROUP BY ALL")
def f6_pairs_from_posts_comments(spark, sf):
    """Pairs from a post file: every sentiment with a true and a predicted value, of posts and of comments."""
    pairs = EV.labelled_pairs(*_read_labelled(spark, sf))
    return pairs.groupBy("kind", "task", "actual", "predicted").agg(F.count("*").alias("n"))


def _metrics_of_stack_sql(src: str) -> str:
    return f"""
cl AS (SELECT task, cls, sum(tp) AS tp, sum(support) AS support, sum(npred) AS npred FROM (
  SELECT task, actual AS cls, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS npred FROM {src}
  UNION ALL SELECT task, predicted, 0, 0, 1 FROM {src}) GROUP BY task, cls),
pr AS (SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM cl),
m AS (SELECT task, avg(p) AS p, avg(r) AS r, sum(tp) / sum(support) AS a, avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS f
      FROM pr GROUP BY task),
long AS (SELECT task, unnest(['Precision', 'Recall', 'Accuracy', 'F1 Score']) AS k, unnest([p, r, a, f]) AS v FROM m)
SELECT k AS "Evaluation Metrics", round(max(v) FILTER (WHERE task = 'Polarity'), 6) AS Polarity,
       round(max(v) FILTER (WHERE task = 'Subjectivity'), 6) AS Subjectivity FROM long GROUP BY k"""


@register("e5_from_posts_comments", f"WITH {_pairs_sql().strip()}, {_LABELLED_SQL}, st AS ({_STACKED_SQL}), {_metrics_of_stack_sql('st')}")
def e5_from_posts_comments(spark, sf):
    """The metric table of a post file, posts and comments together."""
    return _round_all(EV.metrics_tables(EV.labelled_pairs(*_read_labelled(spark, sf))), ["Polarity", "Subjectivity"])


@register("w7_labelled_records", f"""
WITH {_pairs_sql().strip()}, {_LABELLED_SQL},
po AS (SELECT post_id, actual FROM lp UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR), NULL FROM conversations WHERE turn = 0),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('42#' || post_id)) AS rk, count(*) OVER () AS n FROM po)
SELECT CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split, rk.post_id, CAST(rk.actual AS INTEGER) AS actual,
       (SELECT count(*) FROM lc WHERE lc.post_id = rk.post_id AND lc.truth IS NOT NULL AND lc.text IS NOT NULL) AS n_comments FROM rk""")
def w7_labelled_records(spark, sf):
    """Labelled records written as train and test files, split by post, and read back: a post keeps its labelled comments."""
    paths = SA.write_split_records(*_labelled_posts_comments(spark, sf), scratch_path(spark, "records"))
    schema = "post_id string, title string, actual_polarity double, comments array<struct<comment_id: string>>"
    sides = [spark.read.schema(schema).json(path).select(F.lit(side).alias("split"), "post_id", F.col("actual_polarity").cast("int").alias("actual"),
                                                         F.size("comments").cast("long").alias("n_comments")) for side, path in paths.items()]
    return sides[0].unionByName(sides[1])
