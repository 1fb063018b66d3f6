"""One query per step of the summary, so a failure points at a step
(X20-X23, X26, J3, J4, J9, A7-A10, W4, T1, M10, M11, M13, S9, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import summary as S
from ..sources.testdata import conversation_comments, conversation_posts
from . import oracle_summary as O
from . import sqlgen as G
from .registry import register

# Parameters of our own: a lexicon of frequent conversation tokens, so that
# comment labels (and the score boosts) vary on the driver's data.
DATA_LEXICON = [("and", 0.3, 0.4), ("der", -0.4, 0.6), ("que", 0.2, 0.1), ("la", -0.1, 0.3),
                ("best", 1.0, 0.3), ("und", 0.5, 0.5), ("en", -0.2, 0.2), ("of", 0.05, 0.1)]


def _steps(spark, sf, lexicon=None):
    return S.summary_steps(conversation_posts(spark, sf), conversation_comments(spark, sf), lexicon)


CTE = O.summary_ctes()
CTE_DATA = O.summary_ctes(DATA_LEXICON)
CTE_SOURCE = O.summary_ctes(DATA_LEXICON, by_source=True)


@register("x21_sentences", CTE + "SELECT post_id, CAST(sid AS BIGINT) AS sid, sentence FROM sents")
def x21_sentences(spark, sf):
    return _steps(spark, sf).sentences.select("post_id", F.col("sid").cast("long").alias("sid"), "sentence")


@register("x22_j9_sentence_tokens", CTE + f"""
SELECT post_id, CAST(sid AS BIGINT) AS sid, word, count(*) AS cnt FROM st
WHERE word NOT IN ({G.stop_words_list()}) GROUP BY post_id, sid, word""")
def x22_j9_sentence_tokens(spark, sf):
    t = _steps(spark, sf).tokens
    return t.groupBy("post_id", F.col("sid").cast("long").alias("sid"), "word").agg(F.count("*").alias("cnt"))


@register("a7_word_freq", CTE + "SELECT post_id, word, freq FROM freq")
def a7_word_freq(spark, sf):
    return _steps(spark, sf).freq.select("post_id", "word", F.col("freq").cast("long").alias("freq"))


@register("a9_discussion_text", CTE + "SELECT post_id, string_agg(text, ' ' ORDER BY pos) AS all_text FROM v GROUP BY post_id")
def a9_discussion_text(spark, sf):
    return S.discussion_text(S.valid_comments(conversation_comments(spark, sf)))


@register("j3_aligned_by_source", CTE_SOURCE
          + "SELECT post_id, CAST(sid AS BIGINT) AS sid, CAST(src AS BIGINT) AS src, sentence, label FROM aligned")
def j3_aligned_by_source(spark, sf):
    a = S.summary_steps(conversation_posts(spark, sf), conversation_comments(spark, sf), DATA_LEXICON, align="source").aligned
    return a.select("post_id", F.col("sid").cast("long").alias("sid"), F.col("src").cast("long").alias("src"), "sentence", "label")


@register("j3_x20_aligned_data_lexicon", CTE_DATA + """
SELECT post_id, CAST(sid AS BIGINT) AS sid, sentence, label,
       CAST(CASE WHEN label = 'positive' THEN 1.1 WHEN label = 'negative' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS boost
FROM aligned""")
def j3_x20_aligned_data_lexicon(spark, sf):
    a = _steps(spark, sf, DATA_LEXICON).aligned
    return a.select("post_id", F.col("sid").cast("long").alias("sid"), "sentence", "label",
                    N.sentiment_boost("label").alias("boost"))


@register("j4_a10_sentence_scores_data_lexicon", CTE_DATA + """
SELECT post_id, CAST(sid AS BIGINT) AS sid, c, n, round(score, 6) AS score, CAST(first_idx AS BIGINT) AS first_idx
FROM scores""")
def j4_a10_sentence_scores_data_lexicon(spark, sf):
    s = _steps(spark, sf, DATA_LEXICON).scores
    return s.select("post_id", F.col("sid").cast("long").alias("sid"), "c", "n",
                    F.round("score", 6).alias("score"), F.col("first_idx").cast("long").alias("first_idx"))


@register("a8_sentiment_distribution_data_lexicon", CTE_DATA + """
SELECT post_id, total_comments, positive, negative, neutral FROM dist""")
def a8_sentiment_distribution_data_lexicon(spark, sf):
    return _steps(spark, sf, DATA_LEXICON).distribution.drop("_any_scored")


@register("m12_summary_base_data_lexicon", O.summary_sql(n=3, lexicon=DATA_LEXICON))
def m12_summary_base_data_lexicon(spark, sf):
    return S.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf), n=3,
                       lexicon=DATA_LEXICON)


# The three fallbacks, driven by a fixed id rule on the comments.
_FALLBACK_COMMENTS = """
  SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos,
    CASE WHEN conv_id % 9 = 0 THEN '[deleted]'
         WHEN conv_id % 13 = 0 THEN '   '
         WHEN conv_id % 17 = 0 THEN 'The, and of it.'
         ELSE coalesce(text, '') END AS text
  FROM conversations WHERE turn > 0"""


def _fallback_comments(spark, sf):
    c = conversation_comments(spark, sf)
    pid = F.col("post_id")
    t = (F.when(pid % 9 == 0, F.lit("[deleted]")).when(pid % 13 == 0, F.lit("   "))
         .when(pid % 17 == 0, F.lit("The, and of it.")).otherwise(F.coalesce("text", F.lit(""))))
    return c.withColumn("text", t)


@register("m10_summary_fallbacks", O.summary_sql(n=5, comments_sql=_FALLBACK_COMMENTS))
def m10_summary_fallbacks(spark, sf):
    return S.summarize(conversation_posts(spark, sf), _fallback_comments(spark, sf), n=5)


_REPORT_SQL = O.summary_sql(n=5)


@register("m13_s9_report_rows", f"""
WITH s AS ({_REPORT_SQL})
SELECT title AS "Title", total_comments AS "Total Comments", positive AS "Positive Comments",
       negative AS "Negative Comments", neutral AS "Neutral Comments", summary AS "Key Points" FROM s""")
def m13_s9_report_rows(spark, sf):
    return S.report_rows(S.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf)))


@register("s10_x26_report_blocks", f"""
WITH s AS ({_REPORT_SQL})
SELECT post_id, chr(10) || 'Discussion: ' || title || chr(10) || repeat('=', length(title)) || chr(10) ||
  summary || chr(10) || chr(10) || 'Metrics:' || chr(10) ||
  'Total Comments: ' || total_comments || chr(10) || 'Positive Comments: ' || positive || chr(10) ||
  'Negative Comments: ' || negative || chr(10) || 'Neutral Comments: ' || neutral || chr(10) AS block
FROM s""")
def s10_x26_report_blocks(spark, sf):
    return S.report_lines(S.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf)))


@register("m11_summary_sentiment_data_lexicon", f"""
WITH s AS ({O.summary_sql(n=5, lexicon=DATA_LEXICON)}),
sc AS {G.lexicon_scores('s', 'post_id', 'summary', DATA_LEXICON)}
SELECT s.post_id,
  CASE WHEN round(sc.pol, 9) > 0 THEN 'positive' WHEN round(sc.pol, 9) < 0 THEN 'negative' ELSE 'neutral' END AS summary_label,
  round(abs(coalesce(sc.pol, 0.0)), 6) AS summary_score
FROM s LEFT JOIN sc USING (post_id)""")
def m11_summary_sentiment_data_lexicon(spark, sf):
    s = S.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf), lexicon=DATA_LEXICON)
    out = S.summary_sentiment(s, DATA_LEXICON)
    return out.withColumn("summary_score", F.round("summary_score", 6))


@register("w4_t1_x23_cluster_representatives", CTE_DATA + """,
lab2 AS (SELECT a.post_id, a.sid, a.sentence, a.sid % 2 AS cluster, coalesce(s.score, 0.0) AS score
         FROM aligned a LEFT JOIN scores s USING (post_id, sid)),
firsts AS (SELECT post_id, sentence, min(sid) AS first_idx FROM aligned GROUP BY post_id, sentence),
best AS (SELECT * FROM (
   SELECT l.*, f.first_idx, row_number() OVER (PARTITION BY l.post_id, l.cluster
                                               ORDER BY round(l.score, 9) DESC, l.sid) AS rk
   FROM lab2 l JOIN firsts f USING (post_id, sentence)) WHERE rk = 1)
SELECT post_id, '- ' || string_agg(sentence, chr(10) || '- ' ORDER BY first_idx, sid) AS summary
FROM best GROUP BY post_id""")
def w4_t1_x23_cluster_representatives(spark, sf):
    st = _steps(spark, sf, DATA_LEXICON)
    lab = st.aligned.select("post_id", "sid", "sentence", (F.col("sid") % 2).alias("cluster"))
    reps = S.cluster_representatives(lab, st.scores)
    from ..functions import text as X
    return (reps.groupBy("post_id")
            .agg(F.sort_array(F.collect_list(F.struct("first_idx", "sid", "sentence")))
                 .getField("sentence").alias("_s"))
            .select("post_id", X.bullets("_s").alias("summary")))




@register("x27_cluster_count", CTE + """
SELECT post_id, count(*) AS n_sentences, CAST(least(count(*), 5) AS BIGINT) AS k FROM aligned GROUP BY post_id""")
def x27_cluster_count(spark, sf):
    a = _steps(spark, sf).aligned
    return a.groupBy("post_id").agg(F.count("*").alias("n_sentences")).withColumn(
        "k", N.cluster_count("n_sentences").cast("long"))


# A lemma table derived from the data by a fixed rule: every token longer than
# three letters that ends in "s" maps to itself without the "s".
_LEMMA_RULE = "CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"


@register("x22_lemma_table_word_freq", O.summary_ctes(lemma_rule=_LEMMA_RULE) + "SELECT post_id, word, freq FROM freq")
def x22_lemma_table_word_freq(spark, sf):
    from ..functions import text as X
    c = conversation_comments(spark, sf)
    words = c.select(F.explode(X.tokenize("text")).alias("word")).distinct()
    lem = words.where((F.length("word") > 3) & F.col("word").endswith("s")).select(
        "word", F.expr("substring(word, 1, length(word) - 1)").alias("lemma"))
    st = S.summary_steps(conversation_posts(spark, sf), c, lemmas=lem)
    return st.freq.select("post_id", "word", F.col("freq").cast("long").alias("freq"))
