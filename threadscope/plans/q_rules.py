"""Keyword rules, enrichment and their distributions on ``documents``
(X1-X7, X13, F4, S7, A3-A5, J5, J6, J8, M4).

Only a few reference keywords occur in the driver's text, so every rule
query is registered twice: ``_default`` (reference dictionaries) and
``_data`` (dictionaries of tokens that do occur).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import keywords as K
from ..functions import text as X
from ..operators import enrich as EN
from ..operators import stats as ST
from ..session import read_table
from ..sources import posts_io as PIO
from ..sources.testdata import document_posts
from . import sqlgen as G
from .registry import register

# Parameters of our own: dictionaries built from tokens present in the data.
DATA_PLATFORM = {"en": ["the ", " and "], "fr": [" les ", " des "],
                 "de": [" der ", " und "], "es": [" los ", " las "]}
DATA_SEVERITY = {"critical": ["idiot", "scum"], "high": ["trash", "moron"],
                 "medium": ["tion"], "low": ["ung", "eau"]}
DATA_BUG = ["idiot", "tion", "ung", "eau", "clown", "tion"]
DATA_RESOLVED = ["best", "scum", "public"]

VARIANTS = {
    "default": dict(platform=rules.PLATFORM_KEYWORDS, severity=rules.SEVERITY_KEYWORDS,
                    bug=rules.BUG_KEYWORDS, resolved=rules.RESOLVED_KEYWORDS,
                    solution=rules.SOLUTION_KEYWORDS),
    "data": dict(platform=DATA_PLATFORM, severity=DATA_SEVERITY, bug=DATA_BUG,
                 resolved=DATA_RESOLVED, solution=DATA_RESOLVED),
}


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _reg_scalar(variant: str, v: dict):
    @register(f"x1_platform_{variant}",
              f"SELECT doc_id, {G.platform('text', v['platform'])} AS platforms FROM documents")
    def x1(spark, sf):
        return _docs(spark, sf).select(
            "doc_id", F.array_join(K.detect_platform("text", v["platform"]), ",").alias("platforms"))

    @register(f"x2_severity_{variant}",
              f"SELECT doc_id, {G.severity('text', v['severity'])} AS severity FROM documents")
    def x2(spark, sf):
        return _docs(spark, sf).select("doc_id", K.detect_severity("text", v["severity"]).alias("severity"))

    @register(f"x3_label_{variant}",
              f"SELECT doc_id, {G.label('text', v['bug'])} AS label FROM documents")
    def x3(spark, sf):
        return _docs(spark, sf).select("doc_id", K.label_post("text", v["bug"]).alias("label"))

    @register(f"x4_keywords_found_{variant}",
              f"SELECT doc_id, {G.keywords_found('text', v['bug'])} AS bug_keywords FROM documents")
    def x4(spark, sf):
        return _docs(spark, sf).select(
            "doc_id", F.array_join(K.keywords_found("text", v["bug"]), ",").alias("bug_keywords"))

    @register(f"x5_is_resolved_{variant}",
              f"SELECT doc_id, {G.has_any('text', v['resolved'])} AS is_resolved FROM documents")
    def x5(spark, sf):
        return _docs(spark, sf).select("doc_id", K.has_any("text", v["resolved"]).alias("is_resolved"))

    @register(f"x6_has_solution_{variant}",
              f"SELECT doc_id, {G.has_any('text', v['solution'])} AS has_solution FROM documents")
    def x6(spark, sf):
        return _docs(spark, sf).select("doc_id", K.has_any("text", v["solution"]).alias("has_solution"))


for _name, _v in VARIANTS.items():
    _reg_scalar(_name, _v)


@register("x7_x13_full_text",
          "SELECT doc_id, lower(' ' || coalesce(text, '')) AS full_lower, "
          "CAST(length(' ' || coalesce(text, '')) AS BIGINT) AS n_chars FROM documents")
def x7_x13_full_text(spark, sf):
    full = X.full_text(F.lit(""), F.col("text"))
    return _docs(spark, sf).select("doc_id", F.lower(full).alias("full_lower"),
                                   F.length(full).cast("long").alias("n_chars"))


def _enriched(spark, sf, v):
    return EN.enrich_posts(document_posts(spark, sf), lexicon=None, bug_keywords=v["bug"],
                           platform_keywords=v["platform"], severity_keywords=v["severity"])


def _full_sql():
    return "(' ' || coalesce(text, ''))"


def _enrich_sql(v) -> str:
    full = _full_sql()
    return f"""
SELECT d.doc_id AS post_id, '' AS title, d.text, {G.label(full, v['bug'])} AS label,
  d.n_chars AS score, CAST(NULL AS DOUBLE) AS upvote_ratio,
  CAST(len(string_split(coalesce(d.text, ''), chr(10))) - 1 AS BIGINT) AS num_comments,
  coalesce(d.lang, '[deleted]') AS author, d.source AS subreddit, CAST(NULL AS VARCHAR) AS timestamp,
  {G.severity(full, v['severity'])} AS severity,
  {G.has_any(full, rules.RESOLVED_KEYWORDS)} AS is_resolved,
  {G.platform(full, v['platform'])} AS platforms, '' AS potential_games,
  {G.keywords_found(full, v['bug'])} AS bug_keywords,
  round(coalesce(s.pol, 0.0), 6) AS sentiment_polarity,
  round(coalesce(s.subj, 0.0), 6) AS sentiment_subjectivity
FROM documents d LEFT JOIN {G.lexicon_scores('documents', 'doc_id', full)} s USING (doc_id)
"""


def _reg_enrich(variant: str, v: dict):
    @register(f"f4_s7_enrich_flatten_{variant}", _enrich_sql(v))
    def f4(spark, sf):
        flat = PIO.flatten_posts(_enriched(spark, sf, v))
        return flat.withColumn("sentiment_polarity", F.round("sentiment_polarity", 6)) \
                   .withColumn("sentiment_subjectivity", F.round("sentiment_subjectivity", 6)) \
                   .drop("created_ts")

    @register(f"a3_t2_platform_counts_{variant}", f"""
WITH e AS (SELECT doc_id, string_split({G.platform('text', v['platform'])}, ',') AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS platform, generate_subscripts(ps, 1) AS k FROM e),
g AS (SELECT platform, count(*) AS n, min(doc_id * 1000 + k) AS first_seen FROM x GROUP BY platform)
SELECT platform, n, CAST(row_number() OVER (ORDER BY n DESC, first_seen) AS INTEGER) AS rank FROM g""")
    def a3(spark, sf):
        posts = _docs(spark, sf).select(F.col("doc_id").alias("post_id"),
                                        K.detect_platform("text", v["platform"]).alias("platform"))
        return ST.platform_counts(posts)

    @register(f"a4_t2_severity_counts_{variant}", f"""
WITH e AS (SELECT doc_id, {G.severity('text', v['severity'])} AS severity FROM documents),
g AS (SELECT severity, count(*) AS n, min(doc_id) AS first_seen FROM e GROUP BY severity)
SELECT severity, n, CAST(row_number() OVER (ORDER BY n DESC, first_seen) AS INTEGER) AS rank FROM g""")
    def a4(spark, sf):
        posts = _docs(spark, sf).select(F.col("doc_id").alias("post_id"),
                                        K.detect_severity("text", v["severity"]).alias("severity"))
        return ST.severity_counts(posts)

    full = _full_sql()
    levels = ", ".join(f"({G.q(lv)}, {i})" for i, lv in enumerate(v["severity"]))

    @register(f"a5_j6_sentiment_by_severity_{variant}", f"""
WITH e AS (SELECT d.doc_id, {G.severity(full, v['severity'])} AS severity, coalesce(s.pol, 0.0) AS pol
           FROM documents d LEFT JOIN {G.lexicon_scores('documents', 'doc_id', full)} s USING (doc_id)),
a AS (SELECT severity, avg(pol) AS m FROM e GROUP BY severity),
dim AS (SELECT * FROM (VALUES {levels}) AS t(severity, ord))
SELECT dim.severity, round(coalesce(a.m, 0.0), 2) + 0.0 AS avg_polarity,
  upper(substr(dim.severity, 1, 1)) || lower(substr(dim.severity, 2)) || ': ' ||
  CASE WHEN coalesce(a.m, 0.0) < 0 AND round(coalesce(a.m, 0.0), 2) = 0 THEN '-0.00'
       ELSE printf('%.2f', round(coalesce(a.m, 0.0), 2) + 0.0) END AS display
FROM dim LEFT JOIN a USING (severity)""")
    def a5(spark, sf):
        return ST.sentiment_by_severity(_enriched(spark, sf, v), list(v["severity"]))


for _name, _v in VARIANTS.items():
    _reg_enrich(_name, _v)


def _dictionary_rows(v):
    rows = [("bug", "bug", k) for k in v["bug"]]
    rows += [("platform", p, k) for p, ks in v["platform"].items() for k in ks]
    rows += [("severity", s, k) for s, ks in v["severity"].items() for k in ks]
    return rows


def _reg_j5(variant: str, v: dict):
    vals = ", ".join(f"({G.q(a)}, {G.q(b)}, {G.q(c)})" for a, b, c in _dictionary_rows(v))
    sql = f"""
SELECT d.doc_id, k.rule_set, k.category, k.keyword
FROM documents d JOIN (VALUES {vals}) AS k(rule_set, category, keyword)
  ON contains(lower(coalesce(d.text, '')), k.keyword)"""
    for method in ("broadcast", "automaton", "index"):
        def make(method=method):
            def j5(spark, sf):
                dic = spark.createDataFrame(_dictionary_rows(v),
                                            "rule_set string, category string, keyword string")
                return EN.match_keywords(_docs(spark, sf), ["doc_id"], "text", dic,
                                         method=method).select("doc_id", "rule_set", "category", "keyword")
            return j5
        register(f"j5_keyword_join_{variant}_{method}", sql)(make())


for _name, _v in VARIANTS.items():
    _reg_j5(_name, _v)


@register("j8_m4_lexicon_sentiment", f"""
SELECT d.doc_id, round(coalesce(s.pol, 0.0), 6) AS polarity, round(coalesce(s.subj, 0.0), 6) AS subjectivity,
  CASE WHEN round(coalesce(s.pol, 0.0), 9) > 0 THEN 'positive' WHEN round(coalesce(s.pol, 0.0), 9) < 0 THEN 'negative'
       ELSE 'neutral' END AS label
FROM documents d LEFT JOIN {G.lexicon_scores('documents', 'doc_id', 'text')} s USING (doc_id)""")
def j8_m4_lexicon_sentiment(spark, sf):
    d = EN.lexicon_sentiment(_docs(spark, sf), "text", None, "s", ["doc_id"])
    return d.select("doc_id", F.round("s.polarity", 6).alias("polarity"),
                    F.round("s.subjectivity", 6).alias("subjectivity"),
                    EN.polarity_label(F.col("s.polarity")).alias("label"))


@register("j8_lexicon_join_table", f"""
SELECT d.doc_id, round(coalesce(s.pol, 0.0), 6) AS polarity, round(coalesce(s.subj, 0.0), 6) AS subjectivity
FROM documents d LEFT JOIN {G.lexicon_scores('documents', 'doc_id', 'text')} s USING (doc_id)""")
def j8_lexicon_join_table(spark, sf):
    # The large-lexicon path: tokens join a lexicon table (forced by a zero inline limit).
    lex = EN.lexicon_df(spark)
    d = EN.lexicon_sentiment(_docs(spark, sf), "text", lex, "s", ["doc_id"], inline_limit=0)
    return d.select("doc_id", F.round("s.polarity", 6).alias("polarity"),
                    F.round("s.subjectivity", 6).alias("subjectivity"))


