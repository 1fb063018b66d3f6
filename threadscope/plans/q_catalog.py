"""Titles, name matching and forum lists on ``pages``, ``nation``, ``region``
(S11, S13, W3, T3, T4, X8, J1, J10, F10, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X
from ..operators import enrich as EN
from ..operators import matching as M
from ..operators import sampling as SA
from ..session import read_table
from ..sources import files as FI
from . import sqlgen as G
from .registry import register

H1_SQL = "'<h1[^>]*>(.*?)</h1>'"
A_SQL = "'<a href=\"[^\"]*\">([^<]*)</a>'"


@register("s13_harvest_titles", f"""
SELECT page_id, CAST(k - 1 AS INTEGER) AS k, {G.strip('raw')} AS title FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {H1_SQL}, 1)) AS raw,
         generate_subscripts(regexp_extract_all(html, {H1_SQL}, 1), 1) AS k FROM pages)""")
def s13_harvest_titles(spark, sf):
    return FI.harvest_titles(read_table(spark, sf, "pages"))


_ANCHORS_SQL = f"""
(SELECT page_id, k, {G.strip('raw')} AS title FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {A_SQL}, 1)) AS raw,
         CAST(generate_subscripts(regexp_extract_all(html, {A_SQL}, 1), 1) - 1 AS INTEGER) AS k FROM pages))"""


def _anchors(spark, sf):
    return FI.harvest_titles(read_table(spark, sf, "pages"), FI.ANCHOR_PATTERN)


@register("w3_distinct_first_seen", f"""
SELECT title, arg_min(page_id, page_id * 100000 + k) AS first_page,
       arg_min(k, page_id * 100000 + k) AS first_k
FROM {_ANCHORS_SQL} a GROUP BY title""")
def w3_distinct_first_seen(spark, sf):
    d = SA.distinct_first_seen(_anchors(spark, sf), "title", ["page_id", "k"])
    return d.select("title", F.col("first_seen.page_id").alias("first_page"),
                    F.col("first_seen.k").alias("first_k"))


@register("t3_limit_first_titles", f"""
SELECT title, first_page, first_k FROM (
  SELECT title, arg_min(page_id, page_id * 100000 + k) AS first_page, arg_min(k, page_id * 100000 + k) AS first_k
  FROM {_ANCHORS_SQL} a GROUP BY title) ORDER BY first_page, first_k LIMIT 50""")
def t3_limit_first_titles(spark, sf):
    d = SA.limit_first(SA.distinct_first_seen(_anchors(spark, sf), "title", ["page_id", "k"]), 50)
    return d.select("title", F.col("first_seen.page_id").alias("first_page"),
                    F.col("first_seen.k").alias("first_k"))


@register("x8_normalize_title", f"""
SELECT page_id, lower(trim(regexp_replace(t, '[^a-zA-Z0-9 ]', '', 'g'))) AS normalized FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {H1_SQL}, 1)) AS t FROM pages)""")
def x8_normalize_title(spark, sf):
    t = FI.harvest_titles(read_table(spark, sf, "pages"))
    return t.select("page_id", X.normalize_title(F.col("title")).alias("normalized"))


# Titles to match: nation names with marks and spelling changes, plus region
# names that must miss.  Same rule on both sides.
_TITLES_SQL = """
(SELECT CAST(n_nationkey AS BIGINT) AS line_no,
   CASE n_nationkey % 3 WHEN 0 THEN n_name || '®'
                        WHEN 1 THEN replace(n_name, 'NATION', 'Natoin')
                        ELSE replace(n_name, 'NATION', 'naton') END AS title FROM nation
 UNION ALL SELECT CAST(1000 + r_regexkey AS BIGINT), r_name FROM (SELECT r_regionkey AS r_regexkey, r_name FROM region))"""


def _titles(spark, sf):
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    k = F.col("n_nationkey")
    t = (F.when(k % 3 == 0, F.concat("n_name", F.lit("®")))
         .when(k % 3 == 1, F.replace("n_name", F.lit("NATION"), F.lit("Natoin")))
         .otherwise(F.replace("n_name", F.lit("NATION"), F.lit("naton"))))
    return n.select(k.cast("long").alias("line_no"), t.alias("title")).unionByName(
        r.select((F.col("r_regionkey") + 1000).cast("long").alias("line_no"), F.col("r_name").alias("title")))


_MATCH_SQL = f"""
WITH t AS (SELECT line_no, title, lower(trim(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g'))) AS tn
           FROM {_TITLES_SQL}),
c AS (SELECT n_name AS name, lower(trim(regexp_replace(n_name, '[^a-zA-Z0-9 ]', '', 'g'))) AS cn FROM nation),
cand AS (SELECT t.line_no, c.name, levenshtein(t.tn, c.cn) AS d FROM t, c WHERE levenshtein(t.tn, c.cn) <= 2),
best AS (SELECT line_no, arg_min(name, d * 1000000 + 0) AS m0, min(d) AS d FROM cand GROUP BY line_no),
best2 AS (SELECT c.line_no, min(c.name) AS match, min(c.d) AS distance FROM cand c
          JOIN best b ON c.line_no = b.line_no AND c.d = b.d GROUP BY c.line_no)
SELECT t.line_no, t.title, b.match, CAST(b.distance AS INTEGER) AS distance
FROM t LEFT JOIN best2 b USING (line_no)"""


@register("j1_match_names", _MATCH_SQL)
def j1_match_names(spark, sf):
    cat = read_table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return M.match_names(_titles(spark, sf), cat, max_distance=2).select(
        "line_no", "title", "match", "distance")


#: Titles spelt by the part's key: with a mark, two letters changed places, a letter less, and three more.
_PART_TITLES_SQL = """
(SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN nm || '®' WHEN 1 THEN replace(nm, 'l', 'r') WHEN 2 THEN substr(nm, 2)
   ELSE nm || ' xy' END AS title, nm FROM (SELECT p_partkey, p_name || ' ' || p_partkey AS nm FROM part))"""


@register("j1_match_part_names", f"""
WITH t AS (SELECT part, title, lower(trim(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g'))) AS tn FROM {_PART_TITLES_SQL}),
c AS (SELECT nm AS name, lower(trim(regexp_replace(nm, '[^a-zA-Z0-9 ]', '', 'g'))) AS cn FROM {_PART_TITLES_SQL}),
cand AS (SELECT t.part, c.name, levenshtein(t.tn, c.cn) AS d FROM t JOIN c ON abs(len(t.tn) - len(c.cn)) <= 2
         WHERE levenshtein(t.tn, c.cn) <= 2),
best AS (SELECT part, min({{'d': d, 'name': name}}) AS b FROM cand GROUP BY part)
SELECT t.part, t.title, best.b.name AS match, CAST(best.b.d AS INTEGER) AS distance FROM t LEFT JOIN best USING (part)""")
def j1_match_part_names(spark, sf):
    """All parts by misspelt names: names and titles grow with the table."""
    name, key = F.concat_ws(" ", "p_name", "p_partkey"), F.col("p_partkey")
    title = (F.when(key % 4 == 0, F.concat(name, F.lit("®"))).when(key % 4 == 1, F.translate(name, "l", "r"))
             .when(key % 4 == 2, F.substr(name, F.lit(2))).otherwise(F.concat(name, F.lit(" xy"))))
    parts = read_table(spark, sf, "part").select(key.alias("part"), title.alias("title"), name.alias("name"))
    return M.match_names(parts.select("part", "title"), parts.select("name"), max_distance=2)


@register("s11_render_mapping", f"""
WITH m AS ({_MATCH_SQL})
SELECT line_no, CASE WHEN match IS NOT NULL THEN title || ': r/' || match
                     ELSE title || ': {rules.NO_FORUM}' END AS line FROM m""")
def s11_render_mapping(spark, sf):
    cat = read_table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    m = M.match_names(_titles(spark, sf), cat, max_distance=2)
    return m.select("line_no", M.render_mapping(m).alias("line"))


_LINES_SQL = f"""
(SELECT line_no, CASE WHEN match IS NOT NULL THEN title || ': r/' || match
                      ELSE title || ': {rules.NO_FORUM}' END AS line FROM ({_MATCH_SQL}))"""


@register("f10_extract_forums", f"""
SELECT line_no, {G.strip("string_split(line, 'r/')[-1]")} AS forum FROM {_LINES_SQL} l
WHERE contains(line, 'r/')""")
def f10_extract_forums(spark, sf):
    lines = s11_render_mapping(spark, sf)
    return M.extract_forums(lines).select("line_no", "forum")


@register("t4_first_forums", f"""
SELECT line_no, {G.strip("string_split(line, 'r/')[-1]")} AS forum FROM {_LINES_SQL} l
WHERE contains(line, 'r/') ORDER BY line_no LIMIT 10""")
def t4_first_forums(spark, sf):
    lines = s11_render_mapping(spark, sf)
    return M.extract_forums(lines).orderBy("line_no").limit(10).select("line_no", "forum")


@register("j10_existing_forums", """
WITH f AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation
           UNION ALL SELECT r_name FROM region UNION ALL SELECT 'nation_99')
SELECT name FROM f WHERE lower(name) IN (SELECT lower(n_name) FROM nation)""")
def j10_existing_forums(spark, sf):
    n = read_table(spark, sf, "nation")
    f = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
                 .alias("name")).unionByName(
        read_table(spark, sf, "region").select(F.col("r_name").alias("name"))).unionByName(
        spark.createDataFrame([("nation_99",)], "name string"))
    return EN.existing_forums(f, n.select(F.col("n_name").alias("name")))


#: Names with marks, digits and more than four words that occur in the tables, with their words.
MARKED_NAMES = [("The-and: attion to thanedble, THE anea!", ["the", "and", "attion", "to", "thanedble", "the", "anea"]),
                ("version 2.0", ["version", "2", "0"]), ("Apache License, Version 2.0", ["apache", "license", "version", "2", "0"]),
                ("Public License, version 3", ["public", "license", "version", "3"])]
_MARKED_SQL = ", ".join(f"('{n.lower()}', {w})" for n, w in MARKED_NAMES)


@register("m8_a13_entity_mentions", f"""
WITH gz AS (SELECT DISTINCT lower(title) AS name, {G.tokens('title', clean=False)} AS nt FROM {_ANCHORS_SQL} a
            WHERE title <> '' UNION SELECT * FROM (VALUES {_MARKED_SQL}) v(name, nt)),
t AS (SELECT doc_id, {G.tokens('text', clean=False)} AS tk FROM documents),
p AS (SELECT doc_id, tk, generate_subscripts(tk, 1) AS i FROM t),
g AS (SELECT DISTINCT doc_id, array_to_string(tk[i:i + n - 1], ' ') AS g
      FROM p, (SELECT DISTINCT len(nt) FROM gz WHERE len(nt) > 0) r(n) WHERE i + n - 1 <= len(tk))
SELECT doc_id, string_agg(DISTINCT gz.name, ',' ORDER BY gz.name) AS mentions
FROM g JOIN gz ON g.g = array_to_string(gz.nt, ' ') GROUP BY doc_id""")
def m8_a13_entity_mentions(spark, sf):
    marked = spark.createDataFrame([(n,) for n, _ in MARKED_NAMES], "name string")
    gz = _anchors(spark, sf).select(F.col("title").alias("name")).unionByName(marked)
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    m = M.entity_mentions(docs, "doc_id", "text", gz)
    return m.select("doc_id", F.array_join("mentions", ",").alias("mentions"))


#: Types of the marked names, and short names inside them that lose to the longer ones.
TYPED_NAMES = [(n, "WORK_OF_ART") for n, _ in MARKED_NAMES] + [
    ("Apache", "ORG"), ("Apache License", "PRODUCT"), ("License", "LAW"), ("2.0", "CARDINAL"), ("MIT License", "LAW")]
KEPT_TYPES = ("PRODUCT", "WORK_OF_ART")
_TYPED_SQL = ", ".join(f"('{n}', '{t}')" for n, t in TYPED_NAMES)


@register("m8_typed_mentions", f"""
WITH RECURSIVE b AS (SELECT {G.tokens('text', clean=False)} AS w FROM benchmark),
gz AS (SELECT name, type, {G.tokens('name', clean=False)} AS nt FROM (
  SELECT array_to_string(w[1:3], ' ') AS name, 'WORK_OF_ART' AS type FROM b WHERE len(w) > 0
  UNION SELECT array_to_string(w[3:4], ' '), 'PRODUCT' FROM b WHERE len(w) > 2
  UNION SELECT w[1], 'ORG' FROM b WHERE len(w) > 0
  UNION SELECT * FROM (VALUES {_TYPED_SQL}) v(name, type))),
t AS (SELECT doc_id, {G.tokens('text', clean=False)} AS tk FROM documents),
p AS (SELECT doc_id, tk, generate_subscripts(tk, 1) AS i FROM t),
s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CAST(max(n) AS INTEGER) AS n FROM p, (SELECT DISTINCT len(nt) AS n FROM gz) r
      WHERE array_to_string(tk[i:i + n - 1], ' ') IN (SELECT array_to_string(nt, ' ') FROM gz) AND i + n - 1 <= len(tk) GROUP BY ALL),
r AS (SELECT doc_id, min(i) AS i, arg_min(n, i) AS n FROM s GROUP BY doc_id
      UNION ALL SELECT s.doc_id, min(s.i), arg_min(s.n, s.i) FROM r JOIN s ON s.doc_id = r.doc_id AND s.i >= r.i + r.n GROUP BY s.doc_id)
SELECT r.doc_id, r.i AS place, r.n AS n_words, lower(gz.name) AS mention, gz.type
FROM r JOIN t USING (doc_id) JOIN (SELECT DISTINCT lower(name) AS name, type, nt FROM gz) gz
  ON array_to_string(gz.nt, ' ') = array_to_string(t.tk[r.i + 1:r.i + r.n], ' ')
WHERE gz.type IN ({G.str_list(KEPT_TYPES)})""")
def m8_typed_mentions(spark, sf):
    """Beginnings of the benchmark's passages and licence names, of several types and over one another."""
    w = read_table(spark, sf, "benchmark").select(X.tokenize("text", clean=False).alias("w")).where(F.size("w") > 0)
    gz = (w.select(F.array_join(F.slice("w", 1, 3), " ").alias("name"), F.lit("WORK_OF_ART").alias("type"))
          .unionByName(w.where(F.size("w") > 2).select(F.array_join(F.slice("w", 3, 2), " ").alias("name"), F.lit("PRODUCT").alias("type")))
          .unionByName(w.select(F.col("w")[0].alias("name"), F.lit("ORG").alias("type")))
          .unionByName(spark.createDataFrame(TYPED_NAMES, "name string, type string")))
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return M.typed_mentions(docs, "doc_id", "text", gz, KEPT_TYPES)
