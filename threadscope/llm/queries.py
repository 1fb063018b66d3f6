"""Registered queries of the training-data operators, one an operator.

Each applies its operator to the whole of its table and derives the contract's
columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_vocabulary() -> str:
    return vocabulary("piece_bpe_32k.model")


def register(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLES[fn.__name__] = sql
    return fn


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = bpe.encode(docs, vocabulary(), decoded_col="decoded")
    return done.select("doc_id", *bpe.digests(done))


register(op1_bpe_round_trip)


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


register(op2_quality_mcd)


def op3_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


URL_SQL = """
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(kind, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ruled AS (
  SELECT p.*, (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules r
               WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS rule,
         (SELECT arg_max(kind, length(rule_host || rule_path)) FROM rules r
               WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS rule_verdict
  FROM parts p),
urls AS (
  SELECT DISTINCT url, rule_verdict, md5(url)[1] IN ('c', 'd', 'e', 'f') AS held,
         regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                        '[^a-z0./-]', '_', 'g') AS s FROM ruled WHERE url IS NOT NULL),
grams AS (
  SELECT url, rule_verdict, held, substr('^^' || s, i, 3) AS gram
  FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM urls)),
counts AS (
  SELECT gram, k.kind, count(*) FILTER (WHERE rule_verdict = k.kind AND NOT held) AS n
  FROM grams, (VALUES ('block'), ('allow')) k(kind) GROUP BY gram, k.kind),
o0 AS (SELECT kind, gram[3] AS c, sum(n) AS n FROM counts GROUP BY ALL),
p0 AS (SELECT kind, c, (n + 1) / (sum(n) OVER (PARTITION BY kind) + 32) AS p FROM o0),
o1 AS (SELECT kind, gram[2:3] AS bc, sum(n) AS n FROM counts GROUP BY ALL),
x1 AS (SELECT *, sum(n) OVER (PARTITION BY kind, bc[1]) AS m, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY kind, bc[1]) AS t FROM o1),
p1 AS (SELECT x1.kind, bc, CASE WHEN m > 0 THEN (x1.n + t * p0.p) / (m + t) ELSE p0.p END AS p
       FROM x1 JOIN p0 ON p0.kind = x1.kind AND p0.c = bc[2]),
x2 AS (SELECT *, sum(n) OVER (PARTITION BY kind, gram[1:2]) AS m, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY kind, gram[1:2]) AS t FROM counts),
p2 AS (SELECT x2.kind, gram, CASE WHEN m > 0 THEN (x2.n + t * p1.p) / (m + t) ELSE p1.p END AS p
       FROM x2 JOIN p1 ON p1.kind = x2.kind AND p1.bc = gram[2:3]),
ratios AS (SELECT b.gram, ln(b.p) - ln(a.p) AS ratio FROM p2 b JOIN p2 a USING (gram) WHERE b.kind = 'block' AND a.kind = 'allow'),
scores AS (SELECT url, rule_verdict, held, round(avg(ratio), 6) AS score FROM grams JOIN ratios USING (gram) GROUP BY ALL),
bins AS (
  SELECT floor(score / 0.01) AS bin, count(*) FILTER (WHERE rule_verdict = 'block') AS block, count(*) FILTER (WHERE rule_verdict = 'allow') AS allow
  FROM scores WHERE held AND rule_verdict IS NOT NULL GROUP BY 1),
cuts AS (
  SELECT bin, coalesce(sum(block) OVER w, 0) AS block_below, coalesce(sum(allow) OVER w, 0) AS allow_below,
         lag(bin) OVER (ORDER BY bin) AS last, sum(block) OVER () AS all_block, sum(allow) OVER () AS all_allow
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT (bin + coalesce(last + 1, bin)) / 2 * 0.01 AS cut FROM cuts WHERE all_block > 0 AND all_allow > 0
  ORDER BY round(allow_below / all_allow - block_below / all_block, 9) DESC, bin LIMIT 1)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.rule_verdict, CASE WHEN s.score >= (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN (SELECT DISTINCT url, score FROM scores) s USING (url)
"""

register(op3_url_markov_ratio, URL_SQL)


def op4_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


register(op4_pack_cutting_stock)


def op5_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


register(op5_substring_fm_index)


def op6_html_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract
    done = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


register(op6_html_boosted_trees)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Equal lines of any length; and of lines of eight words on the earliest line of each one-word gap, by the words
#: themselves: (words with the gap) pairs two lines that differ in this word, (words without it) a line and one with a word more.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, l.i AS line_no, l.x AS line,
         list_filter(regexp_split_to_array(l.x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'x': x, 'i': i})) AS l FROM documents WHERE text IS NOT NULL)),
some_lines AS (SELECT doc_id, line_no, array_to_string(words, ' ') AS whole, words, (doc_id, line_no) AS pos FROM lines WHERE len(words) > 0),
all_distinct AS (SELECT whole, any_value(words) AS words, min(pos) AS pos FROM some_lines GROUP BY whole),
distinct_lines AS (SELECT * FROM all_distinct WHERE len(words) >= 8),
variants AS (
  SELECT whole, pos, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS rest
  FROM (SELECT whole, words, pos, unnest(range(1, len(words) + 1)) AS i FROM distinct_lines)),
same_gap AS (SELECT v.whole FROM variants v JOIN (SELECT rest, i, min(pos) AS first FROM variants GROUP BY rest, i) f USING (rest, i) WHERE f.first < v.pos),
one_less AS (SELECT v.whole FROM variants v JOIN distinct_lines d ON d.whole = v.rest WHERE d.pos < v.pos),
one_more AS (SELECT d.whole FROM variants v JOIN distinct_lines d ON d.whole = v.rest WHERE v.pos < d.pos),
near AS (SELECT * FROM same_gap UNION SELECT * FROM one_less UNION SELECT * FROM one_more),
gone AS (
  SELECT l.doc_id, l.line_no FROM some_lines l JOIN all_distinct d USING (whole)
  WHERE d.pos <> l.pos OR l.whole IN (SELECT whole FROM near)),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
         string_agg(CASE WHEN g.line_no IS NULL THEN l.line END, chr(10) ORDER BY l.line_no) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

register(op7_line_dedup, LINE_DEDUP_SQL)


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import multi_index
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


register(op8_inverted_multi_index)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as S
    found = S.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*S.BASE))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in S.BASE],
                        F.sha2(S.span_text(base), 256).alias("base_sha256"), S.span_text(spans).alias("spans"))


register(op9_secret_scan)


def op10_minhash_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


register(op10_minhash_fast_sketch)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.prove(docs, merkle.without_line_breaks()).select("doc_id", *merkle.ADDED)


#: Heads: the first node of each level of a tree is at lvl 0; trees are the sources and, last, the tree over them.
MERKLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
             lambda x, one: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS c
  FROM documents WHERE doc_id IS NOT NULL),
texts AS (
  SELECT d.*, CASE WHEN xor(crc.c, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents d LEFT JOIN crc USING (doc_id)),
heads AS (
  SELECT doc_id, source, text, tampered, list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
           lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v)::VARCHAR || ':' || v END), 'string_agg', '') AS head FROM texts),
digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(tampered)::VARCHAR || ':' || tampered, '-')) AS start FROM heads),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM digests),
low AS (
  SELECT tree, 0 AS lvl, pos, leaf AS hash, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
high AS (
  SELECT 0 AS lvl, tree AS pos, hash, (SELECT count(DISTINCT tree) FROM leaves) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
path(tree, leaf_pos, lvl, pos, start, fold, sibs) AS (
  SELECT tree, pos, 0, pos, start, start, '' FROM leaves
  UNION ALL
  SELECT p.tree, p.leaf_pos, p.lvl + 1, p.pos // 3, p.start,
         sha256(string_agg(CASE WHEN l.pos = p.pos THEN p.fold ELSE l.hash END, '' ORDER BY l.pos)),
         p.sibs || coalesce(string_agg(l.hash, '' ORDER BY l.pos) FILTER (WHERE l.pos <> p.pos), '')
  FROM path p JOIN low l ON l.tree = p.tree AND l.lvl = p.lvl AND l.pos // 3 = p.pos // 3 AND l.n > 1
  GROUP BY p.tree, p.leaf_pos, p.lvl, p.pos, p.start, p.fold, p.sibs),
subroots AS (SELECT * FROM path p WHERE p.lvl = (SELECT max(lvl) FROM low l WHERE l.tree = p.tree)),
path_up(tree, leaf_pos, lvl, pos, fold, sibs) AS (
  SELECT tree, leaf_pos, 0, tree, fold, sibs FROM subroots
  UNION ALL
  SELECT p.tree, p.leaf_pos, p.lvl + 1, p.pos // 3,
         sha256(string_agg(CASE WHEN l.pos = p.pos THEN p.fold ELSE l.hash END, '' ORDER BY l.pos)),
         p.sibs || coalesce(string_agg(l.hash, '' ORDER BY l.pos) FILTER (WHERE l.pos <> p.pos), '')
  FROM path_up p JOIN high l ON l.lvl = p.lvl AND l.pos // 3 = p.pos // 3 AND l.n > 1
  GROUP BY p.tree, p.leaf_pos, p.lvl, p.pos, p.fold, p.sibs)
SELECT d.doc_id, d.leaf, s.hash AS subroot, r.hash AS root, sha256(u.sibs) AS proof_sha256, u.fold AS folded_root, u.fold = r.hash AS verified
FROM leaves d JOIN low s ON s.tree = d.tree AND s.n = 1 CROSS JOIN (SELECT hash FROM high WHERE n = 1) r
JOIN path_up u ON u.tree = d.tree AND u.leaf_pos = d.pos AND u.lvl = (SELECT max(lvl) FROM high)
"""

register(op13_merkle_manifest, MERKLE_SQL)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import alignment
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignment(docs, vocabulary, piece_vocabulary).select(
        F.col("doc_id").cast("long").alias("doc_id"), *alignment.COUNTS, "groups_sha256")


register(op12_tokenizer_alignment)


def op11_toxic_spans_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    chain = toxicity.fit(docs, labels, F.col("doc_id").isNotNull() & ~held_out)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxicity.tag(docs, chain).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))


register(op11_toxic_spans_crf)
