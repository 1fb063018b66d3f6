"""Windows, votes and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import embeddings as EM
from ..operators import enrich as EN
from ..operators import models as MO
from ..operators import sampling as SA
from ..operators import softmax as SM
from ..operators import summary as SU
from ..session import read_table
from ..sources.testdata import conversation_comments, conversation_posts
from . import oracle_summary as O
from . import sqlgen as G
from .q_eval import _TRAINING_SQL, _training
from .registry import register


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


@register("x19_x10_token_windows", f"""
SELECT doc_id, w, CAST(len(chunk) AS INTEGER) AS n_tokens, array_to_string(chunk, ' ') AS window_text
FROM {G.windows_sql('documents', 'doc_id', 'text', 64, 32)}""")
def x19_x10_token_windows(spark, sf):
    w = MO.windows(_docs(spark, sf), ["doc_id"], "text", 64, 32)
    return w.select("doc_id", F.col("w").cast("int").alias("w"), F.size("chunk").cast("int").alias("n_tokens"),
                    F.array_join("chunk", " ").alias("window_text"))


@register("x18_x17_softmax_argmax", f"""
SELECT doc_id, w, round(list_max(list_transform(logits, lambda v: exp(v - list_max(logits)))) /
         list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))), 6) AS p_max,
       CAST({G.argmax_polarity_sql('logits')} + 1 AS INTEGER) AS cls,
       CAST({G.argmax_polarity_sql('logits')} AS INTEGER) AS polarity
FROM {G.lexicon_logits_sql(G.windows_sql('documents', 'doc_id', 'text', 64, 32))}""")
def x18_x17_softmax_argmax(spark, sf):
    w = MO.lexicon_logits(MO.windows(_docs(spark, sf), ["doc_id"], "text", 64, 32), "chunk")
    sm = N.softmax("logits")
    cls = N.argmax(sm)
    return w.select("doc_id", F.col("w").cast("int").alias("w"), F.round(F.array_max(sm), 6).alias("p_max"),
                    cls.alias("cls"), N.label_to_polarity(cls).alias("polarity"))


@register("a12_vote_conversations",
          f"SELECT conv_id, turn, polarity FROM {G.vote_sql('conversations', 'conv_id, turn', 'text', 16, 8)}")
def a12_vote_conversations(spark, sf):
    c = read_table(spark, sf, "conversations")
    return MO.predict_polarity(c, ["conv_id", "turn"], "text", size=16, overlap=8)


@register("m7_predict_polarity",
          f"SELECT doc_id, polarity FROM {G.vote_sql('documents', 'doc_id', 'text', 64, 32)}")
def m7_predict_polarity(spark, sf):
    return MO.predict_polarity(_docs(spark, sf), ["doc_id"], "text", size=64, overlap=32)


_F7_SQL = f"""
WITH posts AS (SELECT conv_id AS post_id, text AS title,
                 CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 0.0 END AS pol FROM conversations WHERE turn = 0),
com AS (SELECT conv_id AS post_id, turn - 1 AS pos, text,
               CASE WHEN turn % 4 = 0 THEN NULL ELSE 0.0 END AS pol FROM conversations WHERE turn > 0),
pp AS {G.vote_sql('posts', 'post_id', 'title', 16, 8)},
cp AS {G.vote_sql('com', 'post_id, pos', 'text', 16, 8)}
SELECT p.post_id, CAST(-1 AS INTEGER) AS pos,
       CASE WHEN p.title IS NOT NULL AND p.pol IS NOT NULL AND pp.polarity IS NOT NULL
            THEN CAST(pp.polarity AS DOUBLE) ELSE p.pol END AS polarity
FROM posts p LEFT JOIN pp USING (post_id)
UNION ALL
SELECT c.post_id, CAST(c.pos AS INTEGER), CASE WHEN c.text IS NOT NULL AND c.pol IS NOT NULL AND cp.polarity IS NOT NULL
            THEN CAST(cp.polarity AS DOUBLE) ELSE c.pol END
FROM com c LEFT JOIN cp USING (post_id, pos)"""


@register("f7_apply_predictions", _F7_SQL)
def f7_apply_predictions(spark, sf):
    posts = conversation_posts(spark, sf).withColumn(
        "sentiment", F.when(F.col("post_id") % 5 == 0, F.lit(None))
        .otherwise(F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"))))
    com = conversation_comments(spark, sf).withColumn(
        "sentiment", F.when((F.col("pos") + 1) % 4 == 0, F.lit(None))
        .otherwise(F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"))))
    pp = MO.predict_polarity(posts, ["post_id"], "title", size=16, overlap=8)
    cp = MO.predict_polarity(com, ["post_id", "pos", "comment_id"], "text", size=16, overlap=8)
    p2, c2 = MO.apply_predictions(posts, com, pp, cp)
    return p2.select("post_id", F.lit(-1).cast("int").alias("pos"), F.col("sentiment.polarity").alias("polarity")) \
        .unionByName(c2.select("post_id", F.col("pos").cast("int"), F.col("sentiment.polarity").alias("polarity")))


# ---- fitted models --------------------------------------------------------

def _features_sql(src: str, keys: str, tokens: str, features: int = 1 << 10) -> str:
    """(keys, i, v): hashed token counts of each row over their length, and the bias (i = -1)."""
    return f"""SELECT {keys}, -1 AS i, 1.0::DOUBLE AS v FROM {src} UNION ALL
  SELECT {keys}, i, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY {keys}) AS DOUBLE)) FROM (
    SELECT {keys}, i, count(*) AS n FROM (SELECT {keys}, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {features} AS INTEGER) AS i
      FROM (SELECT {keys}, unnest({tokens}) AS w FROM {src})) GROUP BY ALL)"""


def _softmax_ctes(rows: str, epochs: int, rate: float = 1.5, reg: float = 1e-4, features: int = 1 << 10) -> str:
    """Full-batch gradient steps of the softmax classifier as a recursive query: ``fit`` (epoch, i, c, w; i = -1: bias)."""
    return f"""
x AS (SELECT row_number() OVER () AS r, text, label FROM {rows}),
xt AS (SELECT r, label, {G.tokens('text', clean=False)} AS t FROM x),
feat AS ({_features_sql('xt', 'r, label', 't', features)}),
fit(epoch, i, c, w) AS (
  SELECT 0, i, c, CAST(0 AS DOUBLE) FROM range(-1, {features}) t(i), range(3) u(c)
  UNION ALL
  SELECT o.epoch + 1, o.i, o.c, o.w - {rate} * (coalesce(g.g, 0) / (SELECT count(*) FROM x) + CASE WHEN o.i >= 0 THEN {reg} * o.w ELSE 0 END)
  FROM fit o LEFT JOIN (
    SELECT f.i, p.c, sum(f.v * (p.p - CASE WHEN f.label = p.c THEN 1 ELSE 0 END)) AS g FROM feat f JOIN (
      SELECT r, c, exp(z - max(z) OVER (PARTITION BY r)) / sum(exp(z)) OVER (PARTITION BY r) * exp(max(z) OVER (PARTITION BY r)) AS p FROM (
        SELECT f.r, w.c, sum(f.v * w.w) AS z FROM feat f JOIN fit w ON w.i = f.i GROUP BY f.r, w.c)) p USING (r)
    GROUP BY f.i, p.c) g ON g.i = o.i AND g.c = o.c
  WHERE o.epoch < {epochs})"""


_SPLIT_SQL = """
rk AS (SELECT text, label, row_number() OVER (ORDER BY md5('42#' || kind || '#' || CAST(post_id AS VARCHAR)
        || '#' || CAST(pos AS VARCHAR))) AS rk, count(*) OVER () AS n FROM tr)"""


@register("m6_e2_train_sentiment", f"""
WITH RECURSIVE {_TRAINING_SQL}, {_SPLIT_SQL},
{_softmax_ctes('(SELECT * FROM rk WHERE rk > ceil(0.2 * n))', 10)},
test AS (SELECT row_number() OVER () AS r, label, {G.tokens('text', clean=False)} AS t FROM rk WHERE rk <= ceil(0.2 * n)),
tf AS ({_features_sql('test', 'r, label', 't')}),
pairs AS (SELECT epoch, label AS actual, arg_max(c, z) AS predicted FROM (
  SELECT f.r, f.label, w.epoch, w.c, round(sum(f.v * w.w), 12) - w.c * 1e-13 AS z FROM tf f JOIN fit w ON w.i = f.i WHERE w.epoch > 0
  GROUP BY f.r, f.label, w.epoch, w.c) GROUP BY epoch, r, label),
cls AS (SELECT epoch, c, count(*) FILTER (WHERE actual = c AND predicted = c) AS tp, count(*) FILTER (WHERE actual = c) AS support,
          count(*) FILTER (WHERE predicted = c) AS npred FROM pairs, range(3) t(c) GROUP BY epoch, c),
pr AS (SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM cls)
SELECT CAST(epoch AS INTEGER) AS epoch, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(r * support) / sum(support), 6) AS recall,
  round(sum(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * support) / sum(support), 6) AS f1
FROM pr GROUP BY epoch""")
def m6_e2_train_sentiment(spark, sf):
    """Softmax regression on four fifths of the labelled texts; weighted metrics of the rest after each of ten epochs."""
    t = SA.train_test_split(_training(spark, sf), ["kind", "post_id", "pos"], 0.2, 42).checkpoint()
    model = SM.train(t.where(F.col("split") == "train"), epochs=10, tol=0.0)
    metrics = SM.evaluate_epochs(model, t.where(F.col("split") == "test"))
    return metrics.select("epoch", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("m7_predict_polarity_trained_model", f"""
WITH RECURSIVE {_TRAINING_SQL}, {_softmax_ctes('tr', 5)},
win AS (SELECT row_number() OVER () AS r, doc_id, chunk FROM {G.windows_sql('documents', 'doc_id', 'text', 64, 32)}),
wf AS ({_features_sql('win', 'r, doc_id', 'chunk')}),
voted AS (SELECT doc_id, r, arg_max(c, z) - 1 AS polarity FROM (
  SELECT f.doc_id, f.r, w.c, round(sum(f.v * w.w), 12) - w.c * 1e-13 AS z FROM wf f JOIN fit w ON w.i = f.i WHERE w.epoch = 5
  GROUP BY f.doc_id, f.r, w.c) GROUP BY doc_id, r)
SELECT doc_id, CAST(round_even(avg(polarity), 0) AS INTEGER) AS polarity FROM voted GROUP BY doc_id""")
def m7_predict_polarity_trained_model(spark, sf):
    model = SM.train(_training(spark, sf), epochs=5, tol=0.0)
    return MO.predict_polarity(_docs(spark, sf), ["doc_id"], "text", scorer=model.scorer(), size=64, overlap=32)


@register("m5_trained_comment_labels", f"""
WITH RECURSIVE {_TRAINING_SQL}, {_softmax_ctes('tr', 5)},
com AS (SELECT conv_id AS post_id, CAST(turn - 1 AS INTEGER) AS pos, text, {G.tokens('text', clean=False)} AS t FROM conversations WHERE turn > 0),
cf AS ({_features_sql('com', 'post_id, pos', 't')}),
z AS (SELECT f.post_id, f.pos, w.c, round(sum(f.v * w.w), 12) AS z FROM cf f JOIN fit w ON w.i = f.i WHERE w.epoch = 5 GROUP BY ALL),
best AS (SELECT post_id, pos, arg_max(c, z - c * 1e-13) AS c, exp(max(z)) / sum(exp(z)) AS p FROM z GROUP BY post_id, pos)
SELECT post_id, pos, CASE WHEN com.text IS NULL THEN 'neutral' ELSE ['negative', 'neutral', 'positive'][c + 1] END AS label,
  CASE WHEN com.text IS NULL THEN 0.0 ELSE round(p, 6) END AS score FROM com JOIN best USING (post_id, pos)""")
def m5_trained_comment_labels(spark, sf):
    """Every comment by the softmax classifier (five epochs over all labelled texts)."""
    model = SM.train(_training(spark, sf), epochs=5, tol=0.0)
    c = conversation_comments(spark, sf).select("post_id", "pos", "text")
    d = EN.label_sentiment(c, "text", out="s", scorer=model.scorer())
    return d.select("post_id", "pos", F.col("s.label").alias("label"), F.round("s.score", 6).alias("score"))


def _aligned(spark, sf):
    return SU.summary_steps(conversation_posts(spark, sf), conversation_comments(spark, sf)).aligned


@register("m1_word2vec_vocabulary", O.summary_ctes() + f"""
SELECT DISTINCT w AS word, 100 AS dim FROM (SELECT unnest({G.tokens('sentence')}) AS w FROM aligned)
WHERE w NOT IN ({G.stop_words_list()})""")
def m1_word2vec_vocabulary(spark, sf):
    """M1: the fitted model's vocabulary (min_count=1: every token of the
    aligned sentences) and its vector size."""
    a = _aligned(spark, sf)
    toks = a.select(MO.sentence_tokens(a, "sentence").alias("tokens"))
    model = MO.fit_word2vec(toks, "tokens")
    return model.getVectors().select("word", F.lit(model.getVectorSize()).alias("dim"))


def _vector_ctes() -> str:
    """Random indexing over the aligned sentences: ``vecs`` (post_id, sid, v: 100 doubles)."""
    return O.summary_ctes() + f""",
tk AS (SELECT post_id, sid, sentence, list_filter({G.tokens('sentence')}, lambda w: w NOT IN ({G.stop_words_list()})) AS t FROM aligned),
occ AS (SELECT post_id, sid, unnest(t) AS w, generate_subscripts(t, 1) AS i, len(t) AS n FROM tk),
near AS (SELECT a.w, b.w AS o, count(*) AS n FROM occ a JOIN occ b ON a.post_id = b.post_id AND a.sid = b.sid
         AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY a.w, b.w),
ent AS (SELECT o, ('0x' || substr(md5(o), 8 * j + 1, 8))::BIGINT AS e FROM (SELECT DISTINCT o FROM near), range(4) t(j)),
sums AS (SELECT w, e % 100 AS d, sum(n * CASE WHEN (e // 100) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM near JOIN ent USING (o) GROUP BY 1, 2),
unit AS (SELECT w, d, floor(x * 1000000.0::DOUBLE / sqrt(CAST(sum(x * x) OVER (PARTITION BY w) AS DOUBLE)) + 0.5) AS q FROM sums
         QUALIFY sum(x * x) OVER (PARTITION BY w) > 0),
sv AS (SELECT post_id, sid, d, sum(q) / (any_value(n) * 1000000.0::DOUBLE) AS x FROM occ JOIN unit USING (w) GROUP BY post_id, sid, d),
vecs AS (SELECT post_id, sid, sentence, list(coalesce(x, 0.0::DOUBLE) ORDER BY d) AS v
         FROM (SELECT post_id, sid, sentence, unnest(range(100)) AS d FROM tk) LEFT JOIN sv USING (post_id, sid, d) GROUP BY post_id, sid, sentence)"""


@register("a11_m2_sentence_vectors", _vector_ctes() + """
SELECT post_id, sid, CAST(len(v) AS INTEGER) AS dim, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
       round(list_sum(list_transform(v, lambda x, i: x * i)) + 1e-9, 6) AS moment FROM vecs""")
def a11_m2_sentence_vectors(spark, sf):
    a = _aligned(spark, sf)
    toks = a.select("post_id", "sid", MO.sentence_tokens(a, "sentence").alias("tokens")).checkpoint()
    v = EM.sentence_vectors(toks, ["post_id", "sid"])
    return v.select("post_id", "sid", F.size("vector").alias("dim"),
                    F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"),
                    F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x) + 1e-9, 6).alias("moment"))


def _lloyd_ctes(points: str, iters: int = 30, k: int = 5, seed: int = 42) -> str:
    """Lloyd's iterations over ``points`` (g, id, v) as a recursive query: ``labels`` (g, id, cl)."""
    nearest = """(SELECT g, id, v, cl FROM (SELECT p.g, p.id, p.v, c.cl, row_number() OVER (PARTITION BY p.g, p.id ORDER BY
      list_sum(list_transform(list_zip(p.v, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.cl) AS rk
      FROM pts p JOIN {cents} c ON p.g = c.g) WHERE rk = 1)"""
    return f"""
pts AS (SELECT g, id, v FROM {points}),
lloyd(it, g, cl, c) AS (
  SELECT 0, g, cl, v FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY md5('{seed}#' || CAST(id AS VARCHAR)), id) - 1 AS cl FROM pts)
  WHERE cl < {k}
  UNION ALL
  SELECT o.it + 1, o.g, o.cl, coalesce(m.c, o.c) FROM lloyd o LEFT JOIN (
    SELECT g, cl, list(x ORDER BY d) AS c FROM (SELECT g, cl, d, avg(x) AS x FROM (
      SELECT g, cl, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {nearest.format(cents='lloyd')}) GROUP BY g, cl, d) GROUP BY g, cl) m
    ON m.g = o.g AND m.cl = o.cl WHERE o.it < {iters}),
labels AS (SELECT g, id, cl FROM {nearest.format(cents=f'(SELECT * FROM lloyd WHERE it = {iters})')})"""


_SENTENCE_CLUSTERS = _vector_ctes().replace("WITH ", "WITH RECURSIVE ", 1) + "," + _lloyd_ctes("(SELECT post_id AS g, sid AS id, v FROM vecs)")


@register("m3_kmeans_sentences", _SENTENCE_CLUSTERS + " SELECT g AS post_id, id AS sid, CAST(cl AS INTEGER) AS cluster FROM labels")
def m3_kmeans_sentences(spark, sf):
    return MO.cluster_sentences(_aligned(spark, sf)).select("post_id", "sid", "cluster")


def _kmeans_sql(iters: int = 10, k: int = 5, seed: int = 42) -> str:
    """Lloyd's iterations unrolled as CTEs (same seeded init, nearest centroid
    with ties to the lower label, empty clusters keep their centroid)."""
    dist = "list_sum(list_transform(list_zip(p.v, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    parts = [f"""pts AS (SELECT label AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c0 AS (SELECT g, cl, v AS c FROM (
  SELECT g, id, v, row_number() OVER (PARTITION BY g ORDER BY md5('{seed}#' || CAST(id AS VARCHAR)), id) - 1 AS cl
  FROM pts) WHERE cl < {k})"""]

    def assign(i):
        return f"""a{i} AS (SELECT g, id, v, cl FROM (
  SELECT p.g, p.id, p.v, c.cl, row_number() OVER (PARTITION BY p.g, p.id ORDER BY {dist}, c.cl) AS rk
  FROM pts p JOIN c{i - 1} c ON p.g = c.g) WHERE rk = 1)"""
    for i in range(1, iters + 1):
        parts.append(assign(i))
        parts.append(f"""m{i} AS (SELECT g, cl, list(av ORDER BY d) AS c FROM (
  SELECT g, cl, d, avg(x) AS av FROM (SELECT g, cl, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i})
  GROUP BY g, cl, d) GROUP BY g, cl),
c{i} AS (SELECT o.g, o.cl, coalesce(m.c, o.c) AS c FROM c{i - 1} o LEFT JOIN m{i} m ON o.g = m.g AND o.cl = m.cl)""")
    parts.append(assign(iters + 1))
    return "WITH " + ",\n".join(parts) + f"\nSELECT g AS label, id AS vec_id, CAST(cl AS INTEGER) AS cluster FROM a{iters + 1}"


@register("m3_kmeans_embeddings", _kmeans_sql())
def m3_kmeans_embeddings(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return MO.kmeans_per_group(e, "label", "vec_id", "embedding", k_max=5, max_iter=10)


@register("m3_kmeans_one_group", "WITH RECURSIVE " + _lloyd_ctes("(SELECT 0 AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", 20)
          + " SELECT id AS vec_id, CAST(cl AS INTEGER) AS cluster FROM labels")
def m3_kmeans_one_group(spark, sf):
    """All points in one group (20 iterations at most): it is spread by salts, whatever its size."""
    e = read_table(spark, sf, "embeddings").withColumn("all", F.lit(0))
    return MO.kmeans_per_group(e, "all", "vec_id", "embedding", k_max=5, max_iter=20).select("vec_id", "cluster")


@register("m9_summary_kmeans", _SENTENCE_CLUSTERS + f""",
firsts AS (SELECT post_id, sentence, min(sid) AS first_idx FROM aligned GROUP BY post_id, sentence),
best AS (SELECT a.post_id, a.sid, a.sentence, f.first_idx, row_number() OVER (PARTITION BY a.post_id, l.cl
           ORDER BY round(coalesce(s.score, 0.0), 9) DESC, a.sid) AS rk
         FROM aligned a JOIN labels l ON l.g = a.post_id AND l.id = a.sid JOIN firsts f ON f.post_id = a.post_id AND f.sentence = a.sentence
         LEFT JOIN scores s ON s.post_id = a.post_id AND s.sid = a.sid),
summ AS (SELECT post_id, '- ' || string_agg(sentence, chr(10) || '- ' ORDER BY first_idx, sid) AS s FROM best WHERE rk = 1 GROUP BY post_id)
{O.FINAL_SELECT}""")
def m9_summary_kmeans(spark, sf):
    return SU.summarize(conversation_posts(spark, sf), conversation_comments(spark, sf), cluster="kmeans")


def _word_count_network():
    """Stand-in for a caller's network: logits [0, 1, #words] per window."""
    import numpy as np

    def predict(texts):
        n = np.array([len(str(t).split()) for t in texts], dtype=np.float32)
        return np.stack([np.zeros_like(n), np.ones_like(n), n], axis=1)
    return predict


@register("m7_predict_batch_udf_scorer", f"""
SELECT doc_id, CAST(round_even(avg(CASE WHEN len(chunk) > 1 THEN 1 ELSE 0 END), 0) AS INTEGER) AS polarity
FROM {G.windows_sql('documents', 'doc_id', 'text', 64, 32)} GROUP BY doc_id""")
def m7_predict_batch_udf_scorer(spark, sf):
    """M7 through ``predict_batch_udf`` (the path for a caller's own model)."""
    return MO.predict_polarity(_docs(spark, sf), ["doc_id"], "text",
                               scorer=MO.batch_scorer(_word_count_network), size=64, overlap=32)


@register("a11_zero_vector_rule", O.summary_ctes() + f"""
SELECT post_id, sid, 100 AS dim,
       len(list_filter({G.tokens('sentence')}, lambda w: w NOT IN ({G.stop_words_list()}))) = 0 AS zero_vector
FROM aligned""")
def a11_zero_vector_rule(spark, sf):
    """Every sentence gets a vector of the model's size; a sentence with
    no known word gets the zero vector (shape and zero rule checked exactly,
    the values themselves by ``a11_m2_sentence_vectors``)."""
    a = _aligned(spark, sf)
    toks = a.select("post_id", "sid", MO.sentence_tokens(a, "sentence").alias("tokens"))
    model = MO.fit_word2vec(toks, "tokens")
    v = MO.sentence_vectors(toks, ["post_id", "sid"], "tokens", model)
    zero = F.aggregate("vector", F.lit(True), lambda acc, x: acc & (x == 0))
    return v.select("post_id", F.col("sid").cast("long").alias("sid"), F.size("vector").alias("dim"),
                    zero.alias("zero_vector"))
