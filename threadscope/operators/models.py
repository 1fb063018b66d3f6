"""Learning operators: Word2Vec sentence vectors (M1, M2, A11), k-means
inside every discussion (M3), a trainable sentiment classifier (M6), and
windowed batch prediction with a chunk vote (M7, X18, X19, A12, F7).

k-means shuffles the sentences of small discussions once and runs all Lloyd's
iterations of many of them together in a task.  Large discussions run them as
DataFrame jobs: each point joins its discussion's (at most k_max) centroids as one
array, picks the nearest inside the row, and centroids are re-estimated by
a partial-aggregating mean, so a discussion holding a third of all sentences is spread out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import numeric as N
from ..functions import text as X
from . import embeddings, word2vec
from .windows import top_k


def sentence_tokens(df: DataFrame, text_col: str = "sentence", stop_words=None) -> Column:
    """X22 + J9 on one text, as an ordered token array (for Word2Vec)."""
    sw = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else rules.default_stop_words())])
    return F.filter(X.tokenize(text_col), lambda w: ~F.array_contains(sw, w))


def fit_word2vec(tokens: DataFrame, col: str = "tokens", vector_size: int = 100, window: int = 5,
                 min_count: int = 1, seed: int = 42, num_partitions: int = 8,
                 max_iter: int = 5):
    """M1: one Word2Vec model for the whole corpus (not one per discussion).

    Skip-gram with negative sampling (``word2vec``); the vocabulary and its vectors stay in tables.  Sentences are dealt
    to ``num_partitions`` blocks, whatever the cluster's size, or to more if these would be too large.
    """
    return word2vec.fit(tokens, col, vector_size, window, min_count, seed, num_partitions, max_iter)


def sentence_vectors(df: DataFrame, keys, tok_col: str, model) -> DataFrame:
    """Mean word vector per sentence; no known word -> zero vector.

    Tokens equi-join the model's vector table (no broadcast of the model),
    then a partial-aggregating mean per sentence.
    """
    keys = list(keys)
    vecs = model.getVectors().withColumnRenamed("word", "_w")
    dim = model.getVectorSize()
    ex = df.select(*keys, F.explode(tok_col).alias("_w"))
    means = (ex.join(vecs, "_w").groupBy(*keys)
             .agg(Summarizer.mean(F.col("vector")).alias("_m"))
             .select(*keys, vector_to_array("_m").alias("_vec")))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.join(means, keys, "left").withColumn("vector", F.coalesce("_vec", zero)).drop("_vec")


#: Points up to which a group is clustered inside one task, and points of a larger group that meet their centroids in one task.
SMALL_GROUP, SALT_ROWS = 10_000, 100_000
#: Bytes of centroids up to which they are broadcast; beyond, points are shuffled to them.
CENTROID_BYTES = 64 << 20
#: Large groups up to which their keys are broadcast.
BROADCAST_GROUPS = 100_000


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def lloyd(v, group, rank, k_max: int, max_iter: int, tol: float):
    """Labels of the points ``v`` (an array row each) of whole groups, numbered from 0 in ``group`` (ascending); the
    points of ``rank`` below k_max are their group's first centroids.  All groups take their steps together; a group
    whose centroids stay takes no more."""
    labels = np.zeros(len(v), dtype=np.int32)
    live = np.arange(len(v))
    cents = np.full((group[-1] + 1 if len(group) else 0, k_max, v.shape[1]), np.inf)
    first = rank < k_max
    cents[group[first], rank[first]] = v[first]

    def nearest(x, g):
        d = np.stack([np.square(x - cents[g, c]).sum(axis=1) for c in range(k_max)], axis=1)
        return d.argmin(axis=1).astype(np.int32)

    for _ in range(max_iter):
        x, g = v[live], group[live]
        cell = g.astype(np.int64) * k_max + nearest(x, g)
        order = np.argsort(cell, kind="stable")
        cells, at, n = np.unique(cell[order], return_index=True, return_counts=True)
        means = np.add.reduceat(x[order], at, axis=0) / n[:, None] if len(at) else x
        flat = cents.reshape(-1, v.shape[1])
        moved = np.square(means - flat[cells]).sum(axis=1) > tol
        flat[cells] = means
        going = np.zeros(len(cents), dtype=bool)
        going[cells[moved] // k_max] = True
        settled = live[~going[g]]
        labels[settled] = nearest(v[settled], group[settled])
        live = live[going[g]]
        if not len(live):
            break
    labels[live] = nearest(v[live], group[live])
    return labels


def _small_groups(k_max: int, max_iter: int, tol: float):
    """Rows (group, id, rank, vector) of whole groups, each in order of its ranks from 1, to (group, id, cluster)."""
    def run(batches):
        def cluster(t):
            rank = t.column(2).to_numpy()
            v = t.column(3).combine_chunks().flatten().to_numpy().reshape(len(rank), -1)
            labels = lloyd(v, np.cumsum(rank == 1) - 1, rank - 1, k_max, max_iter, tol)
            return t.select([0, 1]).append_column("cluster", pa.array(labels)).combine_chunks().to_batches()

        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            starts = np.flatnonzero(t.column(2).to_numpy() == 1)
            whole = int(starts[-1]) if len(starts) else 0  # the last group may go on in the next batch
            if whole:
                yield from cluster(t.slice(0, whole))
            kept = t.slice(whole)
        if kept is not None and len(kept):
            yield from cluster(kept)
    return run


def kmeans_per_group(df: DataFrame, group_col: str, id_col: str, vec_col: str,
                     k_max: int = rules.MAX_CLUSTERS, max_iter: int = 50, seed: int = 42,
                     tol: float = 1e-9) -> DataFrame:
    """M3: k-means inside every group, k = min(#points, k_max).

    Initial centroids: the k points with the smallest seeded hash (a
    per-group top-k, planned with a partial limit before the shuffle).
    Returns (group, id, cluster).  Labels are those that exist; an emptied
    cluster keeps its previous centroid.

    The points of groups of at most SMALL_GROUP points are shuffled once, and such a group takes all its steps in one
    task.  The points of larger groups stay where they are, and their centroids come to them at each step.
    """
    # Points are read once per iteration: materialise them (and cut the
    # lineage of whatever produced the vectors) before the loop.
    pts = df.select(group_col, id_col, F.col(vec_col).cast("array<double>").alias("_v")).where(F.col(group_col).isNotNull()).checkpoint()
    h = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(id_col).cast("string")))
    finite = F.forall("_v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    sizes = (pts.groupBy(F.col(group_col).alias("_g"))
             .agg(F.count("*").alias("_n"), F.min(F.size("_v")).alias("_low"), F.max(F.size("_v")).alias("_dim"),
                  F.coalesce(F.min(F.coalesce(finite, F.lit(False))), F.lit(False)).alias("_finite")).checkpoint())
    dim = sizes.agg(F.max("_dim")).first()[0] or 0
    # Vectors that are no rows of one matrix go the way of the larger groups.
    limit = min(SMALL_GROUP, SALT_ROWS)
    large = sizes.where((F.col("_n") > limit) | ~F.col("_finite") | (F.col("_low") < dim) | (F.col("_dim") < 1)).checkpoint()
    n_large = large.count()
    few = pts
    if n_large:  # broadcast, or all points of a large group would meet in a task
        few = pts.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, F.col(group_col) == F.col("_g"), "left_anti")
    ranked = few.select(group_col, id_col, F.row_number().over(Window.partitionBy(group_col).orderBy(h, F.col(id_col))).alias("_rank"), "_v")
    schema = T.StructType([pts.schema[group_col], pts.schema[id_col], T.StructField("cluster", T.IntegerType())])
    done = ranked.mapInArrow(_small_groups(k_max, max_iter, tol), schema)
    if not n_large:
        return done
    return done.unionByName(_large_groups(pts, large, group_col, id_col, h, dim, k_max, max_iter, tol))


def _large_groups(pts: DataFrame, large: DataFrame, group_col: str, id_col: str, h: Column, dim: int,
                  k_max: int, max_iter: int, tol: float) -> DataFrame:
    """k-means of the groups ``large`` (_g, _n), a job a step: points join the array of their group's centroids."""
    # Groups of more than SALT_ROWS points meet their centroids in several tasks: points get a salt
    # by their id, centroids a copy for each salt.
    salts = large.select("_g", F.ceil(F.col("_n") / SALT_ROWS).alias("_salts"))
    copies = salts.agg(F.sum("_salts")).first()[0]
    fits = copies * k_max * (8 * dim + 64) <= CENTROID_BYTES
    if fits:
        salts = F.broadcast(salts)

    def salted(d: DataFrame, salt: Column) -> DataFrame:
        return d.join(salts, F.col(group_col) == F.col("_g")).withColumn("_salt", salt).drop("_g", "_salts")

    pts = salted(pts, F.pmod(F.xxhash64(id_col), F.col("_salts"))).checkpoint()
    init = top_k(pts, [group_col], [h, F.col(id_col)], k_max, "_rk")
    cents = init.select(group_col, (F.col("_rk") - 1).cast("int").alias("cluster"), F.col("_v").alias("_c"))
    cents = cents.checkpoint()

    def assign(c: DataFrame) -> DataFrame:
        arr = c.groupBy(group_col).agg(F.collect_list(F.struct("cluster", "_c")).alias("_cs"))
        arr = salted(arr, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
        j = pts.join(F.broadcast(arr) if fits else arr.hint("merge"), [group_col, "_salt"])
        best = F.array_min(F.transform("_cs", lambda s: F.struct(_sqdist(F.col("_v"), s["_c"]).alias("d"),
                                                               s["cluster"].alias("cluster"))))
        return j.select(group_col, id_col, "_v", best["cluster"].alias("cluster"))

    for _ in range(max_iter):
        a = assign(cents)
        new = (a.groupBy(group_col, "cluster").agg(Summarizer.mean(array_to_vector("_v")).alias("_m"))
               .select(group_col, "cluster", vector_to_array("_m").alias("_n")))
        upd = (cents.join(new, [group_col, "cluster"], "left")
               .select(group_col, "cluster", F.coalesce("_n", "_c").alias("_nc"), "_c")).checkpoint()  # read twice
        shift = upd.agg(F.max(_sqdist(F.col("_nc"), F.col("_c")))).first()[0]
        cents = upd.select(group_col, "cluster", F.col("_nc").alias("_c"))
        if shift is None or shift <= tol:
            break
    return assign(cents).select(group_col, id_col, "cluster")


def kmeans_corpus(df: DataFrame, vec_col: str = "vector", k: int = 20, max_iter: int = 50, seed: int = 42) -> DataFrame:
    """M3 over the corpus: topics of all sentences together (k centroids on the driver); appends ``topic``."""
    from pyspark.ml.clustering import KMeans
    d = df.withColumn("_features", array_to_vector(vec_col))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_features", predictionCol="topic").fit(d)
    return model.transform(d).drop("_features")


def cluster_sentences(aligned: DataFrame, stop_words=None, k_max: int = rules.MAX_CLUSTERS,
                      seed: int = 42, vector_size: int = 100, max_iter: int = 50,
                      embedding: str = "random_index") -> DataFrame:
    """M1-M3 for the summary: vectors of the aligned sentences, then k-means per discussion.  Returns
    aligned rows + ``cluster``.

    ``embedding``: ``random_index`` (``embeddings``; no vocabulary on the driver) or ``word2vec``."""
    toks = aligned.select("post_id", "sid", "sentence",
                          sentence_tokens(aligned, "sentence", stop_words).alias("tokens"))
    toks = toks.checkpoint()
    if embedding == "random_index":
        vec = embeddings.sentence_vectors(toks, ["post_id", "sid"], "tokens", dim=vector_size)
    elif embedding == "word2vec":
        model = fit_word2vec(toks, "tokens", vector_size=vector_size, seed=seed)
        vec = sentence_vectors(toks, ["post_id", "sid"], "tokens", model)
    else:
        raise ValueError(f"unknown embedding {embedding!r}")
    vec = vec.withColumn("_id", F.col("sid"))
    lab = kmeans_per_group(vec, "post_id", "_id", "vector", k_max, max_iter, seed)
    return (toks.join(lab.withColumnRenamed("_id", "sid"), ["post_id", "sid"])
            .select("post_id", "sid", "sentence", "cluster"))


# ---- M6: trainable classifier -------------------------------------------

def train_sentiment(train: DataFrame, text_col: str = "text", label_col: str = "label",
                    num_features: int = 1 << 15, max_iter: int = 50, reg: float = 0.01):
    """M6: tokenizer -> hashed TF -> IDF -> multinomial logistic regression."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol=label_col, family="multinomial",
                           maxIter=max_iter, regParam=reg)])
    return pipe.fit(train)


# ---- M7: windowed prediction with a chunk vote --------------------------

def lexicon_logits(df: DataFrame, tok_col: str, lexicon=None) -> DataFrame:
    """A scorer: logits [#negative words, 0.5, #positive words] per window."""
    from .enrich import lexicon_entries
    seen = {w: p for w, p, _ in lexicon_entries(lexicon)}
    negw = [w for w, p in seen.items() if p < 0] or [""]
    posw = [w for w, p in seen.items() if p > 0] or [""]
    neg = F.size(F.filter(tok_col, lambda w: w.isin(*negw))).cast("double")
    pos = F.size(F.filter(tok_col, lambda w: w.isin(*posw))).cast("double")
    return df.withColumn("logits", F.array(neg, F.lit(0.5), pos))


def windows(df: DataFrame, id_cols, text_col: str, size: int = 512, overlap: int = 256) -> DataFrame:
    """X10 + X19: mask handles/URLs, tokenize, cut overlapping windows
    (every token of the whole text is covered)."""
    id_cols = list(id_cols)
    t = X.tokenize(X.mask_handles_urls(F.coalesce(F.col(text_col), F.lit(""))), clean=False)
    # Tokens get their own projection (referenced twice below, so Catalyst
    # keeps it) instead of being re-derived inside the window lambda.
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    d = df.select(*id_cols, t.alias("_t"))
    # Each window leaves its row as its own slice of the tokens: a row that also held the
    # tokens of the whole text would be copied with them once a window.
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - overlap - 1, F.lit(0)), F.lit(step))
    chunks = F.transform(starts, lambda s: F.slice("_t", s + 1, size))
    return d.select(*id_cols, F.posexplode(chunks).alias("w", "chunk"))


def predict_polarity(df: DataFrame, id_cols, text_col: str, scorer=None, size: int = 512,
                     overlap: int = 256) -> DataFrame:
    """M7: windows -> scorer logits -> softmax/argmax (X18) -> polarity
    (X17) -> half-even vote per text (A12).  ``scorer`` maps a DataFrame
    with a ``chunk`` token array to one with ``logits``; default is the
    lexicon scorer."""
    id_cols = list(id_cols)
    w = windows(df, id_cols, text_col, size, overlap)
    scored = (scorer or (lambda d: lexicon_logits(d, "chunk")))(w)
    # softmax is strictly increasing, so argmax(softmax(l)) == argmax(l).
    pol = scored.withColumn("pred", N.label_to_polarity(N.argmax("logits")))
    return pol.groupBy(*id_cols).agg(N.vote("pred").alias("polarity"))


def model_scorer(model, text_col: str = "_wtext"):
    """Wrap a fitted classification PipelineModel (M6) as a window scorer."""
    def run(d: DataFrame) -> DataFrame:
        x = d.withColumn(text_col, F.array_join("chunk", " "))
        out = model.transform(x.withColumnRenamed(text_col, "text"))
        return out.withColumn("logits", vector_to_array("rawPrediction"))
    return run


def batch_scorer(make_predict_fn, batch_size: int = 64):
    """M7 with a caller's own network: ``make_predict_fn()`` returns a
    function from a numpy array of window texts to an (n, 3) array
    of logits (for example an ONNX session).  It runs through
    ``predict_batch_udf`` (Arrow batches, model loaded once per Python
    worker) and yields a scorer for ``predict_polarity``."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=None)

    def run(d: DataFrame) -> DataFrame:
        return d.withColumn("logits", udf(F.array_join("chunk", " ")).cast("array<double>"))
    return run


def apply_predictions(posts: DataFrame, comments: DataFrame, post_preds: DataFrame,
                      comment_preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F7 on the long tables: set ``sentiment.polarity`` where the text and the
    polarity field exist (posts by post_id; comments by post_id and comment_id, or by
    comment_id alone where the predictions have no post_id); other rows pass unchanged.  Equi-joins only; re-nest at the write edge (S6)."""
    p = posts.join(post_preds.select("post_id", F.col("polarity").alias("_pp")), "post_id", "left")
    has = F.col("title").isNotNull() & F.col("sentiment.polarity").isNotNull() & F.col("_pp").isNotNull()
    p = p.withColumn("sentiment", F.when(has, F.col("sentiment").withField(
        "polarity", F.col("_pp").cast("double"))).otherwise(F.col("sentiment"))).drop("_pp")
    keys = [k for k in ("post_id", "comment_id") if k in comment_preds.columns]
    c = comments.join(comment_preds.select(*keys, F.col("polarity").alias("_cp")), keys, "left").select(*comments.columns, "_cp")
    hc = F.col("text").isNotNull() & F.col("sentiment.polarity").isNotNull() & F.col("_cp").isNotNull()
    c = c.withColumn("sentiment", F.when(hc, F.col("sentiment").withField(
        "polarity", F.col("_cp").cast("double"))).otherwise(F.col("sentiment"))).drop("_cp")
    return p, c
