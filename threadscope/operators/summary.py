"""Extractive summary of each discussion (M9-M13) and every step of it.

Sentences never require the whole discussion in one place.  Each valid
comment contributes ``text + ' '`` (the joiner) split at [.!?]+white space;
a comment's last piece is always continued by the next comment's first
piece, so a sentence id is ``(#boundaries in earlier comments) + j``, a
running sum computed by the skew-safe ``prefix_sums``.  Only the two edge
pieces of a comment are grouped to stitch sentences that cross comments;
interior pieces are whole sentences already.

Scores follow the reference formula, including repeated sentences: the
k-th occurrence of a text starts from the previous finished score,
``s <- (s + c) / n * b_k``.  Each step is an affine map, and affine maps
compose associatively, so ``fold_duplicate_scores`` folds occurrences in
bounded sid buckets and then composes the bucket maps in order; a text
repeated a billion times is still split over many tasks.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import numeric as N
from ..functions import text as X
from .enrich import label_sentiment, remove_stop_words
from .windows import DEFAULT_BUCKET_WIDTH, prefix_sums, top_k


def valid_comments(comments: DataFrame) -> DataFrame:
    """stripped text not a dead marker; missing text kept as ''."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return comments.withColumn("text", t).where(~X.strip(t).isin(*rules.DEAD_MARKERS))


#: Bytes of a joined text beyond which ``concat_ordered`` fails (one value of a row holds 2 GB at most).
MAX_TEXT_BYTES = 1 << 30


def concat_ordered(df: DataFrame, keys: list[str], order: list[str], piece: str, sep: str, out: str,
                   bucket_width: int = DEFAULT_BUCKET_WIDTH, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """(keys, out): the non-null ``piece`` of each key in order, joined by ``sep`` ('' if all are null).

    Pieces are joined inside buckets of ``bucket_width`` numbers of ``order[0]`` (an integer) first, so no task
    sorts all pieces of a key; then a key's few bucket texts are joined.  A text of more than ``max_bytes`` fails
    with its size and key before it is built."""
    parts = (df.withColumn("_bucket", F.floor(F.col(order[0]) / bucket_width).cast("long"))
             .groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(piece).alias("_p")))).getField("_p").alias("_ps")))
    parts = parts.select(*keys, "_bucket", F.when(F.exists("_ps", lambda p: p.isNotNull()), F.array_join("_ps", sep)).alias("_part"))
    size = F.sum(F.coalesce(F.octet_length("_part"), F.lit(0)).cast("long") + len(sep.encode())).over(Window.partitionBy(*keys))
    checked = F.when(F.col("_size") > max_bytes, F.raise_error(F.concat(
        F.lit(f"joined text exceeds {max_bytes} bytes: "), F.col("_size").cast("string"),
        F.lit(" bytes at "), F.to_json(F.struct(*keys))))).otherwise(F.col("_part"))
    return (parts.withColumn("_size", size).select(*keys, "_bucket", checked.alias("_part"))
            .groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_bucket", "_part"))).getField("_part"), sep).alias(out)))


def discussion_text(comments: DataFrame, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                    max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """The joined discussion text (comment order, ' ' separator; ``concat_ordered``).

    This materialises one value per discussion by definition; the summary
    itself never builds it (see the module docstring).
    """
    return concat_ordered(comments, ["post_id"], ["pos"], "text", " ", "all_text", bucket_width, max_bytes)


def lemmatize(tokens: DataFrame, lemmas: DataFrame, word_col: str = "word") -> DataFrame:
    """X22 option: replace each token by its lemma from a (word, lemma) table;
    unknown words stay as they are.  An equi-join (broadcast by AQE when the
    table is small), so the table never has to fit on one machine."""
    lt = lemmas.select(F.lower(F.col("word")).alias("_lw"), F.lower(F.col("lemma")).alias("_lemma")) \
        .dropDuplicates(["_lw"])
    return (tokens.join(lt, tokens[word_col] == lt["_lw"], "left")
            .withColumn(word_col, F.coalesce("_lemma", F.col(word_col))).drop("_lw", "_lemma"))


def summary_steps(posts: DataFrame, comments: DataFrame, lexicon=None, stop_words=None,
                  bucket_width: int = DEFAULT_BUCKET_WIDTH, materialize: bool = True,
                  lemmas: DataFrame | None = None, align: str = "position", scorer=None) -> SimpleNamespace:
    """All intermediate tables of the summary, each a lazy DataFrame.

    ``lemmas`` is an optional (word, lemma) table applied to tokens before
    the stop-word test (default: none).  ``align="position"`` pairs sentence i with comment i, as the
    reference does; ``align="source"`` pairs a sentence with the comment in which it begins, keeps all sentences,
    and counts every valid comment once (``aligned.src`` is the comment's index either way).
    ``scorer`` labels comments by a trained model (M5) in place of the lexicon."""
    if align not in ("position", "source"):
        raise ValueError(f"unknown alignment {align!r}")
    v = valid_comments(comments).select("post_id", "pos", "text")
    v = label_sentiment(v, "text", lexicon, "_sl", ["post_id", "pos"], scorer)  # M5
    v = v.withColumn("label", F.col("_sl.label")).drop("_sl")
    v = (v.withColumn("_pieces", X.sentence_pieces(F.concat("text", F.lit(" "))))
          .withColumn("_np", F.size("_pieces")))
    # W6 (valid-comment index) and the sentence-id base in one skew-safe pass.
    v = prefix_sums(v, ["post_id"], "pos", {"idx": F.lit(1), "_base": F.col("_np") - 1},
                    bucket_width=bucket_width)

    pieces = (v.select("post_id", "idx", "label", "_np", "_base",
                       F.posexplode("_pieces").alias("j", "piece"))
                .withColumn("sid", F.col("_base") + F.col("j")))                # X21
    if materialize:
        # Every later step reads this table (sentences, tokens, labels,
        # counts): a reliable checkpoint in the shared folder cuts the
        # lineage, so a lost executor never replays the index passes.
        pieces = pieces.checkpoint()
    interior = (pieces.where((F.col("j") > 0) & (F.col("j") < F.col("_np") - 1))
                .select("post_id", "sid", X.strip("piece").alias("sentence")))
    # Edge pieces stitch sentences across comments.  Empty pieces (a comment
    # that ends a sentence leaves one) add nothing, so they never shuffle.
    edge = concat_ordered(
        pieces.where(((F.col("j") == 0) | (F.col("j") == F.col("_np") - 1)) & (F.col("piece") != "")),
        ["post_id", "sid"], ["idx", "j"], "piece", "", "_s", bucket_width).select("post_id", "sid", X.strip("_s").alias("sentence"))
    sentences = interior.unionByName(edge).where(F.col("sentence") != "")

    toks = pieces.select("post_id", "sid", F.explode(X.tokenize("piece")).alias("word"))  # X22
    if lemmas is not None:
        toks = lemmatize(toks, lemmas)
    toks = remove_stop_words(toks, "word", stop_words)                          # J9
    tok_counts = toks.groupBy("post_id", "sid", "word").agg(F.count("*").alias("cnt"))
    freq = tok_counts.groupBy("post_id", "word").agg(F.sum("cnt").alias("freq"))  # A7
    sstat = (tok_counts.join(freq, ["post_id", "word"])                         # J4
             .groupBy("post_id", "sid")
             .agg(F.sum(F.col("cnt") * F.col("freq")).alias("c"), F.sum("cnt").alias("n")))

    firsts = pieces.where(F.col("j") == 0)          # one row per valid comment
    if align == "position":
        labels = firsts.select("post_id", F.col("idx").alias("sid"), F.col("idx").alias("src"), "label")
    else:
        labels = (pieces.where(X.strip("piece") != "").groupBy("post_id", "sid")
                  .agg(F.min(F.struct("idx", "label")).alias("_f"))
                  .select("post_id", "sid", F.col("_f.idx").alias("src"), F.col("_f.label").alias("label")))
    aligned = (sentences.join(labels, ["post_id", "sid"])                      # J3
               .join(sstat, ["post_id", "sid"], "left")
               .withColumn("c", F.coalesce("c", F.lit(0)).cast("long"))
               .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))
    if materialize:
        # Scores, counts and clustering all read the aligned sentences; one
        # checkpoint instead of three recomputations of the sentence joins.
        aligned = aligned.checkpoint()

    scored = aligned.where(F.col("n") > 0).withColumn("boost", N.sentiment_boost("label"))
    grp = fold_duplicate_scores(scored, bucket_width)
    scores = scored.join(grp, ["post_id", "sentence"])                          # A10

    counted = aligned if align == "position" else firsts
    dist = (counted.groupBy("post_id")                                         # A8
            .agg(F.count("*").alias("total_comments"),
                 F.count_if(F.col("label") == "positive").alias("positive"),
                 F.count_if(F.col("label") == "negative").alias("negative"),
                 F.count_if(F.col("label") == "neutral").alias("neutral"),
                 *([F.max(F.col("n") > 0).alias("_any_scored")] if align == "position" else [])))
    if align == "source":
        dist = dist.join(aligned.groupBy("post_id").agg(F.max(F.col("n") > 0).alias("_any_scored")), "post_id")
    n_valid = firsts.groupBy("post_id").agg(F.count("*").alias("_n_valid"))
    return SimpleNamespace(valid=v, pieces=pieces, sentences=sentences, tokens=toks,
                           freq=freq, sentence_stats=sstat, aligned=aligned,
                           scores=scores, distribution=dist, n_valid=n_valid, posts=posts)


def fold_duplicate_scores(scored: DataFrame, bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """A10 over repeated sentences: ``s <- (s + c) / n * b_k`` in sid order.

    Each step is the affine map s -> (b/n) s + c b / n, and affine maps
    compose associatively, so the ordered fold is done in two bounded
    levels: occurrences are folded inside (post, sentence, sid bucket)
    groups of at most ``bucket_width`` rows, then the per-bucket maps are
    composed in bucket order.  No group ever holds all occurrences of a hot
    repeated sentence.
    """
    occ = (scored.withColumn("_bk", F.floor(F.col("sid") / F.lit(bucket_width)).cast("long"))
           .groupBy("post_id", "sentence", "_bk")
           .agg(F.sort_array(F.collect_list(F.struct("sid", "boost"))).alias("_occ"),
                F.first("c").alias("c"), F.first("n").alias("n"), F.min("sid").alias("_first")))
    step = F.aggregate("_occ", F.struct(F.lit(1.0).alias("A"), F.lit(0.0).alias("B")),
                       lambda acc, o: F.struct((acc["A"] * o["boost"] / F.col("n")).alias("A"),
                                               ((acc["B"] + F.col("c")) * o["boost"] / F.col("n")).alias("B")))
    maps = occ.select("post_id", "sentence", "_bk", "c", "_first", step.alias("_ab"))
    grp = (maps.groupBy("post_id", "sentence")
           .agg(F.sort_array(F.collect_list(F.struct("_bk", "_ab"))).alias("_maps"),
                F.min("_first").alias("first_idx")))
    score = F.aggregate("_maps", F.lit(0.0), lambda s_, m: m["_ab"]["A"] * s_ + m["_ab"]["B"])
    return grp.select("post_id", "sentence", score.alias("score"), "first_idx")


def _assemble(steps: SimpleNamespace, picked: DataFrame) -> DataFrame:
    """M10 + final row per post: fallbacks first, then summary and counts."""
    summ = (picked.groupBy("post_id")
            .agg(F.sort_array(F.collect_list(F.struct("first_idx", "sid", "sentence")))
                 .getField("sentence").alias("_sents"))
            .select("post_id", X.bullets("_sents").alias("_summary")))
    p = steps.posts.select("post_id", "title")
    out = (p.join(steps.n_valid, "post_id", "left")
           .join(steps.distribution, "post_id", "left")
           .join(summ, "post_id", "left"))
    ok = F.col("_n_valid").isNotNull() & F.col("total_comments").isNotNull() & F.col("_any_scored")
    summary = (F.when(F.col("_n_valid").isNull(), F.lit(rules.MSG_NO_COMMENTS))
               .when(F.col("total_comments").isNull(), F.lit(rules.MSG_BLANK_TEXT))
               .when(~F.col("_any_scored"), F.lit(rules.MSG_NOT_SCORED))
               .otherwise(F.col("_summary")))
    cnt = [F.when(ok, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
           for c in ("total_comments", "positive", "negative", "neutral")]
    return out.select("post_id", "title", summary.alias("summary"), *cnt)


def summarize(posts: DataFrame, comments: DataFrame, cluster: str = "none", n: int = 5,
              lexicon=None, stop_words=None, k_max: int = rules.MAX_CLUSTERS,
              seed: int = 42, vector_size: int = 100, max_iter: int = 50,
              bucket_width: int = DEFAULT_BUCKET_WIDTH, lemmas: DataFrame | None = None,
              embedding: str = "random_index", align: str = "position", scorer=None) -> DataFrame:
    """One summary row per post (``align`` and ``scorer``: see ``summary_steps``).

    ``cluster="none"`` (the published 'base' variant): the ``n`` best scored
    sentences, ties to the earlier one, printed in text order.
    ``cluster="kmeans"``: sentence vectors (``embedding``: random_index or word2vec), k-means inside each
    discussion (k = min(#sentences, k_max)), best sentence per cluster.
    """
    text_ids = all(isinstance(d.schema["post_id"].dataType, T.StringType) for d in (posts, comments))
    if text_ids:
        # every piece, sentence and word carries its post's id, and readers make ids of paths: 16 bytes stand in for them
        posts = posts.select(_digest("post_id"), F.struct("post_id", "title").alias("title"))
        comments = comments.withColumn("post_id", _digest("post_id"))
    steps = summary_steps(posts, comments, lexicon, stop_words, bucket_width, lemmas=lemmas, align=align, scorer=scorer)
    if cluster == "none":
        picked = top_k(steps.scores, ["post_id"], [F.round("score", 9).desc(), "sid"], n)
    elif cluster == "kmeans":
        from .models import cluster_sentences
        labelled = cluster_sentences(steps.aligned, stop_words, k_max=k_max, seed=seed,
                                     vector_size=vector_size, max_iter=max_iter, embedding=embedding)
        picked = cluster_representatives(labelled, steps.scores)
    else:
        raise ValueError(f"unknown cluster mode {cluster!r}")
    out = _assemble(steps, picked)
    return out.select("title.post_id", "title.title", *out.columns[2:]) if text_ids else out


def _digest(col: str) -> Column:
    return F.unhex(F.md5(col)).alias(col)


def cluster_representatives(labelled: DataFrame, scores: DataFrame) -> DataFrame:
    """W4 + T1 input: best sentence per (post, cluster); unscored = 0; ties ->
    lowest index.  ``max_by`` is a partial aggregate, so hot posts are fine."""
    firsts = labelled.groupBy("post_id", "sentence").agg(F.min("sid").alias("first_idx"))
    s = scores.select("post_id", "sid", "score")
    d = (labelled.join(s, ["post_id", "sid"], "left").join(firsts, ["post_id", "sentence"])
         .withColumn("score", F.coalesce("score", F.lit(0.0))))
    best = (d.groupBy("post_id", "cluster")
            .agg(F.max_by(F.struct("first_idx", "sid", "sentence"),
                          F.struct(F.round("score", 9), -F.col("sid"))).alias("_b")))
    return best.select("post_id", "cluster", "_b.first_idx", "_b.sid", "_b.sentence")


def report_lines(summaries: DataFrame) -> DataFrame:
    """The detailed text block per discussion."""
    return summaries.select("post_id", F.format_string(
        "\nDiscussion: %s\n%s\n%s\n\nMetrics:\nTotal Comments: %d\nPositive Comments: %d\n"
        "Negative Comments: %d\nNeutral Comments: %d\n",
        F.col("title"), X.underline(F.col("title")), F.col("summary"), F.col("total_comments"),
        F.col("positive"), F.col("negative"), F.col("neutral")).alias("block"))


def report_rows(summaries: DataFrame) -> DataFrame:
    """The six-column TSV row per discussion."""
    return summaries.select(
        F.col("title").alias("Title"), F.col("total_comments").alias("Total Comments"),
        F.col("positive").alias("Positive Comments"), F.col("negative").alias("Negative Comments"),
        F.col("neutral").alias("Neutral Comments"), F.col("summary").alias("Key Points"))


def summary_sentiment(summaries: DataFrame, lexicon=None) -> DataFrame:
    """The overall sentiment of each summary text."""
    d = label_sentiment(summaries, "summary", lexicon, "_sl", ["post_id"])
    return d.select("post_id", F.col("_sl.label").alias("summary_label"),
                    F.col("_sl.score").alias("summary_score"))


def write_report(summaries: DataFrame, base_dir: str, run_id: str | None = None) -> dict:
    """A new run folder ``run=<yyyyMMdd_HHmmss>`` with the six-column TSV
    (S9) and the detailed text report (S10); returns the paths and the number
    of discussions processed.  An empty input gives empty files, not an error."""
    import datetime as _dt
    from ..sources.files import write_delimited
    run = run_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    root = f"{base_dir.rstrip('/')}/run={run}"
    tsv, txt = f"{root}/discussion_summary", f"{root}/discussion_detailed"
    s = summaries.checkpoint()          # written twice and counted: compute once
    write_delimited(report_rows(s), tsv, sep="\t")
    report_lines(s).select(F.col("block").alias("value")).write.text(txt)
    return {"tsv_dir": tsv, "text_dir": txt, "processed_discussions": s.count()}
