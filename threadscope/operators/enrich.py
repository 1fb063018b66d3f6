"""Enrichment: lexicon sentiment (J8/M4/M5), keyword rules over posts and
comments (F4/F5), post attachment (J2), dictionary joins (J5, J10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import keywords as K
from ..functions import numeric as N
from ..functions import text as X
from .fingerprints import keyword_hits

# A lexicon this small (rows) is inlined as a literal map (look-ups scan its keys);
# larger ones are joined, with the same result.
INLINE_LIMIT = 256
# Entries that a stream or a window scorer takes as literals; more is an error.
LITERAL_LIMIT = 100_000
KEYWORD_BROADCAST_LIMIT = 1_000
KEYWORD_BROADCAST_CHARS = 100_000

LEXICON_SCHEMA = "word string, polarity double, subjectivity double"


def lexicon_df(spark: SparkSession, entries=None) -> DataFrame:
    return spark.createDataFrame(rules.DEFAULT_LEXICON if entries is None else entries, LEXICON_SCHEMA)


def _bounded_count(df: DataFrame, limit: int) -> int:
    return df.limit(limit + 1).count()


def one_entry_a_word(lexicon):
    """A word's first entry of a list, its least (polarity, subjectivity) of a table."""
    if isinstance(lexicon, DataFrame):
        return (lexicon.where(F.col("word").isNotNull()).groupBy("word")
                .agg(F.min(F.struct("polarity", "subjectivity")).alias("e")).select("word", "e.*"))
    seen = {}
    for w, p, s in rules.DEFAULT_LEXICON if lexicon is None else lexicon:
        seen.setdefault(w, (w, float(p), float(s)))
    return list(seen.values())


def lexicon_entries(lexicon, limit: int = LITERAL_LIMIT) -> list:
    """Entries as literals, one a word; a table or list beyond ``limit`` is an error."""
    lex = one_entry_a_word(lexicon)
    rows = [tuple(r) for r in lex.limit(limit + 1).collect()] if isinstance(lex, DataFrame) else lex
    if len(rows) > limit:
        raise ValueError(f"a lexicon of more than {limit} words cannot be used as literals")
    return rows


def lexicon_sentiment(df: DataFrame, text, lexicon=None, out: str = "sentiment",
                      id_cols=None, inline_limit: int | None = None) -> DataFrame:
    """Mean (polarity, subjectivity) over lexicon word hits; none -> 0/0.

    Small lexicon (and any on a stream): a literal map probed per token inside the
    row (narrow, no shuffle of the text).  Large lexicon: the tokens of the
    distinct texts join it, are averaged by text and joined back by a 128-bit hash of
    the text, so row ids (``id_cols`` is kept for callers) play no part and may be null.
    """
    t = X.tokenize(text, clean=False)
    limit = INLINE_LIMIT if inline_limit is None else inline_limit
    lex = one_entry_a_word(lexicon)
    size = _bounded_count(lex, limit) if isinstance(lex, DataFrame) else len(lex)
    if size <= limit or df.isStreaming:
        entries = lexicon_entries(lexicon)
        nothing = F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"))
        if not entries:
            return df.withColumn(out, nothing)
        m = F.create_map(*[c for w, p, s in entries for c in
                           (F.lit(w), F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")))])
        words = [e[0] for e in entries]
        # Tokens are first tested against a hash set (InSet); only hits are
        # looked up in the map.  The hit list is its own projection (used
        # three times, so Catalyst does not re-derive it).
        d = df.withColumn("_hits", F.transform(F.filter(t, lambda w: w.isin(*words)),
                                               lambda w: F.try_element_at(m, w)))
        n = F.size("_hits")
        pol = F.aggregate("_hits", F.lit(0.0), lambda a, s: a + s["p"])
        sub = F.aggregate("_hits", F.lit(0.0), lambda a, s: a + s["s"])
        st = F.when(n > 0, F.struct((pol / n).alias("polarity"), (sub / n).alias("subjectivity"))).otherwise(nothing)
        return d.withColumn(out, st).drop("_hits")
    if not isinstance(lex, DataFrame):
        lex = lexicon_df(df.sparkSession, lex)
    x = F.col(text) if isinstance(text, str) else text
    keyed = df.withColumns({"_k1": F.xxhash64(x), "_k2": F.xxhash64(F.lit(7919), x)})
    tok = keyed.withColumn("_t", t).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.explode("_t").alias("word"))
    sc = tok.join(lex, "word").groupBy("_k1", "_k2").agg(F.avg("polarity").alias("_p"), F.avg("subjectivity").alias("_s"))
    return (keyed.join(sc, ["_k1", "_k2"], "left")
            .withColumn(out, F.struct(F.coalesce("_p", F.lit(0.0)).alias("polarity"),
                                      F.coalesce("_s", F.lit(0.0)).alias("subjectivity")))
            .drop("_p", "_s", "_k1", "_k2"))


def polarity_label(polarity) -> Column:
    """Three-way label from a polarity score (rounded to 9 decimals first, so
    a sum that cancels to within float noise reads as neutral)."""
    p = F.col(polarity) if isinstance(polarity, str) else polarity
    p = F.round(p, 9)
    return (F.when(p > 0, F.lit("positive")).when(p < 0, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def label_sentiment(df: DataFrame, text, lexicon=None, out: str = "sentiment_label",
                    id_cols=None, scorer=None) -> DataFrame:
    """M5: struct(label, score) per text; a failed score reads as neutral, 0.0.

    ``scorer`` (the same as M7's: it maps a DataFrame with a ``chunk`` token array to one with ``logits`` of the
    three classes) replaces the lexicon; the score is then the likeliest class's probability.  Whole texts are
    scored; null texts and failed logits (null, or not three finite numbers) fail."""
    if scorer is not None:
        text = F.col(text) if isinstance(text, str) else text
        d = scorer(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), text.isNotNull().alias("_there"),
                             X.tokenize(text, clean=False).alias("chunk")))
        good = F.col("_there") & (F.size("logits") == 3) & ~F.exists("logits", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        label = F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), N.argmax("logits") + 1)
        d = d.select("_row", F.when(good, F.struct(label.alias("label"), F.array_max(N.softmax("logits")).alias("score")))
                        .otherwise(F.struct(F.lit("neutral").alias("label"), F.lit(0.0).alias("score"))).alias("_label"))
        return d.select("_row.*", F.col("_label").alias(out))
    d = lexicon_sentiment(df, text, lexicon, "_lex", id_cols)
    p = F.col("_lex.polarity")
    return d.withColumn(out, F.struct(
        F.coalesce(polarity_label(p), F.lit("neutral")).alias("label"),
        F.coalesce(F.abs(p), F.lit(0.0)).alias("score"))).drop("_lex")


def _opt(df: DataFrame, name: str, dtype: str) -> Column:
    """An optional input column, or a typed null when the input lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _created_ts(df: DataFrame) -> Column:
    """Post/comment time: ``created_ts`` if present, else the ISO text
    ``timestamp`` of post files, else null."""
    if "created_ts" in df.columns:
        return F.col("created_ts")
    if "timestamp" in df.columns:
        return F.to_timestamp("timestamp")
    return F.lit(None).cast("timestamp")


def enrich_posts(posts: DataFrame, lexicon=None, bug_keywords=None, platform_keywords=None,
                 severity_keywords=None, gazetteer: DataFrame | None = None,
                 word_boundary: bool = False) -> DataFrame:
    """the enriched post projection (keyword rules + sentiment + mentions).

    F9 (null author -> '[deleted]') is applied here; J2 must use raw authors,
    so attach comments before calling this (see ``attach_post``).
    """
    full = X.full_text("title", "text")
    d = posts.withColumn("_full", full)
    d = lexicon_sentiment(d, "_full", lexicon, "sentiment", ["post_id"])
    if gazetteer is not None:
        from .matching import entity_mentions
        ments = entity_mentions(d.select("post_id", "_full"), "post_id", "_full", gazetteer)
        d = d.join(ments, "post_id", "left").withColumn(
            "potential_games", F.coalesce("mentions", F.array().cast("array<string>"))).drop("mentions")
    else:
        d = d.withColumn("potential_games", F.array().cast("array<string>"))
    # Lower-case once; the five rules share the column (referenced several
    # times, so Catalyst keeps it as one projection).
    d = d.withColumn("_xl", K.lower_text("_full"))
    return d.select(
        "post_id", "title", "text",
        F.when(F.col("_full") == "", F.lit(rules.CATEGORY_EMPTY)).otherwise(
            K.label_post("_xl", bug_keywords, word_boundary=word_boundary, lowered=True)).alias("label"),
        _opt(d, "score", "bigint").alias("score"), _opt(d, "upvote_ratio", "double").alias("upvote_ratio"),
        _opt(d, "num_comments", "bigint").alias("num_comments"),
        F.coalesce(_opt(d, "author", "string"), F.lit(rules.DELETED_AUTHOR)).alias("author"),
        _opt(d, "subreddit", "string").alias("subreddit"), _created_ts(d).alias("created_ts"),
        K.detect_platform("_xl", platform_keywords, word_boundary, lowered=True).alias("platform"),
        K.detect_severity("_xl", severity_keywords, word_boundary, lowered=True).alias("severity"),
        "sentiment", "potential_games",
        K.keywords_found("_xl", bug_keywords, word_boundary, lowered=True).alias("bug_keywords_found"),
        K.has_any("_xl", rules.RESOLVED_KEYWORDS, word_boundary, lowered=True).alias("is_resolved"),
    )


def attach_post(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comment -> its post; ``is_op_response`` compares raw authors.

    Equi-join on post_id; a hot post is split by AQE's skew-join handling.
    """
    p = posts.select("post_id", F.col("author").alias("_post_author"))
    return (comments.join(p, "post_id", "left")
            .withColumn("is_op_response",
                        F.coalesce(F.col("author") == F.col("_post_author"), F.lit(False)))
            .drop("_post_author"))


def drop_dead_comments(comments: DataFrame) -> DataFrame:
    """drop comments with no author or a body exactly [deleted]/[removed]."""
    return comments.where(F.col("author").isNotNull()
                          & ~F.coalesce(F.col("text"), F.lit("")).isin(*rules.DEAD_MARKERS))


def enrich_comments(comments: DataFrame, posts: DataFrame, lexicon=None,
                    platform_keywords=None, word_boundary=False) -> DataFrame:
    """the enriched comment projection (after J2)."""
    d = attach_post(comments, posts)
    d = lexicon_sentiment(d, "text", lexicon, "sentiment", ["post_id", "comment_id"])
    return d.select(
        "post_id", "pos", "comment_id", "text", _opt(d, "score", "bigint").alias("score"),
        _opt(d, "author", "string").alias("author"), _created_ts(d).alias("created_ts"), "sentiment",
        K.detect_platform("text", platform_keywords, word_boundary).alias("platform_mentioned"),
        K.has_any("text", rules.SOLUTION_KEYWORDS, word_boundary).alias("has_solution"),
        "is_op_response")


def match_keywords(df: DataFrame, id_cols, text, dictionary: DataFrame,
                   keyword_col: str = "keyword", method: str = "auto") -> DataFrame:
    """(row, keyword) for every dictionary keyword that is a substring of
    lower(text).

    At most KEYWORD_BROADCAST_LIMIT keywords of at most KEYWORD_BROADCAST_CHARS characters together (checked;
    ``method="index"`` forgoes this, as does its old name ``"automaton"``) are broadcast and tested with
    ``contains``.  Else rolling fingerprints (``fingerprints``) find the strings of a text that may be keywords, and these join the dictionary
    on the whole keyword.  Same rows either way.
    """
    id_cols = list(id_cols)
    kw = (dictionary.select(F.lower(F.col(keyword_col)).alias("_kw"), *[
        c for c in dictionary.columns if c != keyword_col]).where(F.length("_kw") > 0))
    x = df.select(*id_cols, K.lower_text(text).alias("_x"))
    rest = [c for c in kw.columns if c != "_kw"]
    order = [*id_cols, F.col("_kw").alias(keyword_col), *rest]
    if method not in ("auto", "broadcast", "index", "automaton"):
        raise ValueError(f"unknown method {method!r}")
    if method in ("auto", "broadcast") and _fits(kw, "_kw"):
        return x.join(F.broadcast(kw), F.col("_x").contains(F.col("_kw"))).select(*order)
    found = keyword_hits(x, id_cols, F.col("_x"), kw.select("_kw"), "_kw")
    return found.join(kw, "_kw").select(*order)


def _fits(kw: DataFrame, col: str) -> bool:
    """Whether a keyword table may be broadcast, by rows and by characters."""
    head = kw.limit(KEYWORD_BROADCAST_LIMIT + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(col)), F.lit(0))).first()
    return head[0] <= KEYWORD_BROADCAST_LIMIT and head[1] <= KEYWORD_BROADCAST_CHARS


def existing_forums(forums: DataFrame, catalog: DataFrame, name_col: str = "name",
                    catalog_col: str = "name") -> DataFrame:
    """Keep forums present in the catalog, names compared lower-cased."""
    cat = catalog.select(F.lower(F.col(catalog_col)).alias("_k")).distinct()
    return (forums.withColumn("_k", F.lower(F.col(name_col)))
            .join(cat, "_k", "left_semi").drop("_k"))


def remove_stop_words(tokens: DataFrame, word_col: str = "word", stop_words=None) -> DataFrame:
    """Anti-join exploded tokens with the stop-word set (literal InSet)."""
    if isinstance(stop_words, DataFrame):
        sw = stop_words.select(F.col(stop_words.columns[0]).alias(word_col)).distinct()
        return tokens.join(sw, word_col, "left_anti")
    sw = stop_words if stop_words is not None else rules.default_stop_words()
    return tokens.where(~F.col(word_col).isin(*sw))

