"""Name matching (J1), entity mentions from a gazetteer (M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X

FIRST_WORD_LIMIT = 1_000_000


def deletion_variants(c: Column, d: int) -> Column:
    """All strings obtained by deleting up to ``d`` characters (incl. none)."""
    out = F.array(c)
    for _ in range(d):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.concat(F.array(s), F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, 1, i - 1), F.substr(s, i + 1, F.length(s))))))))
    return out


def segment_bounds(length: Column, i: Column, d: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment ``i`` of ``d`` + 1 almost equal segments of a string."""
    start = F.floor(length * i / (d + 1)).cast("int")
    return start, F.floor(length * (i + 1) / (d + 1)).cast("int") - start


def name_segments(c: Column, d: int) -> Column:
    """Keys (length of the name, segment number, segment): ``d`` edits leave one of ``d`` + 1 segments whole."""
    def key(i: Column) -> Column:
        start, n = segment_bounds(F.length(c), i, d)
        return F.struct(F.length(c).alias("l"), i.alias("i"), F.substr(c, start + 1, n).alias("seg"))
    return F.transform(F.sequence(F.lit(0), F.lit(d)), key)


def title_segments(c: Column, d: int) -> Column:
    """All keys under which a name within ``d`` edits of a non-empty title can be listed.

    Segment ``i`` of a name that fits may have moved by at most ``i`` places (the segments before it hold at most ``i``
    edits, else an earlier one is whole) and, seen from the end, by at most ``d - i``."""
    n = F.length(c)
    none = F.array().cast("array<struct<l:int,i:int,seg:string>>")

    def of_segment(size: Column, i: Column) -> Column:
        start, width = segment_bounds(size, i, d)
        low = F.greatest(F.lit(0), start - i, start + n - size - (d - i))
        high = F.least(n - width, start + i, start + n - size + (d - i))
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda at: F.struct(
            size.alias("l"), i.alias("i"), F.substr(c, at + 1, width).alias("seg")))).otherwise(none)

    sizes = F.sequence(F.greatest(F.lit(d + 1), n - d), n + d)
    keys = F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(d)), lambda i: of_segment(size, i)))))
    return F.array_distinct(keys)


#: Names beyond which a segment is left to the deletion variants, whose keys are nearly whole names.
HOT_SEGMENT = 64
#: Names or titles of one task before each becomes up to several hundred keys.
NAMES_PER_TASK = 2000


def spread(df: DataFrame, key: str) -> DataFrame:
    """A written table dealt to tasks of about NAMES_PER_TASK rows, whatever its bytes."""
    return df.repartition(df.count() // NAMES_PER_TASK + 1, key)


def name_candidates(titles: DataFrame, names: DataFrame, max_distance: int, hot: int = HOT_SEGMENT) -> DataFrame:
    """Pairs (_tn, _cn, match) that hold every pair within ``max_distance`` edits, by shared segments.

    A segment that more than ``hot`` names share says little, so the names and titles that hold such a segment
    meet by deletion variants instead; so do names without ``max_distance`` + 1 characters, whose segments are empty.
    Tables of keys are many times larger than the names they come from, which sizes of files don't tell, so they are
    always shuffled and never broadcast.  Variants are met by their hashes; equal hashes of others cost a pair."""
    d = max_distance
    long = names.where(F.length("_cn") > d)
    cs = long.select("_cn", "match", F.explode(name_segments(F.col("_cn"), d)).alias("_k")).checkpoint()
    ts = titles.where(F.length("_tn") > 0).select("_tn", F.explode(title_segments(F.col("_tn"), d)).alias("_k")).checkpoint()
    often = cs.groupBy("_k").count().where(F.col("count") > hot).select("_k").hint("merge")
    plain = ts.join(cs.join(often, "_k", "left_anti").hint("merge"), "_k").select("_tn", "_cn", "match")
    rest_names = (cs.join(often, "_k", "left_semi").select("_cn", "match").distinct()
                  .unionByName(names.where(F.length("_cn") <= d))).checkpoint()
    rest_titles = (ts.join(often, "_k", "left_semi").select("_tn")
                   .unionByName(titles.where(F.length("_tn") <= 2 * d).select("_tn")).distinct()).checkpoint()

    def variants(c: str) -> Column:
        return F.explode(F.transform(deletion_variants(F.col(c), d), lambda v: F.xxhash64(v))).alias("_v")

    tv = spread(rest_titles, "_tn").select("_tn", variants("_tn"))
    cv = spread(rest_names, "_cn").select("_cn", "match", variants("_cn"))
    return plain.unionByName(tv.join(cv.hint("merge"), "_v").select("_tn", "_cn", "match"))


def match_names(titles: DataFrame, catalog: DataFrame, max_distance: int = 2,
                title_col: str = "title", name_col: str = "name", hot: int = HOT_SEGMENT) -> DataFrame:
    """Best catalog name per title (left outer, top-1), else 'No subreddit found'.

    Titles and names are normalised (X8); null titles and names match nothing.  A title that
    equals a name takes it by an equi-join; the others look for names one edit away, then those still
    without a name two edits away and so on, as a nearer name always wins.  They meet their candidates by shared segments
    (``name_candidates``), so the candidate set is exact without comparing all pairs; each candidate is
    verified with ``levenshtein`` and the best (distance, name) wins.
    """
    t = titles.withColumn("_tn", X.normalize_title(F.col(title_col)))
    # names and titles are read by the segments, the variants and the equi-joins: written once
    c = (catalog.select(F.col(name_col).alias("match"), X.normalize_title(F.col(name_col)).alias("_cn"))
         .where(F.col("_cn") != "").groupBy("_cn").agg(F.min("match").alias("match")).checkpoint())
    asked = (t.select("_tn").where(F.col("_tn").isNotNull()).distinct()
             .join(c.withColumnRenamed("_cn", "_tn").hint("merge"), "_tn", "left").checkpoint())
    best = asked.where(F.col("match").isNotNull()).select("_tn", F.struct(F.lit(0).alias("_dist"), "match").alias("_b"))
    open_, names = asked.where(F.col("match").isNull()).select("_tn"), spread(c, "_cn")
    for d in range(1, max_distance + 1):
        near = (name_candidates(spread(open_, "_tn"), names, d, hot)
                .withColumn("_dist", F.levenshtein("_tn", "_cn", d)).where(F.col("_dist") >= 0)
                .groupBy("_tn").agg(F.min(F.struct("_dist", "match")).alias("_b")).checkpoint())
        best = best.unionByName(near)
        open_ = open_.join(near.hint("merge"), "_tn", "left_anti")
    out = t.join(best.hint("merge"), "_tn", "left")
    return out.select(*[F.col(n) for n in titles.columns], F.col("_b.match").alias("match"),
                      F.col("_b._dist").cast("int").alias("distance"))


def render_mapping(matched: DataFrame, title_col: str = "title") -> Column:
    """S11: 'title: r/name' or 'title: No subreddit found'."""
    return F.when(F.col("match").isNotNull(),
                  F.concat(F.col(title_col), F.lit(": r/"), F.col("match"))) \
        .otherwise(F.concat(F.col(title_col), F.lit(": " + rules.NO_FORUM)))


def extract_forums(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines holding 'r/' -> the text after the last 'r/', stripped."""
    return lines.where(F.col(line_col).contains("r/")).withColumn(
        "forum", X.strip(F.substring_index(F.col(line_col), "r/", -1)))


def gazetteer_hits(df: DataFrame, id_col: str, text, entries: DataFrame, first_word_limit: int = FIRST_WORD_LIMIT) -> DataFrame:
    """(id, _i, _n, and the other columns of ``entries``): where the words ``_gt`` of an entry occur in a row in the text.

    Text and names are cut by the same tokenizer (runs of letters and digits), so marks inside names do not matter;
    n-grams of exactly the lengths that the entries have are equi-joined with them (shuffle on the n-gram), so they
    never have to fit in memory.  Only places whose word starts some entry are cut into n-grams as long as there are at
    most ``first_word_limit`` first words; beyond it every place is, inside its row, so that no shuffle carries a text.
    """
    toks = df.select(id_col, X.tokenize(text, clean=False).alias("_t"))
    firsts = entries.groupBy(F.col("_gt")[0].alias("_w")).agg(F.collect_set(F.size("_gt")).alias("_lens"))
    if firsts.limit(first_word_limit + 1).count() <= first_word_limit:
        pos = toks.select(id_col, "_t", F.posexplode("_t").alias("_i", "_w")).join(F.broadcast(firsts), "_w")
        places = pos.select(id_col, "_t", "_i", F.explode("_lens").alias("_n"))
    else:
        lens = [r._n for r in entries.select(F.size("_gt").alias("_n")).distinct().collect()]  # lengths, not entries
        every = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(lens)]), lambda n: F.transform(
            F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.struct(i.alias("_i"), n.alias("_n")))))
        places = toks.where(F.size("_t") > 0).select(id_col, "_t", F.explode(every).alias("_p")).select(id_col, "_t", "_p._i", "_p._n")
    grams = (places.where(F.col("_i") + F.col("_n") <= F.size("_t"))
             .select(id_col, "_i", "_n", F.array_join(F.expr("slice(_t, _i + 1, _n)"), " ").alias("_g")))
    return grams.join(entries.withColumn("_g", F.array_join("_gt", " ")).drop("_gt"), "_g").drop("_g")


def entity_mentions(df: DataFrame, id_col: str, text, gazetteer: DataFrame,
                    name_col: str = "name", first_word_limit: int = FIRST_WORD_LIMIT) -> DataFrame:
    """M8: distinct gazetteer entries (lower-cased) whose words occur in a row in the text (``gazetteer_hits``)."""
    entries = (gazetteer.select(F.lower(F.col(name_col)).alias("_name"), X.tokenize(name_col, clean=False).alias("_gt"))
               .where(F.size("_gt") > 0).distinct().checkpoint())
    hits = gazetteer_hits(df, id_col, text, entries, first_word_limit)
    # collect_set de-duplicates per text (partial aggregation before the shuffle)
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_set("_name")).alias("mentions"))


def typed_mentions(df: DataFrame, id_col: str, text, gazetteer: DataFrame, kept_types=None, name_col: str = "name",
                   type_col: str = "type", first_word_limit: int = FIRST_WORD_LIMIT) -> DataFrame:
    """M8 with kinds: (id, place, n_words, mention, type) of the mentions of the ``kept_types`` (None: all).

    Mentions do not overlap: of the entries of any type the one that begins first is taken, of those the longest, then
    the next that begins behind it.  The kept types are chosen after that, as a tagger's labels are, so a
    product inside a longer name of another type is no mention.  ``place`` counts words from 0.  Entries of equal
    words are all returned (lower-cased, distinct); null names, types and texts give none.  ``id_col`` names the text.
    """
    entries = (gazetteer.where(F.col(type_col).isNotNull())
               .select(X.tokenize(name_col, clean=False).alias("_gt"), F.struct(F.lower(F.col(name_col)).alias("mention"),
                                                                                F.col(type_col).alias("type")).alias("_e"))
               .where(F.size("_gt") > 0).groupBy("_gt").agg(F.collect_set("_e").alias("_es")).checkpoint())
    hits = gazetteer_hits(df, id_col, text, entries, first_word_limit)
    longest = hits.groupBy(id_col, "_i").agg(F.max("_n").alias("_n"), F.max_by("_es", "_n").alias("_es"))
    # Runs of overlapping spans are settled one by one, so a long text is no long fold.
    before = Window.partitionBy(id_col).orderBy("_i")
    ends = F.max(F.col("_i") + F.col("_n")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = (longest.withColumn("_new", (F.coalesce(ends, F.lit(0)) <= F.col("_i")).cast("int"))
            .withColumn("_run", F.sum("_new").over(before))
            .groupBy(id_col, "_run").agg(F.sort_array(F.collect_list(F.struct("_i", "_n", "_es"))).alias("_spans")))
    kind = dict(runs.dtypes)["_spans"]
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("taken"))
    taken = F.aggregate("_spans", start, lambda s, x: F.when(x["_i"] >= s["end"], F.struct(
        (x["_i"] + x["_n"]).alias("end"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s))["taken"]
    out = (runs.select(id_col, F.explode(taken).alias("_s"))
           .select(id_col, F.col("_s._i").alias("place"), F.col("_s._n").alias("n_words"), F.explode("_s._es").alias("_e"))
           .select(id_col, "place", "n_words", "_e.mention", "_e.type"))
    return out if kept_types is None else out.where(F.col("type").isin(*kept_types))
