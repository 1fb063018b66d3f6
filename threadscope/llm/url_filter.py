"""URL filter by a character language-model ratio, with DataFrame functions only.

Rules of (host, path) prefixes judge the urls they fit; the longest wins.  The urls
they judge are the examples of accepted and rejected ones: each kind trains a
Markov model over characters that uses as much of the two characters before as
it has seen (Witten-Bell smoothing from order 2 down to order 0).  A url is scored
by the difference of the models' log-likelihoods a character, and the cut
between the kinds is calibrated on a quarter of the examples (by a hash of the url)
that the models have not seen.

Characters fall into 32 symbols, so a model has at most 32^3 entries whatever the
corpus and is broadcast; urls are expanded into positions and summed up again
without a shuffle of positions.

Defined results: null urls and urls without ``://`` have an empty host and path; what
no rule fits and no model can score (an empty string, or no examples of one
kind) is allowed; repeated urls count once as examples and get one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 32
#: First hex digits of md5(url) that make up the calibration quarter.
HELD_OUT = "cdef"
#: Calibration looks at cuts this far apart.
CUT_STEP = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_fits(host: str, path: str, rule_host: str, rule_path: str) -> Column:
    h = F.col(host)
    return ((h == rule_host) | h.endswith("." + rule_host)) & F.col(path).startswith(rule_path)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Append ``rule`` and ``rule_verdict`` (null where none fits)."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = rule_fits("host", "path", host, path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def symbols(host: str, path: str) -> Column:
    """The text that the models see: a-z, 0 for digits, . / - and _ for the rest."""
    text = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(text, "[^a-z0./-]", "_")


def grams(urls: DataFrame) -> DataFrame:
    """One row a character: it with the two before (^ before the start)."""
    return (urls.where(F.length("symbols") > 0)
            .withColumn("i", F.explode(F.sequence(F.lit(1), F.length("symbols"))))
            .withColumn("gram", F.substr(F.concat(F.lit("^^"), "symbols"), F.col("i"), F.lit(3))).drop("i"))


def model(counts: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, block, allow): at most SYMBOLS ** 3 rows."""
    df = (counts.withColumn("c", F.substring("gram", 3, 1)).withColumn("bc", F.substring("gram", 2, 2))
          .withColumn("b", F.substring("gram", 2, 1)).withColumn("ab", F.substring("gram", 1, 2)))
    everything = Window.partitionBy(F.lit(1))
    for k in ("block", "allow"):
        n = F.col(k)
        df = (df.withColumn("p1", (F.sum(n).over(Window.partitionBy("c")) + 1) / (F.sum(n).over(everything) + SYMBOLS))
              .withColumn("n2", F.sum(n).over(Window.partitionBy("bc")))
              .withColumn("n1", F.sum(n).over(Window.partitionBy("b")))
              .withColumn("t1", F.size(F.collect_set(F.when(F.col("n2") > 0, F.col("bc"))).over(Window.partitionBy("b"))))
              .withColumn("p2", F.when(F.col("n1") > 0, (F.col("n2") + F.col("t1") * F.col("p1")) / (F.col("n1") + F.col("t1")))
                          .otherwise(F.col("p1")))
              .withColumn("m", F.sum(n).over(Window.partitionBy("ab")))
              .withColumn("t2", F.sum((n > 0).cast("int")).over(Window.partitionBy("ab")))
              .withColumn(f"p_{k}", F.when(F.col("m") > 0, (n + F.col("t2") * F.col("p2")) / (F.col("m") + F.col("t2")))
                          .otherwise(F.col("p2"))))
    return df.select("gram", (F.log("p_block") - F.log("p_allow")).alias("ratio"))


def scored(urls: DataFrame) -> DataFrame:
    """(url, rule_verdict, score) of distinct urls that have symbols."""
    part = (~F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)).cast("int")
    counts = grams(urls.withColumn("train", part)).groupBy("gram").agg(
        *[F.sum((F.col("rule_verdict").eqNullSafe(k)).cast("long") * F.col("train")).alias(k) for k in ("block", "allow")])
    return (grams(urls).join(F.broadcast(model(counts)), "gram")
            .groupBy("url", "rule_verdict").agg(F.round(F.avg("ratio"), 6).alias("score")))


def calibrated_cut(scores: DataFrame) -> DataFrame:
    """One row: the score from which on urls are blocked (null: nothing to go by)."""
    held = scores.where(F.col("rule_verdict").isNotNull() & F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT))
    bins = held.groupBy(F.floor(F.col("score") / CUT_STEP).alias("bin")).agg(
        *[F.sum((F.col("rule_verdict") == k).cast("long")).alias(k) for k in ("block", "allow")])  # a row a cut
    below = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    gain = (F.col("allow_below") / F.col("all_allow")) - (F.col("block_below") / F.col("all_block"))
    cuts = (bins.withColumns({f"{k}_below": F.coalesce(F.sum(k).over(below), F.lit(0)) for k in ("block", "allow")}
                             | {f"all_{k}": F.sum(k).over(everything) for k in ("block", "allow")}
                            | {"last": F.lag("bin").over(Window.partitionBy(F.lit(1)).orderBy("bin"))})
            .where((F.col("all_block") > 0) & (F.col("all_allow") > 0)).withColumn("gain", F.round(gain, 9)))
    middle = (F.col("bin") + F.coalesce(F.col("last") + 1, F.col("bin"))) / 2 * CUT_STEP  # of the gap below the bin
    return cuts.agg(F.min_by(middle, F.struct(-F.col("gain"), "bin")).alias("cut"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Append host, path, rule, score and verdict (allow or block); columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = host_and_path(F.col(url_col))
    rows = with_rule(pages.select(*kept, host.alias("host"), path.alias("path")), rules)
    urls = (rows.where(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url"))
            .agg(F.first("rule_verdict").alias("rule_verdict"), F.first(symbols("host", "path")).alias("symbols")))
    scores = scored(urls)
    cut = calibrated_cut(scores).withColumn("__one", F.lit(1))
    verdicts = (scores.withColumn("__one", F.lit(1)).join(F.broadcast(cut), "__one")  # one row
                .select(F.col("url").alias("__url"), "score", (F.col("score") >= F.col("cut")).alias("__block")))
    out = rows.join(verdicts, rows[url_col] == F.col("__url"), "left")
    by_model = F.when(F.col("__block"), "block").otherwise("allow")
    return out.select(*kept, "host", "path", "rule", "score", F.coalesce("rule_verdict", by_model).alias("verdict"))
