"""Quality rules: robust multivariate outliers within a language and source.

Every text gets a vector of transformed statistics.  For each (lang, source)
group the minimum-covariance-determinant estimate of centre and scatter is found
by concentration steps: the share ``support`` of the group's rows with the least
Mahalanobis distance gives the next centre and scatter, until the determinant
no longer falls.  The steps start from medians with two deterministic scatters
(squared MADs, and the scatter of spatial signs), and the start that ends with the
smaller determinant wins.  Rows whose distance exceeds the chi-square quantile are
rejected.

A group of fewer than ``FULL`` rows says little about itself (a lone row is its own
centre), so its centre and scatter are drawn towards its language's, and a
language's of so few rows towards the corpus's: n / FULL of its own, the rest from
above.  All three levels are fitted in the same steps.

Spark runs each step as one aggregation of moments over all rows, and the
quantiles as counts over fixed bins, so a group that holds a third of all
rows is combined map-side and never gathered.  Groups may be as many as there are
sources: their estimates are joined as a table, not collected.

Defined results: null and empty texts have zero statistics and fail the base
rules; null lang or source forms a group of its own; statistics that do not vary
in a group count with the floor ``FLOORS``, as does a corpus too small to have a
scatter; repeated rows are judged alike; clashing columns are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialize

SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more in the text (the first included)."""
    n = len(words)
    if n <= window:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    # names of 1, 2, 4, ... words: a pair of names is one number, so equal names mean equal words
    span = 1
    while span < window:
        step = min(span, window - span)
        left, right = ids[:len(ids) - step], ids[step:]
        _, ids = np.unique(left * np.int64(n) + right, return_inverse=True)
        span += step
    counts = np.bincount(ids)
    if counts.max() < 2:
        return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), len(SYMBOLS.findall(text)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by its statistics (long columns STATS)."""
    kept = [c for c in df.columns if c != text_col and c not in STATS]
    src = df.select(*kept, F.col(text_col).alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches):
        for batch in batches:
            found = [text_stats(t.as_py()) for t in batch.column(len(kept))]
            columns = np.array(found, dtype=np.int64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                                             names=[*kept, *STATS])

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return (n < 20) | (100 * rep > 30 * n)


# -- minimum covariance determinant -------------------------------------------

#: The vector: log mean word length, symbol rate, share of repeated lines, share of
#: repeated words; short texts are drawn towards the middle by a few pseudo-counts.
VECTOR = {
    "x1": lambda: F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
    "x2": lambda: F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 50)),
    "x3": lambda: F.col("n_dup_lines") / (F.col("n_lines") + 2),
    "x4": lambda: F.col("n_repeat_words") / (F.col("n_words") + 30),
}
#: Least standard deviation that each coordinate counts with.
FLOORS = (0.03, 0.05, 0.06, 0.08)
#: Coordinates are rounded to this share of their floor, so that equal cells are counted together.
STEP = 1 / 16
#: Share of rows behind the estimate, and the factor that makes its scatter consistent for four normal coordinates.
SUPPORT, CONSISTENCY = 0.75, 1.486
#: Chi-square quantile (4 degrees of freedom) at 1 - 1e-5.
CUT = 28.47
#: Rows from which on a group's estimate stands alone.
FULL = 50
#: Distances are counted in bins of 1/32 of their logarithm, up to the last.
BINS, BIN_WIDTH, SALTS, MAX_STEPS = 640, 32, 16, 100

P = len(VECTOR)
#: Entries of a symmetric matrix, as (row, column) with row >= column.
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def cells(stats: DataFrame) -> DataFrame:
    """Rounded vectors of the rows that pass the base rules, counted by group."""
    x = [(F.round(v() / (f * STEP)) * (f * STEP)).alias(k) for (k, v), f in zip(VECTOR.items(), FLOORS)]
    return (stats.where(~base_failed()).select(group_key(), *x)
            .groupBy("g", *VECTOR).agg(F.count("*").alias("n")))


def group_key() -> Column:
    return F.to_json(F.struct("lang", "source")).alias("g")


def language_key(group: str = "g") -> Column:
    """The key of a group's language."""
    lang = F.get_json_object(group, "$.lang")
    return F.coalesce(F.concat(F.lit("language "), lang), F.lit("null language"))


CORPUS = "corpus"


def all_levels(cell: DataFrame) -> DataFrame:
    """The cells of groups, and those of languages and of the corpus, counted anew."""
    upper = cell.withColumn("g", F.explode(F.array(language_key(), F.lit(CORPUS)))).groupBy("g", *VECTOR).agg(F.sum("n").alias("n"))
    return cell.select("g", *VECTOR, "n").unionByName(upper)


def salted(params: DataFrame) -> DataFrame:
    return params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def plus(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def distance() -> Column:
    """Squared Mahalanobis distance: length of the vector under the inverse Cholesky factor."""
    return plus([F.pow(plus([F.col(f"w{i}{j}") * (F.col(f"x{j + 1}") - F.col(f"m{j}")) for j in range(i + 1)]), 2)
                 for i in range(P)])


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Join rows with their group's estimates; each group is dealt over SALTS keys."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")).join(
        salted(params), ["g", "__salt"])


def moments(weight: Column) -> list[Column]:
    x = [F.col(k) for k in VECTOR]
    return ([F.sum(weight).alias("s")] + [F.sum(weight * c).alias(f"s{i}") for i, c in enumerate(x)]
            + [F.sum(weight * x[i] * x[j]).alias(f"s{i}{j}") for i, j in LOWER])


def estimates(df: DataFrame) -> DataFrame:
    """(g, start, centre m, scatter c, inverse Cholesky factor w, logdet) from g, start, m and a positive scatter c."""
    def column(i: int, j: int) -> Column:
        rest = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        return F.col(f"c{i}{j}") - plus(rest) if rest else F.col(f"c{i}{j}")

    for j in range(P):
        df = df.withColumn(f"l{j}{j}", F.sqrt(column(j, j)))
        df = df.withColumns({f"l{i}{j}": column(i, j) / F.col(f"l{j}{j}") for i in range(j + 1, P)}) if j + 1 < P else df
    df = df.withColumns({f"w{i}{i}": 1 / F.col(f"l{i}{i}") for i in range(P)})
    for off in range(1, P):
        df = df.withColumns({f"w{j + off}{j}": -plus([F.col(f"l{j + off}{k}") * F.col(f"w{k}{j}") for k in range(j, j + off)])
                             / F.col(f"l{j + off}{j + off}") for j in range(P - off)})
    return df.select("g", "start", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in LOWER],
                     *[f"w{i}{j}" for i, j in LOWER], plus([2 * F.log(f"l{i}{i}") for i in range(P)]).alias("logdet"))


def concentrated(binned: DataFrame) -> DataFrame:
    """Estimates of the SUPPORT share of nearest rows, from moments by (g, start, bin)."""
    each = Window.partitionBy("g", "start")  # at most BINS + 1 rows
    near = (binned.withColumn("before", F.sum("s").over(each.orderBy("bin")) - F.col("s"))
            .withColumn("total", F.sum("s").over(each)).where(F.col("before") < SUPPORT * F.col("total")))
    names = ["s", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in LOWER]]
    sums = near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in names])
    centre = {f"m{i}": F.col(f"s{i}") / F.col("s") for i in range(P)}
    scatter = {f"c{i}{j}": CONSISTENCY * (F.col(f"s{i}{j}") / F.col("s") - F.col(f"m{i}") * F.col(f"m{j}"))
               + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in LOWER}
    return estimates(sums.withColumns(centre).withColumns(scatter))


def first_estimates(cell: DataFrame) -> DataFrame:
    """Two starts a group around the coordinates' medians."""
    xs = list(VECTOR)
    mid = cell.groupBy("g").agg(*[F.expr(f"percentile({x}, 0.5, n)").alias(f"c_{x}") for x in xs])
    around = cell.withColumn("__salt", F.pmod(F.xxhash64(*cell.columns), F.lit(SALTS)).cast("int")).join(
        salted(mid), ["g", "__salt"])
    unit = [(F.col(x) - F.col(f"c_{x}")) / f for x, f in zip(xs, FLOORS)]
    norm = F.sqrt(sum((u * u for u in unit[1:]), unit[0] * unit[0]))
    away = around.select("g", "n", *[f"c_{x}" for x in xs],
                         *[F.abs(u).alias(f"a{i}") for i, u in enumerate(unit)],
                         *[F.when(norm > 0, u / norm).otherwise(0.0).alias(f"u{i}") for i, u in enumerate(unit)])
    spread = away.groupBy("g", *[f"c_{x}" for x in xs]).agg(
        *[F.expr(f"percentile(a{i}, 0.5, n)").alias(f"d{i}") for i in range(P)],
        *[(F.sum(F.col("n") * F.col(f"u{i}") * F.col(f"u{j}")) / F.sum("n")).alias(f"v{i}{j}") for i, j in LOWER])
    spread = spread.withColumns({f"m{i}": F.col(f"c_{x}") for i, x in enumerate(xs)})
    by_mad = {f"c{i}{j}": F.pow(FLOORS[i] * (1 + 1.4826 * F.col(f"d{i}")), 2) if i == j else F.lit(0.0) for i, j in LOWER}
    by_sign = {f"c{i}{j}": FLOORS[i] * FLOORS[j] * (F.col(f"v{i}{j}") + (0.05 if i == j else 0.0)) for i, j in LOWER}
    return (estimates(spread.withColumn("start", F.lit(0)).withColumns(by_mad))
            .unionByName(estimates(spread.withColumn("start", F.lit(1)).withColumns(by_sign))))


def fit_mcd(stats: DataFrame) -> DataFrame:
    """Centre and inverse scatter of every (lang, source) group that has rows to fit, small groups drawn towards their language."""
    groups = materialize(cells(stats), "mcd-cells")
    cell = materialize(all_levels(groups), "mcd-levels")
    params = materialize(first_estimates(cell), "mcd")
    for step in range(MAX_STEPS):
        d = with_params(cell, params).withColumn(
            "bin", F.least(F.lit(BINS), F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * BIN_WIDTH)).cast("int"))
        new = materialize(concentrated(d.groupBy("g", "start", "bin").agg(*moments(F.col("n")))), "mcd")
        # the first estimates' determinants are not comparable with those of subsets
        moved = new.join(params.select("g", "start", F.col("logdet").alias("before")), ["g", "start"]).where(
            F.abs(F.col("logdet") - F.col("before")) > 1e-6).limit(1).count() if step else 1
        params = new
        if not moved:
            break
    rank = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))  # two rows a group
    best = params.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")
    return drawn(materialize(best.join(cell.groupBy("g").agg(F.sum("n").alias("size")), "g"), "mcd-best"),
                 groups.select("g").distinct())


def drawn(best: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates of the groups, each mixed with its language's, that with the corpus's, by their numbers of rows."""
    names = [*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in LOWER]]

    def mixed(rows: DataFrame, above: DataFrame) -> DataFrame:
        """``rows`` (g, size, up, names) with the estimates of their ``up`` in ``above``; one row a group and level."""
        own = F.least(F.lit(1.0), F.col("size") / FULL)
        joined = rows.join(above.select(F.col("g").alias("up"), *[F.col(x).alias(f"up_{x}") for x in names]), "up")
        return joined.select("g", *[(own * F.col(x) + (1 - own) * F.col(f"up_{x}")).alias(x) for x in names])

    level = best.select("g", "size", *names)
    corpus = level.where(F.col("g") == CORPUS)
    languages = mixed(level.join(groups.select(language_key().alias("g")).distinct(), "g").withColumn("up", F.lit(CORPUS)), corpus)
    result = mixed(level.join(groups, "g").withColumn("up", language_key()), languages)
    return estimates(result.withColumn("start", F.lit(0))).drop("start", *[x for x in names if x.startswith("c")])


def judge(stats: DataFrame) -> DataFrame:
    """Append ``base_failed``, ``distance`` (squared Mahalanobis; null where the
    group has nothing to fit) and ``kept`` to a written table of statistics
    that has lang and source."""
    df = stats.drop("base_failed", "distance", "kept")
    best = fit_mcd(df)
    rows = df.select(group_key(), *[v().alias(k) for k, v in VECTOR.items()], F.struct(*df.columns).alias("__row"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.to_json("__row")), F.lit(SALTS)).cast("int"))
    out = rows.join(salted(best), ["g", "__salt"], "left").withColumn("distance", distance())
    ok = ~base_failed() & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return (out.select("__row.*", "distance")
            .select(*df.columns, base_failed().alias("base_failed"), "distance", ok.alias("kept")))


def assess(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics and verdict of every document (without its text)."""
    cols = list(dict.fromkeys([*keep, "lang", "source"]))
    stats = materialize(with_stats(docs.select(*cols, text_col), text_col), "quality")
    return judge(stats)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns unchanged; the verdict follows a
    hash of the row, so repeated ids do not meet."""
    row = docs.withColumn("__k1", F.xxhash64(*docs.columns)).withColumn("__k2", F.xxhash64(F.lit(7919), *docs.columns))
    verdict = assess(row, keep=("__k1", "__k2")).where("kept").select("__k1", "__k2").distinct()
    return row.join(verdict, ["__k1", "__k2"], "left_semi").select(*docs.columns)
