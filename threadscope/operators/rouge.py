"""ROUGE-1 / ROUGE-2 (n-gram counts, joins) and ROUGE-L (LCS)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def _side_grams(tok_col: str, side: int, n: int):
    """The n-grams of one token list as (side, n, gram) structs."""
    tok = F.coalesce(tok_col, F.array().cast("array<string>"))
    starts = F.slice(tok, F.lit(1), F.greatest(F.size(tok) - (n - 1), F.lit(0)))
    gram = (lambda w, i: w) if n == 1 else (lambda w, i: F.array_join(F.slice(tok, i + 1, F.lit(n)), " "))
    return F.transform(starts, lambda w, i: F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), gram(w, i).alias("g")))


def _grams(d: DataFrame, id_col: str, ns) -> DataFrame:
    """One tagged table of the grams of both sides, counted: (id, n, g, cc, rc).  A row n = 0 keeps pairs without any gram."""
    none = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("n"), F.lit("").alias("g")))
    sides = [_side_grams(c, side, n) for side, c in enumerate(("_ct", "_rt")) for n in ns]
    rows = d.select(id_col, F.inline(F.concat(none, *sides)))
    return rows.groupBy(id_col, "n", "g").agg(F.count_if(F.col("side") == 0).alias("cc"), F.count_if(F.col("side") == 1).alias("rc"))


def _tokens(pairs: DataFrame, id_col: str, cand: str, ref: str) -> DataFrame:
    return pairs.select(id_col, X.tokenize(cand, clean=False).alias("_ct"),
                        X.tokenize(ref, clean=False).alias("_rt"))


def rouge_n(pairs: DataFrame, id_col: str, cand: str, ref: str, ns=(1, 2),
            tokens: DataFrame | None = None) -> DataFrame:
    """Clipped n-gram overlap per pair for every n in ``ns``: precision,
    recall, F (0 when empty).  One tagged gram table of both sides and two sums:
    by (pair, n, gram), then by pair; ids must be unique."""
    d = tokens if tokens is not None else _tokens(pairs, id_col, cand, ref)
    sums = _grams(d, id_col, ns).groupBy(id_col).agg(*[
        F.sum(F.when(F.col("n") == n, value)).alias(f"_{name}{n}")
        for n in ns for name, value in (("ov", F.least("cc", "rc")), ("nc", F.col("cc")), ("nr", F.col("rc")))])
    cols = [id_col]
    for n in ns:
        p = F.coalesce(F.try_divide(F.col(f"_ov{n}"), F.col(f"_nc{n}")), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.col(f"_ov{n}"), F.col(f"_nr{n}")), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        cols += [x.alias(f"rouge{n}_{k}") for k, x in zip("prf", (p, r, f))]
    return sums.select(*cols)


def lcs_length(a, b) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro), O(len(b) * len(a) / 64)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, id_col: str, cand: str, ref: str,
            tokens: DataFrame | None = None) -> DataFrame:
    """ROUGE-L from the LCS of the whole token lists (Arrow-batched UDF;
    each pair is one row, so work spreads over all tasks)."""
    d = tokens if tokens is not None else _tokens(pairs, id_col, cand, ref)
    d = d.withColumn("lcs", _lcs_udf("_ct", "_rt"))
    p = F.coalesce(F.try_divide(F.col("lcs"), F.size("_ct")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("lcs"), F.size("_rt")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return d.select(id_col, "lcs", p.alias("rougeL_p"), r.alias("rougeL_r"), f.alias("rougeL_f"))


def rouge(pairs: DataFrame, id_col: str, cand: str, ref: str, with_l: bool = True,
          materialize: bool = True) -> DataFrame:
    """ROUGE-1, ROUGE-2 and (optionally) ROUGE-L per pair.

    The token table feeds several branches; with ``materialize`` it is
    checkpointed once (reliable checkpoint in the shared folder) instead of
    re-running the plan that produced the pairs for every branch.
    """
    d = _tokens(pairs, id_col, cand, ref)
    if materialize:
        d = d.checkpoint()
    out = rouge_n(pairs, id_col, cand, ref, (1, 2), tokens=d)
    if with_l:
        out = out.join(rouge_l(pairs, id_col, cand, ref, tokens=d), id_col)
    return out
