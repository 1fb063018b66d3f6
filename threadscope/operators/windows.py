"""Skew-safe positional windows (W6) and per-group top-k.

A plain ``row_number().over(partitionBy(key))`` sends every row of a key to
one task, so a key holding a third of the data becomes one giant task.
``prefix_sums`` splits each key into fixed-width buckets of its order
column: bucket totals are a small pre-aggregated table, their running
offsets are a window over ``rows / bucket_width`` rows per key, and the
per-row running sums are a window over (key, bucket) groups that hold at
most ``bucket_width`` order values each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_WIDTH = 4096


def prefix_sums(df: DataFrame, keys, order_col: str, values: dict[str, Column],
                inclusive: bool = False, totals: bool = False,
                bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Running sums of each ``values[name]`` within ``keys`` in ``order_col`` order.

    ``order_col`` must be integral and unique within ``keys``.  Sums are
    exclusive (strictly earlier rows) unless ``inclusive``.  With ``totals``
    the whole-key sum is added as ``<name>_total``.
    """
    keys = list(keys)
    names = list(values)
    d = df.withColumn("_pb", F.floor(F.col(order_col) / F.lit(bucket_width)).cast("long"))
    for n in names:
        d = d.withColumn(f"_pv_{n}", values[n])
    tot = d.groupBy(*keys, "_pb").agg(*[F.sum(f"_pv_{n}").alias(f"_pt_{n}") for n in names])
    wb = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_pt_{n}").over(wb), F.lit(0)).alias(f"_po_{n}") for n in names]
    if totals:
        wa = Window.partitionBy(*keys)
        cols += [F.sum(f"_pt_{n}").over(wa).cast("long").alias(f"{n}_total") for n in names]
    offs = tot.select(*keys, "_pb", *cols)
    end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy(*keys, "_pb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    out = d.join(offs, keys + ["_pb"], "inner")
    for n in names:
        out = out.withColumn(n, (F.col(f"_po_{n}") + F.coalesce(F.sum(f"_pv_{n}").over(wi), F.lit(0)))
                             .cast("long"))
    return out.drop("_pb", *[f"_pv_{n}" for n in names], *[f"_po_{n}" for n in names])


def prefix_sum(df: DataFrame, keys, order_col: str, value: Column, out_col: str,
               inclusive: bool = False, bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    return prefix_sums(df, keys, order_col, {out_col: value}, inclusive, False, bucket_width)


def dense_index(df: DataFrame, keys, order_col: str, out_col: str = "idx",
                bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """0-based position within ``keys`` by ``order_col`` (skew-safe)."""
    return prefix_sum(df, keys, order_col, F.lit(1), out_col, False, bucket_width)


def top_k(df: DataFrame, keys, order, k: int, rank_col: str | None = None) -> DataFrame:
    """At most ``k`` rows per key in ``order`` (a total order, ties broken by id).

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before
    the shuffle, so each map task ships at most ``k`` rows per key and a
    hot key cannot flood one reducer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rc = rank_col or "_rk"
    out = df.withColumn(rc, F.row_number().over(w)).where(F.col(rc) <= k)
    return out if rank_col else out.drop(rc)
