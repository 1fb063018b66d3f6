"""Packing by cutting-stock column generation.

Documents are cut into full pieces of ``capacity`` tokens and one remainder.
The histogram of piece lengths (a bounded number of cells, whatever the corpus)
is the demand of a cutting-stock problem: a linear program over patterns, whose
columns are priced by knapsack dynamic programming over exact fills.  The
solution is rounded down, the left-over demand (bounded by the number of
patterns in the basis, not by the corpus) is filled piece by piece, and every
piece finds its place from its rank among the pieces of its cell.

Only the histogram and the patterns pass through the driver.  Ranks are counted
within hash buckets of a length and shifted by the buckets' totals, so a length
that a third of all documents share is dealt out over many tasks.

Defined results: null and empty texts are a lone end-of-text id; repeated rows
are packed as separate documents; an empty table gives no pieces; columns of the
input that clash with the columns added here are replaced.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .base import materialize

BUCKETS = 64
#: The linear program ends when its value is within this share of the dual bound.
GAP = 1e-3
#: Lengths of one histogram cell.
GRAIN = 4


# -- tokens and pieces -------------------------------------------------------

@functools.lru_cache(maxsize=4)
def fast_coder(path: str):
    """A compiled coder over the same vocabulary file: (coder, its special strings)."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = bpe.byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens=special), special


def token_ids(text: str | None, coder, special) -> list[int]:
    if not text:
        return []
    if any(s in text for s in special):
        return coder.encode(text, allowed_special="all")
    return coder.encode_ordinary(text)


def pieces(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Cut each document's ids (with ``end_id`` after them) into pieces.

    One row a piece: the kept columns, ``start``, ``length``, ``doc_tokens`` and
    ``ids`` (little-endian unsigned 32-bit, the layout of token files)."""
    added = ["start", "length", "doc_tokens", "ids"]
    keep = [c for c in keep if c not in added]
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        coder, special = fast_coder(vocabulary)
        for batch in batches:
            rows, start, length, total, ids = [], [], [], [], []
            for r, text in enumerate(batch.column(len(keep)).to_pylist()):
                all_ids = token_ids(text, coder, special)
                all_ids.append(end_id)
                raw = np.array(all_ids, dtype="<u4").tobytes()
                n = len(all_ids)
                for a in range(0, n, capacity):
                    rows.append(r)
                    start.append(a)
                    length.append(min(capacity, n - a))
                    total.append(n)
                    ids.append(raw[4 * a:4 * (a + capacity)])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(len(keep))), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                names=[*keep, *added])

    return src.mapInArrow(run, schema)


# -- the cutting-stock problem, in cells of the length histogram ---------------

def best_fills(sizes: np.ndarray, values: np.ndarray, capacity: int):
    """Unbounded knapsack: for each exact fill, the largest value and the item that came last."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    last = np.full(capacity + 1, -1, dtype=np.int64)
    for s in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, s, side="right"))
        if k:
            gain = best[s - sizes[:k]] + values[:k]
            i = int(gain.argmax())
            best[s], last[s] = gain[i], i
    return best, last


def pattern_of(last: np.ndarray, sizes: np.ndarray, fill: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while fill > 0:
        i = int(last[fill])
        found[i] = found.get(i, 0) + 1
        fill -= int(sizes[i])
    return found


def solve_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP):
    """Columns and values of: least number of sequences, A.x = demand, x >= 0.

    Revised simplex with an explicit inverse.  The basis starts with one pattern
    a cell (as many copies as fit); knapsack values give the best pattern of each
    fill, and those that still price out enter one after another."""
    m = len(sizes)
    copies = capacity // sizes
    columns = [{i: int(copies[i])} for i in range(m)]
    inverse = np.diag(1.0 / copies)
    x = demand / copies
    while True:
        dual = inverse.sum(axis=0)
        best, last = best_fills(sizes, dual, capacity)
        top = float(best.max())
        value = float(x.sum())
        # Farley: duals divided by the best pattern's value are feasible; less than one sequence is lost to rounding anyway
        if top <= 1 + 1e-7 or value - float(dual @ demand) / top <= max(gap * value, 1.0):
            return columns, x
        entered = 0
        for fill in np.argsort(-best, kind="stable")[:16]:
            column = pattern_of(last, sizes, int(fill))
            at, count = np.fromiter(column.keys(), dtype=np.int64), np.fromiter(column.values(), dtype=float)
            if float(inverse[:, at].sum(axis=0) @ count) <= 1 + 1e-7:
                continue
            direction = inverse[:, at] @ count
            ok = direction > 1e-9
            if not ok.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[ok] = x[ok] / direction[ok]
            out = int(ratio.argmin())
            theta = float(ratio[out])
            x = np.maximum(x - theta * direction, 0.0)
            x[out] = theta
            pivot = inverse[out] / direction[out]
            inverse -= np.outer(direction, pivot)
            inverse[out] = pivot
            columns[out] = column
            entered += 1
        if not entered:
            return columns, x


def fill_left(sizes: list[int], left: list[int], capacity: int) -> list[dict[int, int]]:
    """Pack what rounding left over: the largest piece first, with the subset of
    the others that comes closest to a full sequence (reachable fills as bits)."""
    out, left = [], list(left)
    for top in range(len(sizes) - 1, -1, -1):
        while left[top]:
            left[top] -= 1
            room = capacity - sizes[top]
            reach, steps, mask = 1, [], (1 << (room + 1)) - 1
            for i in range(top, -1, -1):
                for _ in range(min(left[i], room // sizes[i])):
                    steps.append((i, reach))
                    reach = (reach | reach << sizes[i]) & mask
                    if reach >> room & 1:
                        break
                if reach >> room & 1:
                    break
            found, fill = {top: 1}, reach.bit_length() - 1
            for i, before in reversed(steps):
                if not before >> fill & 1:
                    found[i] = found.get(i, 0) + 1
                    left[i] -= 1
                    fill -= sizes[i]
            out.append(found)
    return out


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: pieces}, copies) that use up the histogram of sizes 1 to ``capacity`` exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(n)] for n in sizes], dtype=np.int64)
    columns, x = solve_lp(sizes, left.astype(float), capacity)
    plans = []
    for column, copies in zip(columns, np.floor(x + 1e-6).astype(np.int64)):
        copies = min([int(copies), *(int(left[i]) // k for i, k in column.items())])
        if copies > 0:
            plans.append((column, copies))
            for i, k in column.items():
                left[i] -= k * copies
    plans += [(p, 1) for p in fill_left(sizes.tolist(), left.tolist(), capacity)]
    return [({int(sizes[i]): k for i, k in sorted(p.items(), reverse=True)}, n) for p, n in plans]


def slots(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks: (size, first rank, end, first sequence, pieces in each)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, copies in plans:
        for size, k in pattern.items():
            first = used.get(size, 0)
            out.append((size, first, first + k * copies, sequence, k))
            used[size] = first + k * copies
        sequence += copies
    return out


# -- assignment ---------------------------------------------------------------

def ranked(df: DataFrame, key: str, rank_col: str, buckets: int = BUCKETS) -> DataFrame:
    """Number the rows of each key from 0, by hash buckets and their totals."""
    others = [c for c in df.columns if c != key]
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(*others), F.lit(buckets)).cast("int"))
    b = b.withColumn("__within", F.row_number().over(
        Window.partitionBy(key, "__bucket").orderBy(*[F.col(c) for c in others])))
    totals = (b.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(
                  Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # at most keys x buckets rows of four numbers, whatever the corpus
    return (b.join(F.broadcast(totals.drop("__n")), [key, "__bucket"])
            .withColumn(rank_col, F.col("__before") + F.col("__within") - 1)
            .drop("__bucket", "__within", "__before"))


def pack(pieces_df: DataFrame, length_col: str = "length", capacity: int = 1024, grain: int = GRAIN) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    A piece whose length is a power of two needs no padding and is a sequence of
    its own.  The others are packed by cells of ``grain`` lengths, rounded up, so
    a pattern's pieces always fit.  ``pieces_df`` should be a written table: it is
    read twice.  Rows that are equal in all columns may swap places."""
    spark = pieces_df.sparkSession
    df = pieces_df.drop("sequence_id", "offset")
    n = F.col(length_col)
    whole = n.bitwiseAND(n - 1) == 0
    df2 = df.withColumn("__size", F.when(whole, F.lit(0)).otherwise(F.ceil(n / grain)).cast("int"))
    histogram = {int(r[0]): int(r[1]) for r in df2.groupBy("__size").count().collect()}  # one row a cell
    alone = histogram.pop(0, 0)
    plans = [({0: 1}, alone)] if alone else []
    ranges = slots(plans + plan_patterns(histogram, capacity // grain))
    places = spark.createDataFrame(ranges, "__of int, __first long, __end long, __sequence long, __k long")
    # ranges: a pattern a cell and those of the left-over pieces, whatever the corpus
    out = ranked(df2, "__size", "__rank").join(
        F.broadcast(places), (F.col("__size") == F.col("__of")) & (F.col("__rank") >= F.col("__first"))
        & (F.col("__rank") < F.col("__end")))
    nth = F.col("__rank") - F.col("__first")
    out = out.withColumn("sequence_id", F.col("__sequence") + F.floor(nth / F.col("__k")).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("__size"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return (out.withColumn("offset", F.coalesce(F.sum(length_col).over(before), F.lit(0)).cast("long"))
            .select(*df.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = (pieces(docs, vocabulary, capacity=capacity)
           .withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(materialize(cut, "pieces"), capacity=capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
