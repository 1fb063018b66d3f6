"""Approximate nearest neighbours by an inverted multi-index (largest inner product).

Both halves of the vectors are quantised by codebooks of their own, fitted by
k-means on a bounded sample (FIT_SAMPLE rows, those with the least hash).  A
vector lies in the cell of its two nearest centroids.  A query walks through the
cells by the sum of its halves' inner products with the centroids, best first,
with a heap over the two sorted lists, until the cells hold ``visit`` vectors (each
cell counts with at most CELL_COUNT, so that one common vector does not end the
walk); every vector of the visited cells is ranked by its inner product in double
precision.

Every row is indexed.  Queries travel to the index: a query goes once to each row
of cells it visits, with the list of its cells there.  Both sides of a row of cells are
dealt into blocks, of about BLOCK vectors and of about QUERIES queries, and every two blocks
meet in a group of their own, so no task holds more than these, whatever the table's size or
a cell's share of it; each block returns its nearest ``k`` and these are merged.  Counts by cell
(at most CENTROIDS ** 2 rows) are all that the walk knows of the corpus.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors of another length than most, take no part; ties go to the
smaller id; equal ids are different candidates but never a query's own; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

CENTROIDS, FIT_SAMPLE, ROUNDS = 32, 20_000, 12
BLOCK, QUERIES, CELL_COUNT = 2048, 2048, 256
SHARE, VISIT = 0.5, 6000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd from rows that are far apart (deterministic)."""
    k = min(k, len(x))
    centres = [x[0]]
    least = ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[int(least.argmax())])
        least = np.minimum(least, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        for i in range(k):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(v.isNotNull() & ok)
    return rows


def fit(rows: DataFrame, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray] | None:
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(FIT_SAMPLE).select("v").toPandas()["v"]  # bounded
    if not len(sample):
        return None
    size = sample.map(len).mode().iloc[0]
    x = np.array([v for v in sample if len(v) == size], dtype=float)
    half = size // 2
    return kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)


def cells_of(v: pd.Series, books) -> pd.DataFrame:
    half = books[0].shape[1]
    x = np.stack(v.to_numpy()).astype(float)
    return pd.DataFrame({"c1": nearest(x[:, :half], books[0]), "c2": nearest(x[:, half:], books[1])})


def walk(q: np.ndarray, books, counts: dict[tuple[int, int], int], visit: int) -> list[tuple[int, int]]:
    """Cells by falling sum of inner products, until they hold ``visit`` vectors."""
    half = books[0].shape[1]
    s1, s2 = books[0] @ q[:half], books[1] @ q[half:]
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    heap, seen, held, out = [(-(s1[o1[0]] + s2[o2[0]]), 0, 0)], {(0, 0)}, 0, []
    while heap and held < visit:
        _, i, j = heapq.heappop(heap)
        cell = (int(o1[i]), int(o2[j]))
        if cell in counts:
            out.append(cell)
            held += min(counts[cell], CELL_COUNT)
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(s1[o1[a]] + s2[o2[b]]), a, b))
    return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def dealt(index: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and queries by (c1, block, part): each block of a row of cells once with each part of the queries that visit it."""
    blocks = index.groupBy("c1").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = walks.groupBy("c1").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    split = F.broadcast(blocks.join(parts, "c1"))  # at most one row a centroid
    left = (index.join(split, "c1").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts"))
    right = (walks.join(split, "c1").withColumn("part", F.pmod(F.xxhash64("qid", "q"), F.col("parts")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts"))
    return left, right


def search(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           centroids: int = CENTROIDS, share: float = SHARE, visit: int = VISIT) -> DataFrame:
    """query_id, rank, id, score of the k nearest rows of every row for which the
    condition ``queries`` (a Column over ``id``) holds.

    A walk ends when its cells hold ``share`` of the index, and at least ``visit`` vectors."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vector_col)
    books = fit(rows, centroids)
    if books is None:
        return spark.createDataFrame([], result)
    size = books[0].shape[1] + books[1].shape[1]
    vector = rows.schema["v"].dataType.simpleString()

    def assigned(batches):
        for pdf in batches:
            pdf = pdf[pdf["v"].map(len) == size]
            if len(pdf):
                yield pd.concat([pdf.reset_index(drop=True), cells_of(pdf["v"], books)], axis=1)

    index = materialize(rows.mapInPandas(assigned, f"id long, v {vector}, c1 int, c2 int"), "multi-index")
    counts = {(r.c1, r.c2): r["count"] for r in index.groupBy("c1", "c2").count().collect()}  # <= centroids ** 2
    enough = max(visit, share * sum(min(n, CELL_COUNT) for n in counts.values()))

    def visited(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["v"]):
                rows_of: dict[int, list[int]] = {}
                for a, b in walk(np.asarray(v, dtype=float), books, counts, enough):
                    rows_of.setdefault(a, []).append(b)
                out += [(i, v, a, cells) for a, cells in rows_of.items()]
            yield pd.DataFrame(out, columns=["qid", "q", "c1", "cells"])

    walks = materialize(index.where(queries).select("id", "v").mapInPandas(
        visited, f"qid long, q {vector}, c1 int, cells array<int>"), "multi-index-walks")
    vectors, asked = dealt(index, walks)

    def ranked(key, left, right):
        """One block of a row of cells against one part of the queries that visit some of them."""
        found = ([], [], [])
        if len(left) and len(right):
            ids, cell = left["id"].to_numpy(), left["c2"].to_numpy()
            x = np.stack(left["v"].to_numpy()).astype(float)
            for qid, q, cells in zip(right["qid"], right["q"], right["cells"]):
                at = np.flatnonzero(np.isin(cell, cells) & (ids != qid))
                scores = x[at] @ np.asarray(q, dtype=float)
                best = top(ids[at], scores, k)
                for column, part in zip(found, (np.full(len(best), qid), ids[at][best], scores[best])):
                    column.append(part)
        names = ("query_id", "vec_id", "score")
        return pd.DataFrame({n: np.concatenate(c) if c else [] for n, c in zip(names, found)})

    near = (vectors.groupBy("c1", "block", "part").cogroup(asked.groupBy("c1", "block", "part"))
            .applyInPandas(ranked, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # a query's nearest of each visited block
    return (near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
