"""Substring search of large keyword tables by rolling fingerprints.

A task lays its texts end to end as code points and hashes all windows of the lengths that keywords have: windows of
powers of two by doubling, any other length from two of these that overlap.  Windows whose (length, fingerprint) is in
the filter leave the task as strings, one a text and string; the equi-join with the keywords decides.
So a text is read once a length, nothing but hits is shuffled, and a wrong fingerprint match costs a row, never a result.

The filter holds one number a keyword while there are at most FILTER_LIMIT keywords; beyond, fingerprints are
reduced modulo a number that keeps the filter within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers in the filter that every task holds (8 bytes each).
FILTER_LIMIT = 4_000_000
#: Odd 64-bit multipliers of the fingerprints.
_MIX, _LEFT, _RIGHT = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Code points laid end to end at once (a task holds a number of 8 bytes a code point and power of two), and texts turned into strings at once.
BATCH_CHARS, BATCH_ROWS = 1 << 19, 500


class Windows:
    """Fingerprints of all windows of a code-point array."""

    def __init__(self, codes: np.ndarray):
        x = codes.astype(np.uint64) * _MIX
        self.levels = {1: x ^ (x >> np.uint64(29))}

    def power(self, m: int) -> np.ndarray:
        if m not in self.levels:
            half = self.power(m // 2)
            x = half[:len(half) - m // 2] * _LEFT
            x += half[m // 2:]
            self.levels[m] = x
        return self.levels[m]

    def of(self, length: int) -> np.ndarray:
        """One number a window start; none if the array is shorter."""
        m = 1 << (length.bit_length() - 1)
        if length > len(self.levels[1]):
            return np.zeros(0, dtype=np.uint64)
        x, n = self.power(m), len(self.levels[1]) - length + 1
        return x if m == length else x[:n] * _RIGHT + x[length - m:length - m + n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def fingerprints(keywords: DataFrame, col: str) -> DataFrame:
    """(length, mark) of each keyword."""
    def run(batches):
        for batch in batches:
            words = [code_points(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int32()),
                                              pa.array(np.array([Windows(w).of(len(w))[0] for w in words], dtype=np.uint64).view(np.int64))],
                                             names=["length", "mark"])
    return keywords.select(col).mapInArrow(run, "length int, mark long")


def filter_of(keywords: DataFrame, col: str) -> tuple[dict[int, np.ndarray], int]:
    """(sorted marks by length, modulus): every keyword's mark modulo the modulus (0: unreduced) is in it."""
    marks, modulus = fingerprints(keywords, col).distinct(), 0
    rows = marks.limit(FILTER_LIMIT + 1).collect()
    if len(rows) > FILTER_LIMIT:
        marks = marks.checkpoint()
        modulus = max(1, FILTER_LIMIT // marks.select("length").distinct().count())
        rows = marks.select("length", F.pmod("mark", F.lit(modulus).cast("long")).alias("mark")).distinct().collect()
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["length"], []).append(r["mark"])
    return {n: np.sort(np.array(v, dtype=np.int64)) for n, v in sorted(found.items())}, modulus


def keyword_hits(df: DataFrame, id_cols: list[str], text: Column, keywords: DataFrame, keyword_col: str) -> DataFrame:
    """(id columns, keyword column): each string of a text, once, that may be a keyword; all that are keywords are among them."""
    marks, modulus = filter_of(keywords, keyword_col)
    fields = [df.schema[c] for c in id_cols]
    schema = T.StructType([*fields, T.StructField(keyword_col, T.StringType())])

    def hits(texts: list[str]) -> tuple[list[int], list[str]]:
        codes = [code_points(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        windows, rows, strings = Windows(np.concatenate(codes)), [], []
        for length, known in marks.items():
            seen = windows.of(length).view(np.int64)
            if modulus:
                seen = np.mod(seen, modulus)
            at = np.flatnonzero(np.isin(seen, known) if len(known) <= 32 else  # few are compared one by one
                                known[np.minimum(np.searchsorted(known, seen), len(known) - 1)] == seen)
            row = np.searchsorted(ends, at, side="right")
            inside = at + length <= ends[row] if len(at) else np.zeros(0, dtype=bool)
            found = {}
            for r, i in zip(row[inside].tolist(), at[inside].tolist()):
                start = i - (int(ends[r - 1]) if r else 0)
                found[r, texts[r][start:start + length]] = None
            rows.extend(r for r, _ in found)
            strings.extend(s for _, s in found)
        return rows, strings

    def run(batches):
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            texts = [t or "" for t in batch.column(len(id_cols)).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                rows, strings = hits(texts[start:end]) if size and marks else ([], [])
                take = pa.array([start + r for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(id_cols))), pa.array(strings, pa.string())],
                                                 names=schema.names)
                start = end

    return df.select(*id_cols, text.alias("_text")).mapInArrow(run, schema)
