"""Substring dedup with a compressed FM-index per shard.

A window of ``length`` words is repeated if its words also start anywhere else in
the corpus; the words that repeated windows cover are removed.

1. Routing.  Every window is named by the least hash of its GRAM-word grams, so equal
   windows have equal names.  Consecutive windows named by the same gram form a
   segment (at most length - GRAM + 1 windows); equal windows lie in different
   segments, as their grams stand in different places.  Segments whose name occurs
   once are unique and go no further.
2. Segments with equal words become one content with a count; all windows of a
   content that occurs twice are repeated.
3. Names with several contents are dealt to shards by name.  A shard builds an FM-index
   over its distinct contents (suffix array by doubling, Burrows-Wheeler transform
   in a wavelet matrix with popcount ranks) and streams the contents back: backward
   search computes each window's matching statistic, which ends where fewer than
   two places are left; windows that reach the threshold are reported.
4. A name with more than MOST contents (a frequent phrase in changing company) is
   refined to names of whole windows, counted in advance, so no shard holds a hot name.

All decisions depend on the text alone, so texts are keyed by 128-bit hashes and
copies of a text are decided once.

Defined results: null and empty texts have no words; texts shorter than a window keep
all words; repeated rows repeat all their windows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hash128, materialize
from .minhash import U, constants, digests, mixed

LENGTH, GRAM = 35, 8
#: Contents of one name that a shard takes; contents of a shard on average.
MOST, SHARD = 64, 8192
#: Words whose hashes are worked on together.
TOGETHER = 1 << 16
GRAM_KEYS = constants(64, 11)
BASES = (int(constants(1, 21)[0]) | 1, int(constants(1, 31)[0]) | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[base] = tuple(out)
    return _POWERS[base]


def word_hashes(words) -> np.ndarray:
    return mixed(digests(words))


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """128 bits (two columns) of each span of word hashes."""
    out = []
    for base in BASES:
        up, down = powers(base, len(x) + 1)
        total = np.concatenate([[U(0)], np.cumsum(x * up[:len(x)], dtype=np.uint64)])
        out.append(mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return out


def segments(x: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows) of the segments of some texts that lie one after
    another in ``x``, each of ``length`` words at least, from their word hashes."""
    g = x[:len(x) - GRAM + 1] * GRAM_KEYS[0]
    for i in range(1, GRAM):
        g += x[i:len(x) - GRAM + 1 + i] * GRAM_KEYS[i]
    g = mixed(g)
    span, at, width = length - GRAM + 1, np.arange(len(g)), 1

    def leftmost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    while 2 * width <= span:
        at, width = leftmost(at[:-width], at[width:]), 2 * width
    if width < span:
        at = leftmost(at[:len(at) - (span - width)], at[span - width:])
    ends = np.cumsum(lengths)
    inside = np.zeros(len(x) + 1, dtype=np.int64)  # windows that do not reach into the next text
    inside[ends - lengths] += 1
    inside[ends - length + 1] -= 1
    valid = np.flatnonzero(np.cumsum(inside[:-1]))
    at = at[valid]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]].view(np.int64), valid[first], np.diff(np.concatenate([first, [len(at)]]))


def segment_rows(docs: DataFrame, length: int, full: bool) -> DataFrame:
    """Segments of every text (t1, t2, text): names only, or (t1, t2, name, c1, c2, start, n)."""
    names = ["t1", "t2", "name", "c1", "c2", "start", "n"] if full else ["name"]

    def pieces(rows: list[int], texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
        x, lengths = word_hashes(chain.from_iterable(texts)), np.array([len(t) for t in texts])
        name, start, n = segments(x, lengths, length)
        first = np.cumsum(lengths) - lengths
        own = np.searchsorted(first, start, side="right") - 1
        more = [*span_hashes(x, start, start + n + length - 1), start - first[own], n] if full else []
        return np.array(rows)[own], [name, *more]

    def run(batches):
        for batch in batches:
            done, rows, texts, held = [], [], [], 0
            for r, text in enumerate(batch.column(2)):
                words = (text.as_py() or "").encode().split()
                if len(words) >= length:
                    rows.append(r)
                    texts.append(words)
                    held += len(words)
                    if held >= TOGETHER:
                        done.append(pieces(rows, texts))
                        rows, texts, held = [], [], 0
            if texts:
                done.append(pieces(rows, texts))
            if done:
                columns = [pa.array(np.concatenate(c)) for c in zip(*(d[1] for d in done))]
                if full:
                    at = pa.array(np.concatenate([d[0] for d in done]))
                    columns = [batch.column(0).take(at), batch.column(1).take(at), *columns]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


# -- the index ------------------------------------------------------------------

class WaveletMatrix:
    """Ranks of symbols in a sequence of small numbers, a bit plane a level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros((len(seq) // 64 + 1) * 64, dtype=bool)
            padded[:len(seq)] = bit
            plane = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
            self.planes.append((plane, ones))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self.walk(np.zeros(symbols, dtype=np.int64), np.arange(symbols))

    def walk(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, (plane, ones), zeros in zip(range(self.levels - 1, -1, -1), self.planes, self.zeros):
            block, rest = i >> 6, (i & 63).astype(np.uint64)
            rank = ones[block] + np.bitwise_count(plane[block] & ((U(1) << rest) - U(1)))
            i = np.where(symbol >> level & 1, zeros + rank, i - rank)
        return i

    def rank(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        return self.walk(i, symbol) - self.base[symbol]


class FMIndex:
    """Backward search over a text of symbols (numbers below ``symbols``)."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[:n - width] = rank[width:] + 1 if width < n else 0
            pair = rank * np.int64(n + symbols + 2) + after
            order = np.argsort(pair, kind="stable")
            step = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            if step[-1] == n - 1 or width >= n:
                break
            width *= 2
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.n = n

    def matching(self, text: np.ndarray, ends: np.ndarray, threshold: int, places: int = 2) -> np.ndarray:
        """For each end position, how many symbols before it (at most ``threshold``)
        still occur in ``places`` places."""
        found = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        for step in range(1, threshold + 1):
            c = text[ends[live] - step]
            lo, hi = self.below[c] + self.bwt.rank(lo, c), self.below[c] + self.bwt.rank(hi, c)
            ok = hi - lo >= places
            live, lo, hi = live[ok], lo[ok], hi[ok]
            if not len(live):
                break
            found[live] = step
        return found


def repeated_windows(contents: list[list[bytes]], wanted: list[bool], length: int) -> list[list[int]]:
    """Of each wanted content, the windows that occur twice or more in the shard."""
    known: dict[bytes, int] = {}
    m = len(contents)
    # each content ends with a separator of its own (numbers below m), so suffixes differ
    text = np.concatenate([np.array([*(known.setdefault(w, len(known)) + m for w in c), i], dtype=np.int64)
                           for i, c in enumerate(contents)])
    index = FMIndex(text, m + len(known))
    sizes = np.array([len(c) + 1 for c in contents])
    offset = np.cumsum(sizes) - sizes
    picked = np.flatnonzero(wanted)
    ends = np.concatenate([np.arange(offset[i] + length, offset[i] + sizes[i]) for i in picked])
    full = index.matching(text, ends, length) >= length
    out: list[list[int]] = [[] for _ in contents]
    at = 0
    for i in picked:
        n = sizes[i] - length
        out[i] = np.flatnonzero(full[at:at + n]).tolist()
        at += n
    return out


def shard_hits(contents: DataFrame, length: int) -> DataFrame:
    """(name, c1, c2, hits) of contents (name, c1, c2, occurs, words): one index a partition."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        words = [w.split(b" ") for w in table.column("words").to_pylist()]
        hits = repeated_windows(words, [n == 1 for n in table.column("occurs").to_pylist()], length)
        out = table.select(["name", "c1", "c2"]).append_column("hits", pa.array(hits, pa.list_(pa.int32())))
        yield from out.combine_chunks().to_batches()

    return contents.mapInArrow(run, "name long, c1 long, c2 long, hits array<int>")


def window_rows(contents: DataFrame, length: int) -> DataFrame:
    """(w1, w2, name, c1, c2, hit, occurs): every window of the contents by a 128-bit hash."""

    def run(batches):
        for batch in batches:
            rows, hit, hashes = [], [], []
            for r, words in enumerate(batch.column("words").to_pylist()):
                x = word_hashes(words.split(b" "))
                at = np.arange(len(x) - length + 1)
                rows.append(np.full(len(at), r))
                hit.append(at)
                hashes.append(span_hashes(x, at, at + length))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(h)) for h in zip(*hashes)),
                     *(batch.column(c).take(take) for c in ("name", "c1", "c2")),
                     pa.array(np.concatenate(hit), pa.int32()), batch.column("occurs").take(take)],
                    names=["w1", "w2", "name", "c1", "c2", "hit", "occurs"])

    return contents.mapInArrow(run, "w1 long, w2 long, name long, c1 long, c2 long, hit int, occurs long")


# -- the operator -----------------------------------------------------------------

def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, spans) of the texts (t1, t2, text) with repeated windows; a span is
    (start, windows, hits), hits null for all."""
    twice = materialize(segment_rows(texts, length, False).groupBy("name").agg(F.count("*").alias("c"))
                        .where("c > 1").select("name"), "names")
    seen = materialize(segment_rows(texts, length, True).join(twice, "name", "left_semi")
                       .groupBy("t1", "t2", "name", "c1", "c2", "start", "n").agg(F.count("*").alias("copies")), "segments")
    contents = materialize(seen.groupBy("name", "c1", "c2").agg(
        F.sum("copies").alias("occurs"), F.min(F.struct("t1", "t2", "start", "n")).alias("at")), "contents")
    several = contents.groupBy("name").agg(F.count("*").alias("many")).where("many > 1")
    # the words of contents that are not alone under their name, from one text that has them
    asked = (contents.join(several, "name").groupBy("at.t1", "at.t2")
             .agg(F.collect_list(F.struct("name", "c1", "c2", "occurs", "many", "at.start", "at.n")).alias("asked")))  # of one text

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text"), batch.column("asked").to_pylist()):
                words = text.as_py().encode().split()
                out += [(a["name"], a["c1"], a["c2"], a["occurs"], a["many"],
                         b" ".join(words[a["start"]:a["start"] + a["n"] + length - 1])) for a in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)],
                                                 names=["name", "c1", "c2", "occurs", "many", "words"])

    schema = "name long, c1 long, c2 long, occurs long, many long, words binary"
    words = materialize(texts.join(asked, ["t1", "t2"]).select("text", "asked").mapInArrow(cut, schema)
                        .groupBy("name", "c1", "c2").agg(F.first("occurs").alias("occurs"), F.first("many").alias("many"),
                                                         F.first("words").alias("words")), "content-words")
    shared = words.where(F.col("many") <= MOST)
    shards = max(1, -(-shared.count() // SHARD), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_index = shard_hits(shared.select("name", "c1", "c2", "occurs", "words").repartition(shards, "name"), length)
    windows = materialize(window_rows(words.where(F.col("many") > MOST), length), "windows")
    often = windows.groupBy("w1", "w2").agg(F.sum("occurs").alias("all")).where("all > 1").select("w1", "w2")
    by_window = (windows.where("occurs = 1").join(often, ["w1", "w2"], "left_semi")
                 .groupBy("name", "c1", "c2").agg(F.collect_list("hit").alias("hits")))
    hits = by_index.where(F.size("hits") > 0).unionByName(by_window)
    whole = contents.where("occurs > 1").select("name", "c1", "c2", F.lit(None).cast("array<int>").alias("hits"))
    decided = materialize(hits.join(whole, ["name", "c1", "c2"], "left_anti").unionByName(whole), "decided")
    return (seen.join(decided, ["name", "c1", "c2"]).groupBy("t1", "t2")
            .agg(F.collect_list(F.struct("start", "n", "hits")).alias("spans")))  # segments of one text


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Append n_words, n_removed and kept (the words left, by single spaces) to ``df``."""
    added = ["n_words", "n_removed", "kept"]
    cols = [c for c in df.columns if c not in added and c != text_col]
    t1, t2 = hash128(F.col(text_col))
    texts = df.where(F.col(text_col).isNotNull()).select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(texts, length), "spans")
    rows = (df.select(*cols, F.col(text_col).alias("__text"), t1.alias("__t1"), t2.alias("__t2"))
            .join(spans.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("spans").alias("__spans")),
                  ["__t1", "__t2"], "left").select(*cols, "__text", "__spans"))
    schema = df.select(*cols).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches):
        k = len(cols)
        for batch in batches:
            count, gone, kept = [], [], []
            for text, spans in zip(batch.column(k), batch.column(k + 1)):
                words = (text.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans.as_py() or ():
                    at = np.arange(s["n"]) if s["hits"] is None else np.array(s["hits"], dtype=np.int64)
                    np.add.at(edge, s["start"] + at, 1)
                    np.add.at(edge, s["start"] + at + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                left = [w for w, c in zip(words, covered) if not c] if covered.any() else words
                count.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(count, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
