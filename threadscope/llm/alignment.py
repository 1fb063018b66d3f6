"""Alignment of two tokenizers by galloping intersection of their token ends.

1. A text is encoded by both tokenizers.  Each gives an ascending list of byte ends.
   The shorter list drives: every end of it is sought in the longer list by doubling steps from
   the last place found and a binary search between the last two.
2. Ends in both lists cut the tokens into groups.  The rank of one token's end among the other's ends, less
   that of the end before it, is the range of tokens it overlaps: the links.
3. Texts are worked on in chunks of CHUNK_BYTES.  A chunk keeps its distinct linked (A, B) ids with their counts, and
   per document the numbers of its links among them.  Only distinct pairs of chunks are counted
   corpus-wide; their counts come back to the chunk they belong to, where links look them up.

Token bytes are the entry's bytes (A: byte-level vocabulary file of the tokenizers library; B: sentencepiece
model with byte fallback, U+2581 as space).  A reads a space and the text, B adds that space itself.

Defined results: null and empty texts, and texts whose tokens of one kind do not join to space and text, have no
tokens: all counts 0 and groups ''.  Texts of any length are aligned whole; rows with equal ids or texts are
counted each; an empty table gives an empty table.  Extra columns are returned unchanged; those that clash with the columns
added here are replaced.
"""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialize
from .bpe import PRETOKEN, byte_alphabet

#: Bytes of text after which a chunk is closed (a longer text is a chunk of its own), and texts encoded at once.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 2000
#: Runs without a blank, or of blanks, from which on an encoder by ranks is not used: it takes the square of their length.
LONG_RUN = 2000
NOTHING = np.zeros(0, dtype=np.int32)
#: A linked pair as one number: A id * PAIR + B id.
PAIR = 1 << 24
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        import tokenizers

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        # where ids follow the merges, and words are cut the usual way, an encoder by ranks gives the same ids, faster
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        cut = spec.get("pre_tokenizer") or {}
        plain = (merged == sorted(merged) and max(vocab[c] for c in alphabet) < merged[0] and spec.get("normalizer") is None
                 and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
        self.by_ranks = tiktoken.Encoding("a", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: A in a group, A at its end, B in a group, B at its end
        self.names = np.array([f"{i}{c}" for t, seps in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in seps
                               for i in range(len(t))], dtype=object)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both kinds; none where the bytes of one kind are not space and text."""
        out = []
        for text in texts:
            whole = " " + text
            raw = whole.encode()
            if self.by_ranks is not None and not has_long_run(text):
                x = self.by_ranks.encode_ordinary(whole)
            else:
                x = self.a.encode(whole, add_special_tokens=False).ids
            y = self.b.encode(text)
            same = b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))
            out.append((np.array(x, dtype=np.int32), np.array(y, dtype=np.int32)) if same and text else (NOTHING, NOTHING))
        return out


def has_long_run(text: str) -> bool:
    words = text.split()
    return len(text) >= LONG_RUN and (max(map(len, words), default=0) >= LONG_RUN or bool(re.search(r"\s{%d}" % LONG_RUN, text)))


@functools.lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def resolved(path) -> str:
    """A vocabulary is a path, or a function that gives the path where it runs."""
    return path() if callable(path) else path


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For every entry of the shorter ascending list, how many entries of the longer are less."""
    ranks, at, n = [], 0, len(long)
    long = [*long, max(short[-1], long[-1] if n else 0)] if short else []  # nothing sought is above the last entry
    for x in short:
        if long[at] < x:
            at += 1
            if long[at] < x:
                step, low = 1, at
                while low + step < n and long[low + step] < x:
                    low += step
                    step += step
                at = bisect_left(long, x, low + 1, min(low + step, n))
        ranks.append(at)
    return ranks


def intersect(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, common_a, common_b): each A token's range of overlapped B tokens, and the places of the ends in both lists.

    Both lists ascend and end alike."""
    if len(ends_a) <= len(ends_b):
        rank = np.array(gallop(ends_a.tolist(), ends_b.tolist()), dtype=np.int64)
        common_a = np.flatnonzero(ends_b[rank] == ends_a) if len(rank) else rank
        common_b = rank[common_a]
    else:
        back = np.array(gallop(ends_b.tolist(), ends_a.tolist()), dtype=np.int64)  # ranks of B ends among A's
        common_b = np.flatnonzero(ends_a[back] == ends_b)
        common_a = back[common_b]
        # before an A end lie the B ends whose rank is not above its place, less one that equals it
        rank = np.cumsum(np.bincount(back, minlength=len(ends_a)))
        rank[common_a] -= 1
    first = np.zeros(len(ends_a), dtype=np.int64)
    if len(first):
        is_common = np.zeros(len(ends_a), dtype=np.int64)
        is_common[common_a] = 1
        first[1:] = (rank + is_common)[:-1]
    return first, rank, common_a, common_b


def align(tokens: list[tuple[np.ndarray, np.ndarray]], coder: Tokenizers) -> dict:
    """One chunk: per document the counts and groups, and the chunk's pairs with the documents' links among them."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([t[k] for t in tokens]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(coder.a_sizes[a]), np.cumsum(coder.b_sizes[b])
    first, last, common_a, common_b = intersect(ends_a, ends_b)  # texts end in both lists, so they part like groups
    edges_a, edges_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    size = last - first + 1
    link_a = np.repeat(np.arange(len(a)), size)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    pairs, number, count = np.unique(a[link_a] * PAIR + b[link_b], return_inverse=True, return_counts=True)
    total = np.concatenate([[0], np.cumsum(size)])
    n_groups = np.diff(np.searchsorted(common_a, edges_a))
    # groups as text: the A tokens of a group, then its B tokens
    end_a, end_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    end_a[common_a], end_b[common_b] = True, True
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    b_before = np.concatenate([[0], common_b + 1])  # B tokens before each group
    a_until = np.concatenate([common_a + 1, [len(a)]])  # A tokens up to each group's end
    laid = np.empty(len(a) + len(b), dtype=np.int64)
    laid[np.arange(len(a)) + b_before[group_a]] = a + np.where(end_a, len(coder.a_sizes), 0)
    laid[np.arange(len(b)) + a_until[group_b]] = b + 2 * len(coder.a_sizes) + np.where(end_b, len(coder.b_sizes), 0)
    words, cuts = coder.names[laid].tolist(), (edges_a + edges_b).tolist()
    groups = ["".join(words[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": total[edges_a[1:]] - total[edges_a[:-1]], "groups": groups,
            "pairs": pairs, "counts": count, "links": pa.compress(number.astype("<i4").tobytes(), codec="zstd", asbytes=True)}


def chunks(df: DataFrame, a_path, b_path, text_col: str, kept: list[str], with_groups: bool) -> DataFrame:
    """One row a chunk: (chunk, rows: array of the kept columns with counts and groups, pairs, counts, links)."""
    added = [*(T.StructField(c, T.LongType()) for c in COUNTS[:4]), T.StructField("groups" if with_groups else "groups_sha256", T.StringType())]
    rows = T.ArrayType(T.StructType([*(df.schema[c] for c in kept), *added]))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", rows), T.StructField("pairs", T.ArrayType(T.LongType())),
                           T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("links", T.BinaryType())])

    def run(batches):
        import hashlib

        from pyspark import TaskContext

        coder = load(resolved(a_path), resolved(b_path))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_BYTES) and end - start < CHUNK_ROWS:
                    size += len(texts[end])
                    end += 1
                done = align(coder.encode(texts[start:end]), coder)
                if not with_groups:
                    done["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in done["groups"]]
                arrays = [pa.chunked_array([c.slice(start, end - start)]).combine_chunks() for c in batch.columns[:len(kept)]]
                arrays += [pa.array(done[c], pa.int64()) for c in COUNTS[:4]] + [pa.array(done["groups"], pa.string())]
                struct = pa.StructArray.from_arrays(arrays, names=[*kept, *(f.name for f in added)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), struct),
                    pa.array([done["pairs"]], pa.list_(pa.int64())), pa.array([done["counts"]], pa.list_(pa.int64())),
                    pa.array([done["links"]], pa.binary())], names=schema.names)
                number, start = number + 1, end

    return df.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus link these ids, and whether no other A id is linked to the B id more often."""
    pairs = (found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
             .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % PAIR))  # as many rows as A ids at most
    return pairs.withColumn("best", F.col("n") == most)


def alignment(df: DataFrame, a_path, b_path, text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Append n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or, if ``with_groups``, ``groups`` itself).

    The text column is not returned."""
    kept = [c for c in df.columns if c not in (*COUNTS, "groups", "groups_sha256", text_col)]
    text = "groups" if with_groups else "groups_sha256"
    found = materialize(chunks(df, a_path, b_path, text_col, kept, with_groups), "align-chunks")
    counted = materialize(pair_counts(found), "align-pairs")
    wanted = found.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(counted, "pair")
    known = wanted.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("known"))
    known = known.select("chunk", F.col("known.n").alias("n"), F.col("known.best").alias("best"))
    rows = found.select("chunk", "rows", "links").join(known, "chunk", "left")
    item = found.schema["rows"].dataType.elementType
    order = [*kept, *COUNTS, text]
    types = {f.name: f for f in item.fields} | {c: T.StructField(c, T.LongType()) for c in COUNTS[4:]}
    schema = T.StructType([types[c] for c in order])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(1).slice(i, 1).flatten()
                ends = np.concatenate([[0], np.cumsum(docs.field("n_links").to_numpy())])
                links = np.frombuffer(pa.decompress(batch.column(2)[i].as_py(), int(ends[-1]) * 4, codec="zstd", asbytes=True), dtype="<i4")
                n, best = (batch.column(k).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                sums = [np.concatenate([[0], np.cumsum(x[links])]) if len(links) else np.zeros(1, dtype=np.int64) for x in (best, n)]
                extra = dict(zip(COUNTS[4:], (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)))
                yield pa.RecordBatch.from_arrays([extra[c] if c in extra else docs.field(c) for c in order], names=order)

    return rows.select("chunk", "rows", "links", "n", "best").mapInArrow(run, schema)
