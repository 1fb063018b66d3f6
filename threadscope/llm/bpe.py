"""Byte-level BPE by forced-boundary splitting.

Two bytes that never stand side by side inside any vocabulary token can never
end up in one token, so the text is certainly cut between them.  Every
pre-token is cut at these places, the fragments are merged independently, and
their ids are concatenated.  Fragments repeat heavily, so a bounded memo of
fragments and pre-tokens makes one pass over a text a chain of look-ups.

Defined results: null text gives no ids; an empty text gives an empty array;
texts of any length are encoded whole (merging is O(n log n) in the longest
fragment); the strings of special tokens become their ids, as the tokenizers
library does by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-token pattern of byte-level vocabularies (fixed value).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of a memo before it is emptied, and the longest string kept in it.
MEMO_SIZE, MEMO_LENGTH = 1 << 20, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A dict that computes missing entries and forgets all when full."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder over one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_id[alphabet[token]] = i
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        #: joined[x * 256 + y]: bytes x, y stand side by side inside some token.
        self.joined = np.zeros(65536, dtype=bool)
        for token in vocab:
            raw = [alphabet[c] for c in token]
            for x, y in zip(raw, raw[1:]):
                self.joined[x * 256 + y] = True
        self.joined_flags = self.joined.tobytes()
        self.pretoken = regex.compile(PRETOKEN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fragments = Memo(self._merged)
        self.pretokens = Memo(self._pretoken)

    def forced_cuts(self, raw: bytes) -> list[int]:
        """Positions at which a token certainly ends."""
        if len(raw) <= MEMO_LENGTH:
            flags = self.joined_flags
            return [i for i, (x, y) in enumerate(zip(raw, raw[1:]), 1) if not flags[x * 256 + y]]
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
        return (np.flatnonzero(~self.joined[b[:-1] * 256 + b[1:]]) + 1).tolist()

    def _pretoken(self, piece: str) -> bytes:
        raw = piece.encode()
        cuts = self.forced_cuts(raw)
        if not cuts:
            return self.fragments[raw]
        edges = [0, *cuts, len(raw)]
        return b"".join([self.fragments[raw[a:b]] for a, b in zip(edges, edges[1:])])

    def _merged(self, raw: bytes) -> bytes:
        """Ids of one fragment (little-endian int32): lowest rank first, leftmost among equals."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n <= MEMO_LENGTH:
            rank_of, last = self.rank.get, len(self.merged)
            ranks = [rank_of(pair, last) for pair in zip(ids, ids[1:])]
            while ranks:
                rank = min(ranks)
                if rank == last:
                    break
                i = ranks.index(rank)
                ids[i:i + 2] = [self.merged[rank]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of((ids[i - 1], ids[i]), last)
                if i < len(ranks):
                    ranks[i] = rank_of((ids[i], ids[i + 1]), last)
            return struct.pack(f"<{len(ids)}i", *ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([i for i in ids if i >= 0], dtype="<i4").tobytes()

    def encode_buffer(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32."""
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.pretokens.__getitem__, self.pretoken.findall(text)))
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<i4").tobytes())
            else:
                out.extend(map(self.pretokens.__getitem__, self.pretoken.findall(part)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_buffer(text), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    """One coder a Python worker and vocabulary."""
    return ForcedBoundaryBPE(path)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Append ``ids_col`` (array of int) and, if named, ``decoded_col`` (the text that
    the ids decode to, from the same pass); columns of these names are replaced."""
    added = [c for c in (ids_col, decoded_col) if c]
    kept = [c for c in df.columns if c not in added]
    src = df.select(*kept, F.col(text_col).alias("__text"))
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField("", T.StringType())]
    if decoded_col:
        fields[1].name = decoded_col
    schema = T.StructType([*(df.schema[c] for c in kept), *fields[:len(added)]])

    def run(batches):
        coder = load(vocabulary)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            buffers = [None if t is None else coder.encode_buffer(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(b or b"") // 4 for b in buffers])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(b or b"" for b in buffers), dtype="<i4")),
                                           mask=pa.array([b is None for b in buffers], type=pa.bool_()))
            out = [ids.cast(pa.list_(pa.field("element", pa.int32(), False)))]
            if decoded_col:
                out.append(pa.array([None if b is None else coder.decode(np.frombuffer(b, dtype="<i4").tolist())
                                     for b in buffers], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *out], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``text_col``: the text of the ids, special tokens included (null ids: null)."""
    df = df.drop(text_col) if text_col in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches):
        coder = load(vocabulary)
        for batch in batches:
            column = batch.column(at)
            flat, ends = column.flatten().to_pylist(), [0]
            for n in column.value_lengths().to_pylist():
                ends.append(ends[-1] + (n or 0))
            valid = column.is_valid().to_pylist()
            texts = [coder.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, text_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded"):
    """n_tokens, ids_sha256, decoded_sha256 of an encoded and decoded frame."""
    return (F.size(ids_col).cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2(F.col(text_col), 256).alias("decoded_sha256"))
