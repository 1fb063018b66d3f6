"""Word2Vec (M1, A11) with all vectors in tables: skip-gram with negative sampling.

Sentences are dealt to blocks of about BLOCK_TOKENS tokens.  At each iteration the vectors of a block's words come to
the block, a task trains them on its sentences, and a word's new vectors are averaged over the blocks that hold
it.  Neither the vocabulary nor its vectors are ever in one place, and the driver gets one number.

Every word has an input vector (the model's) and an output vector, one after the other in ``v``.  A batch of pairs
shares its negative samples, drawn from the block's own words by their counts to the power of 3/4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of one block (all may differ: then their vectors take 800 bytes each), and of one piece of a longer sentence.
BLOCK_TOKENS, MAX_SENTENCE = 500_000, 1000
#: Pairs of one batch, negative samples that it shares, and the weight of these together, in samples a pair.
BATCH, SHARED, NEGATIVE = 256, 32, 5
LEARNING_RATE = 0.025


class WordVectors:
    """A fitted model: a table of words and their vectors."""

    def __init__(self, vectors: DataFrame, dim: int):
        self._vectors, self._dim = vectors, dim

    def getVectors(self) -> DataFrame:  # noqa: N802 (as Spark ML names it)
        return self._vectors.select("word", array_to_vector(F.slice("v", 1, self._dim).cast("array<double>")).alias("vector"))

    def getVectorSize(self) -> int:  # noqa: N802
        return self._dim


def pairs(words, sentence, window: int, rng):
    """(centre, context) of all tokens; each token's context reaches a random number of places, ``window`` at most."""
    reach = rng.integers(1, window + 1, len(words))
    centre, context = [words[:0]], [words[:0]]
    for d in range(1, min(window, len(words) - 1) + 1):
        a = np.flatnonzero(sentence[d:] == sentence[:-d])
        for here, there in ((a, a + d), (a + d, a)):
            near = reach[here] >= d
            centre.append(words[here[near]])
            context.append(words[there[near]])
    return np.concatenate(centre), np.concatenate(context)


def _add(to, at, rows):
    """``to[at] += rows``, where ``at`` may repeat."""
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    to[places] += np.add.reduceat(rows[order], starts, axis=0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_block(words, sentence, v, window: int, rates: tuple[float, float], rng):
    """Trains the rows of ``v`` in place on all pairs of a block, once; the learning rate falls along ``rates``."""
    dim = v.shape[1] // 2
    inner, outer = v[:, :dim], v[:, dim:]
    centre, context = pairs(words, sentence, window, rng)
    order = rng.permutation(len(centre))
    noise = np.cumsum(np.bincount(words, minlength=len(v)) ** 0.75)
    for at in range(0, len(order), BATCH):
        c, o = centre[order[at:at + BATCH]], context[order[at:at + BATCH]]
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * at / len(order))
        drawn = np.searchsorted(noise, rng.random(SHARED) * noise[-1], side="right").clip(max=len(v) - 1)
        x, target, other = inner[o], outer[c], outer[drawn]
        g = (rate * (1 - _sigmoid(np.einsum("ij,ij->i", x, target))))[:, None]
        h = -rate * np.float32(NEGATIVE / SHARED) * _sigmoid(x @ other.T) * (c[:, None] != drawn)
        _add(inner, o, g * target + h @ other)
        _add(outer, c, g * x)
        _add(outer, drawn, h.T @ x)


def _iteration(dim: int, window: int, rates: tuple[float, float], seed: list[int]):
    """Sentences (block, id, part, words) and vectors (block, word, v) of one block to its new vectors (word, v)."""
    schema = pa.schema([("word", pa.string()), ("v", pa.list_(pa.float32()))])

    def run(key, sentences, given):
        if not len(given):
            return schema.empty_table()
        sentences, given = sentences.sort_by([("id", "ascending"), ("part", "ascending")]), given.sort_by("word")
        lists, known = sentences.column("words").combine_chunks(), given.column("word").combine_chunks()
        at = pc.index_in(pc.list_flatten(lists), value_set=known)
        there = pc.is_valid(at).to_numpy(zero_copy_only=False)
        words = pc.drop_null(at).to_numpy().astype(np.int64)
        v = given.column("v").combine_chunks().flatten().to_numpy().reshape(len(known), 2 * dim).copy()
        rng = np.random.default_rng([*seed, key[0].as_py()])
        train_block(words, pc.list_parent_indices(lists).to_numpy()[there], v, window, rates, rng)
        starts = pa.array(np.arange(len(v) + 1, dtype=np.int32) * 2 * dim)
        return pa.table([known, pa.ListArray.from_arrays(starts, pa.array(v.reshape(-1)))], schema=schema)

    return run


def fit(tokens: DataFrame, col: str, dim: int = 100, window: int = 5, min_count: int = 1, seed: int = 42,
        min_blocks: int = 8, max_iter: int = 5) -> WordVectors:
    """The model of all token arrays of ``col``, after ``max_iter`` iterations over the corpus."""
    whole = tokens.select(F.monotonically_increasing_id().alias("id"), F.filter(col, lambda w: w.isNotNull()).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / MAX_SENTENCE).cast("int"))
    cut = F.transform(starts, lambda i: F.slice("words", i * MAX_SENTENCE + 1, MAX_SENTENCE))
    cut = F.when(F.size("words") <= MAX_SENTENCE, F.array("words")).otherwise(cut)
    pieces = whole.select("id", F.posexplode(cut).alias("part", "words")).checkpoint()
    n_tokens = pieces.agg(F.sum(F.size("words"))).first()[0]
    blocks = max(min_blocks, -(-(n_tokens or 0) // BLOCK_TOKENS))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "part"), F.lit(blocks)).cast("int"))
    held = pieces.select("block", F.explode("words").alias("word")).groupBy("block", "word").agg(F.count("*").alias("n")).checkpoint()
    words = held.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("word")
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    first = F.transform(places, lambda d: ((F.pmod(F.xxhash64(F.lit(seed), "word", d), F.lit(1 << 24)) + 0.5) / (1 << 24) - 0.5) / dim)
    vectors = words.select("word", F.concat(first, F.array_repeat(F.lit(0.0), dim)).cast("array<float>").alias("v")).checkpoint()
    if vectors.isEmpty():
        raise ValueError("The vocabulary size should be > 0. You may need to check the setting of min_count")
    mask = (1 << 32) - 1
    for i in range(max_iter):
        rates = tuple(LEARNING_RATE * max(1 - k / max_iter, 1e-4) for k in (i, i + 1))
        given = held.select("block", "word").join(vectors.hint("merge"), "word").select("block", "word", "v")
        new = pieces.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(
            _iteration(dim, window, rates, [seed & mask, i]), "word string, v array<float>")
        mean = Summarizer.mean(array_to_vector(F.col("v").cast("array<double>")))
        # shuffled as floats: partial means are twice as large, and a word has one row a block at most
        vectors = (new.repartition("word").groupBy("word").agg(mean.alias("m"))
                   .select("word", vector_to_array("m").cast("array<float>").alias("v")).checkpoint())
    return WordVectors(vectors, dim)
