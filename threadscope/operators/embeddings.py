"""Word and sentence vectors by random indexing (M1, M2, A11), all as aggregates.

Every word has a sparse index vector of NONZERO entries of plus or minus one, at places given by the digits of its md5.
A word's context vector is the sum of the index vectors of the words within WINDOW tokens of it, over the
whole corpus.  So no vocabulary is built or kept anywhere: pairs of neighbours are counted with
map-side sums, each pair adds a few entries, and a word is one row.  Context vectors are scaled to length one and
kept as integers of one millionth, so sums of them do not depend on their order.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, NONZERO, WINDOW = 100, 4, 5
SCALE = 1_000_000
#: Bytes of word vectors up to which they are broadcast; beyond, tokens are shuffled to them.
BROADCAST_BYTES = 64 << 20


def index_entries(word: Column, dim: int = DIM) -> Column:
    """Array of (d, sign): the index vector of a word."""
    digits = [F.conv(F.substring(F.md5(word), 8 * j + 1, 8), 16, 10).cast("long") for j in range(NONZERO)]
    return F.array(*[F.struct((v % dim).cast("int").alias("d"),
                              F.when(F.floor(v / dim) % 2 == 0, 1).otherwise(-1).alias("sign")) for v in digits])


def neighbour_counts(df: DataFrame, tok_col: str = "tokens", window: int = WINDOW) -> DataFrame:
    """(word, other, n): how often two words stand within ``window`` tokens of each other in one row."""
    near = F.transform(tok_col, lambda w, i: F.struct(w.alias("word"), F.concat(
        F.slice(tok_col, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))),
        F.slice(tok_col, i + 2, F.lit(window))).alias("others")))
    pairs = df.select(F.explode(near).alias("p")).select("p.word", F.explode("p.others").alias("other"))
    return pairs.groupBy("word", "other").agg(F.count("*").alias("n"))


def word_vectors(df: DataFrame, tok_col: str = "tokens", dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """M1: (word, vector) of every word that has a neighbour; vector: ``dim`` integers, of length SCALE together."""
    entries = neighbour_counts(df, tok_col, window).withColumn("e", F.explode(index_entries(F.col("other"), dim)))
    sums = entries.groupBy("word", F.col("e.d").alias("d")).agg(F.sum(F.col("n") * F.col("e.sign")).alias("x"))
    words = sums.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"),
                                     F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double")).alias("norm"))
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)))
    unit = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE)) / F.col("norm") + 0.5).cast("double"))
    return words.where("norm > 0").select("word", unit.alias("vector"))


def sentence_vectors(df: DataFrame, keys, tok_col: str = "tokens", words: DataFrame | None = None, dim: int = DIM) -> DataFrame:
    """Append ``vector``, the mean of a row's word vectors (all zeros if it has no word with a neighbour).

    Small tables of word vectors are broadcast (their bytes are counted first), so that tokens stay where they are and one
    summed vector a row and task is shuffled; larger ones are joined by word."""
    keys = list(keys)
    words = (word_vectors(df, tok_col, dim) if words is None else words).checkpoint()
    fits = words.count() * (8 * dim + 64) <= BROADCAST_BYTES
    tokens = df.select(*keys, F.size(tok_col).alias("n"), F.explode(tok_col).alias("word"))
    sums = (tokens.join(F.broadcast(words) if fits else words, "word").groupBy(*keys)
            .agg(Summarizer.sum(array_to_vector("vector")).alias("s"), F.first("n").alias("n"))
            .select(*keys, F.transform(vector_to_array("s"), lambda v: v / (F.col("n") * float(SCALE))).alias("_vec")))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.join(sums, keys, "left").withColumn("vector", F.coalesce("_vec", zero)).drop("_vec")
