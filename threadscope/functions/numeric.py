"""Numeric scalars (X15-X20, X27) and the chunk vote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ._util import col


def make_int(c) -> Column:
    """Sign -> -1/0/1."""
    return F.signum(col(c)).cast("int")


def polarity_to_label(c) -> Column:
    """Polarity -1/0/1 -> class 0/1/2."""
    return (col(c) + 1).cast("int")


def label_to_polarity(c) -> Column:
    """Class 0/1/2 -> polarity -1/0/1."""
    return (col(c) - 1).cast("int")


def softmax(arr) -> Column:
    """Numerically stable softmax over an array of logits."""
    a = col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax(arr) -> Column:
    """0-based index of the largest value; ties -> lowest index."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def token_windows(tokens, size: int = 512, overlap: int = 256) -> Column:
    """Overlapping windows covering every token; at least one window.

    Windows start at 0, step, 2*step ... (step = size - overlap) and stop as
    soon as one reaches the end of the list.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    t = col(tokens)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.slice(t, s + 1, size))


def sentiment_boost(label) -> Column:
    """Positive x1.1, negative x1.3, else x1."""
    lab = col(label)
    return (F.when(lab == "positive", F.lit(rules.BOOST_POSITIVE))
            .when(lab == "negative", F.lit(rules.BOOST_NEGATIVE))
            .otherwise(F.lit(1.0)))


def cluster_count(n, k_max: int = rules.MAX_CLUSTERS) -> Column:
    """min(n, k_max)."""
    return F.least(col(n), F.lit(k_max))


def vote(pred) -> Column:
    """A12 (aggregate): half-even rounded mean of chunk polarities."""
    return F.bround(F.avg(col(pred)), 0).cast("int")
