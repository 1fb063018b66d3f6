"""M6: a softmax classifier trained by full-batch gradient steps, evaluated after each epoch.

Texts become arrays of token numbers (a hash modulo ``num_features``), so a model is an array of
``num_features`` x ``classes`` weights whatever the corpus; it goes to the tasks with their function.  An epoch is one job: a task adds up
the residuals of its rows by token number in Arrow batches, and the tasks' sums are added by token number.  Evaluation scores the
other rows with the weights of all epochs in one further pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import evaluate as EV

NUM_FEATURES, CLASSES = 1 << 10, 3
#: Token number of the bias.
BIAS = -1


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(elements of all lists, the row of each)."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def numbered(lists: pa.ListArray, num_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token numbers, their rows, the Euclidean length of each row's counts: 1 for no tokens, so that no text outweighs another).

    A word is hashed once a batch."""
    words, row = flat(lists)
    coded = words.dictionary_encode()
    of_word = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % num_features for w in coded.dictionary.to_pylist()], dtype=np.int64)
    numbers = of_word[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
    cells, n = np.unique(row * num_features + numbers, return_counts=True)
    squares = np.bincount(cells // num_features, weights=n.astype(np.float64) ** 2, minlength=len(lists))
    return numbers, row, np.sqrt(np.maximum(squares, 1.0))


def logits(numbers: np.ndarray, row: np.ndarray, root: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row and class: the bias and the sum of its weights of the tokens, over the length of their counts.

    ``weights``: the biases, then a row a token number."""
    sums = [np.bincount(row, weights=weights[numbers + 1, c], minlength=len(root)) for c in range(weights.shape[1])]
    return weights[0] + np.stack(sums, axis=1) / root[:, None]


def featured(df: DataFrame, tokens: Column, num_features: int) -> DataFrame:
    """Append ``numbers`` and ``root`` (their length)."""
    @F.arrow_udf("struct<numbers: array<int>, root: double>")
    def features(lists: pa.Array) -> pa.Array:
        numbers, row, root = numbered(lists, num_features)
        ends = np.cumsum(np.bincount(row, minlength=len(root)))
        each = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(numbers, pa.int32()))
        return pa.StructArray.from_arrays([each, pa.array(root)], names=["numbers", "root"])

    return df.withColumn("_features", features(tokens)).withColumns({n: F.col(f"_features.{n}") for n in ("numbers", "root")}).drop("_features")


@dataclass
class SoftmaxModel:
    """Weights after each epoch; the last are the model's."""

    num_features: int
    classes: int
    epochs: list[list[float]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def matrix(self, epoch: int) -> np.ndarray:
        return np.array(self.epochs[epoch - 1]).reshape(self.num_features + 1, self.classes)

    def scorer(self, chunk_col: str = "chunk"):
        """The model as a window scorer (M7): ``logits`` of a token array."""
        weights, num_features = self.matrix(len(self.epochs)), self.num_features

        @F.arrow_udf("array<double>")
        def score(lists: pa.Array) -> pa.Array:
            z = logits(*numbered(lists, num_features), weights)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))

        return lambda d: d.withColumn("logits", score(F.col(chunk_col)))


def _sums(weights: np.ndarray):
    """One step's share of a task: (i, gradients by class, loss, rows) for each token number."""
    def run(batches):
        total, loss, n = np.zeros_like(weights), 0.0, 0
        for batch in batches:
            label, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            numbers, row = flat(batch.column(1))
            numbers = numbers.to_numpy(zero_copy_only=False)
            z = logits(numbers, row, root, weights)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            loss, n = loss - float(np.log(p[np.arange(len(label)), label]).sum()), n + len(label)
            p[np.arange(len(label)), label] -= 1
            total[0] += p.sum(axis=0)
            for c in range(weights.shape[1]):
                total[1:, c] += np.bincount(numbers, weights=(p[:, c] / root)[row], minlength=len(weights) - 1)
        if n:
            at = np.arange(len(weights)) + BIAS
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[:, c]) for c in range(weights.shape[1])),
                                              pa.array(np.where(at == BIAS, loss, 0.0)), pa.array(np.where(at == BIAS, n, 0))],
                                             names=["i", *(f"g{c}" for c in range(weights.shape[1])), "loss", "n"])
    return run


def train(rows: DataFrame, text_col: str = "text", label_col: str = "label", epochs: int = 200, rate: float = 1.5,
          reg: float = 1e-4, num_features: int = NUM_FEATURES, classes: int = CLASSES, tol: float = 1e-5) -> SoftmaxModel:
    """Full-batch gradient descent until the mean loss falls by less than ``tol`` in an epoch, or ``epochs`` are over.

    Labels are 0 .. classes - 1, other rows and null texts are left out.  The loss is convex and a text's counts have length one, so a
    rate below 2 descends."""
    x = rows.where(F.col(text_col).isNotNull() & F.col(label_col).between(0, classes - 1)).withColumn("label", F.col(label_col).cast("int"))
    x = featured(x, X.tokenize(text_col, clean=False), num_features).select("label", "numbers", "root").checkpoint()
    model = SoftmaxModel(num_features, classes)
    schema = ", ".join(["i int", *(f"g{c} double" for c in range(classes)), "loss double", "n long"])
    w = [0.0] * (classes * (num_features + 1))
    for _ in range(epochs):
        sums = x.mapInArrow(_sums(np.array(w).reshape(-1, classes)), schema).groupBy("i").agg(
            *[F.sum(c).alias(c) for c in (*(f"g{c}" for c in range(classes)), "loss", "n")])
        found = {r["i"]: r for r in sums.collect()}  # num_features + 1 rows at most
        if not found:
            raise ValueError("no labelled rows")
        n = found[BIAS]["n"]
        model.losses.append(found[BIAS]["loss"] / n)
        w = [v - rate * (found[at // classes - 1][f"g{at % classes}"] / n + (reg * v if at >= classes else 0.0)) for at, v in enumerate(w)]
        model.epochs.append(w)
        if len(model.losses) > 1 and model.losses[-2] - model.losses[-1] < tol:
            break
    return model


def evaluate_epochs(model: SoftmaxModel, rows: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(epoch, train_loss, accuracy, precision, recall, f1): weighted metrics (E2) of the rows after each epoch, in one pass.

    ``train_loss`` is the mean loss that the epoch's gradient was taken at."""
    spark = rows.sparkSession
    weights = [model.matrix(e + 1) for e in range(len(model.epochs))]
    x = featured(rows.where(F.col(text_col).isNotNull()), X.tokenize(text_col, clean=False), model.num_features)
    x = x.select(F.col(label_col).alias("actual"), "numbers", "root")

    def run(batches):
        for batch in batches:
            numbers, row = flat(batch.column(1))
            numbers, root = numbers.to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for e, w in enumerate(weights):
                best = logits(numbers, row, root, w).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), e + 1), pa.int32()), batch.column(0), pa.array(best, pa.int32())],
                                                 names=["epoch", "actual", "predicted"])

    schema = T.StructType([T.StructField("epoch", T.IntegerType()), x.schema["actual"], T.StructField("predicted", T.IntegerType())])
    pairs = x.mapInArrow(run, schema)  # a row a text and epoch
    losses = spark.createDataFrame([(i + 1, x) for i, x in enumerate(model.losses)], "epoch int, train_loss double")
    return (EV.metrics_by(pairs, ["epoch"], weighted=True).join(F.broadcast(losses), "epoch")  # a row an epoch
            .select("epoch", "train_loss", "accuracy", "precision", "recall", "f1"))
