"""Classification metrics.

Everything derives from counts per class, a tiny aggregate, so the heavy part is
one partial hash aggregation over the (truth, prediction) pairs, for all models and tasks at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

#: Row labels of the metric tables (fixed values).
METRIC_NAMES = ["Precision", "Recall", "Accuracy", "F1 Score"]


def confusion(pairs: DataFrame, truth: str = "actual", pred: str = "predicted") -> DataFrame:
    """Counts per (actual, predicted)."""
    return pairs.groupBy(F.col(truth).alias("actual"), F.col(pred).alias("predicted")) \
        .agg(F.count("*").alias("n"))


def class_metrics(pairs: DataFrame, keys=(), truth: str = "actual", pred: str = "predicted", n: Column | None = None) -> DataFrame:
    """Per key and class: tp, support, npred and precision, recall, f1 (p, r, f1); 0/0 counts as 0.

    A pair counts for the class it has and the class it is given, so one aggregation (with map-side
    sums) does for any number of keys; classes are those of either side.  ``n``: weight of a pair."""
    n = F.lit(1) if n is None else n
    a, b = F.col(truth), F.col(pred)
    sides = F.array(F.struct(a.alias("cls"), F.when(a == b, n).otherwise(0).alias("tp"), n.alias("support"), F.lit(0).cast("long").alias("npred")),
                    F.struct(b.alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("support"), n.cast("long").alias("npred")))
    d = pairs.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, "x.cls").agg(
        *[F.sum(f"x.{c}").alias(c) for c in ("tp", "support", "npred")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return d.select(*keys, "cls", "tp", "support", "npred", p.alias("p"), r.alias("r"), f1.alias("f1"))


def _summaries(weighted: bool, which: Column | None = None) -> dict[str, Column]:
    """precision, recall, f1 and accuracy as aggregates over classes (those for which ``which`` holds)."""
    def only(c: Column) -> Column:
        return c if which is None else F.when(which, c)
    support = F.sum(only(F.col("support")))
    mean = {name: F.try_divide(F.sum(only(F.col(c) * F.col("support"))), support) if weighted else F.avg(only(F.col(c)))
            for name, c in (("precision", "p"), ("recall", "r"), ("f1", "f1"))}
    return mean | {"accuracy": F.try_divide(F.sum(only(F.col("tp"))), support)}


def metrics_by(pairs: DataFrame, keys, truth: str = "actual", pred: str = "predicted", weighted: bool = False) -> DataFrame:
    """E1 (macro) or E2 (weighted by support) for every key, in two aggregations of one scan."""
    return class_metrics(pairs, keys, truth, pred).groupBy(*keys).agg(*[c.alias(k) for k, c in _summaries(weighted).items()])


def macro_metrics(pairs: DataFrame, truth: str = "actual", pred: str = "predicted") -> DataFrame:
    """Macro precision / recall / F1 (mean of per-class F1) + accuracy.
    Classes = union of truth and prediction; 0/0 counts as 0."""
    return metrics_by(pairs, [], truth, pred)


def macro_from_confusion(conf: DataFrame) -> DataFrame:
    """E1 from the counts of A16."""
    return class_metrics(conf, n=F.col("n")).agg(*[c.alias(k) for k, c in _summaries(False).items()])


def weighted_metrics(pairs: DataFrame, truth: str = "actual", pred: str = "predicted") -> DataFrame:
    """Support-weighted precision / recall / F1 + accuracy."""
    return metrics_by(pairs, [], truth, pred, weighted=True)


def stack_tasks(pairs: DataFrame, keys=(), subj_truth: str = "actual_subj", subj_pred: str = "predicted_subj") -> DataFrame:
    """Both tasks of each row as rows (keys, task, actual, predicted); a task without truth or prediction gives none."""
    tasks = F.array(F.struct(F.lit("Polarity").alias("task"), F.col("actual").alias("actual"), F.col("predicted").alias("predicted")),
                    F.struct(F.lit("Subjectivity").alias("task"), F.col(subj_truth).alias("actual"), F.col(subj_pred).alias("predicted")))
    return pairs.select(*keys, F.explode(tasks).alias("x")).select(*keys, "x.*").where("actual is not null and predicted is not null")


def metrics_tables(stacked: DataFrame, keys=()) -> DataFrame:
    """E5 for every key: rows Precision / Recall / Accuracy / F1 Score, columns Polarity and Subjectivity (both macro), from
    rows (keys, task, actual, predicted); two aggregations whatever the number of keys and tasks."""
    aggregates = {f"{task}_{m}": c for task in ("Polarity", "Subjectivity")
                  for m, c in _summaries(False, F.col("task") == task).items()}
    classes = class_metrics(stacked, [*keys, "task"])
    wide = classes.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()])
    rows = F.array(*[F.struct(F.lit(label).alias("metric"), *[F.col(f"{task}_{m}").alias(task) for task in ("Polarity", "Subjectivity")])
                     for label, m in zip(METRIC_NAMES, ["precision", "recall", "accuracy", "f1"])])
    return wide.select(*keys, F.explode(rows).alias("x")).select(
        *keys, F.col("x.metric").alias("Evaluation Metrics"), "x.Polarity", "x.Subjectivity")


def metrics_table(polarity_pairs: DataFrame, subjectivity_pairs: DataFrame | None = None,
                  subj_truth: str = "actual_subj", subj_pred: str = "predicted_subj") -> DataFrame:
    """E5: rows Precision / Recall / Accuracy / F1 Score, columns Polarity and
    Subjectivity (both macro).

    With ``subjectivity_pairs=None`` both tasks are read from the same rows
    (``actual``/``predicted`` and ``subj_truth``/``subj_pred``)."""
    if subjectivity_pairs is None:
        return metrics_tables(stack_tasks(polarity_pairs, [], subj_truth, subj_pred))
    both = [p.select(F.lit(task).alias("task"), "actual", "predicted")
            for task, p in (("Polarity", polarity_pairs), ("Subjectivity", subjectivity_pairs))]
    return metrics_tables(both[0].unionByName(both[1]))


def labelled_pairs(posts: DataFrame, comments: DataFrame, keys=()) -> DataFrame:
    """E5/F6 from posts and comments: (kind, keys, task, actual, predicted) of every ``sentiment`` that has both the true and the
    predicted value of a task; predictions are reduced to their sign (X15)."""
    s = F.col("sentiment")
    both = [d.select(F.lit(kind).alias("kind"), *keys, s["actual polarity"].cast("int").alias("actual"),
                     N.make_int(s["polarity"]).alias("predicted"), s["actual subjectivity"].cast("int").alias("actual_subj"),
                     N.make_int(s["subjectivity"]).alias("predicted_subj")) for kind, d in (("post", posts), ("comment", comments))]
    return stack_tasks(both[0].unionByName(both[1]), ["kind", *keys])


def tag_metrics(df: DataFrame, model: str) -> DataFrame:
    """F8: rename the metric column, add the model name."""
    return df.withColumnRenamed("Evaluation Metrics", "Metric").withColumn("Model", F.lit(model))


def compare_models(tables) -> DataFrame:
    """Stack tagged metric tables."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def metric_matrix(stacked: DataFrame, models, value: str = "Polarity") -> DataFrame:
    """One row per metric, one column per model."""
    return stacked.groupBy("Metric").pivot("Model", list(models)).agg(F.first(value))
