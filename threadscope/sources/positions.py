"""Positions within files: a file-wide line index that does not depend on how files are split.

A read partition holds whole byte ranges (splits) of files, each in file order.  A first narrow pass
counts the lines of every split; the counts of a file's earlier splits are the offset of a
split, and a line's number is its split's offset and its place there.  The table of splits is
joined back by (file, start of the split): no key has more rows than a split has lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Columns that name the split a row was read from.
SPLIT = ["file", "split_start"]


def text_rows(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    """(file, split_start, value): the lines (or, if ``whole``, the files) of a path, with the split they were read from."""
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), "value")


def offsets(splits: DataFrame, counts: list[str]) -> DataFrame:
    """Sums of each count over a file's earlier splits, as ``<count>_before``; one row a split."""
    earlier = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(*SPLIT, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in counts])


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_no, value): every line with its number in its file, from 0."""
    rows = text_rows(spark, path).withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy(*SPLIT).agg(F.count("*").alias("lines"), F.min("_at").alias("_first")).checkpoint()
    found = splits.join(offsets(splits, ["lines"]), SPLIT)
    return rows.join(found, SPLIT).select("file", (F.col("lines_before") + F.col("_at") - F.col("_first")).alias("line_no"), "value")


def array_files(spark: SparkSession, path) -> list[str]:
    """Files that hold one JSON value over several lines: their first line with anything on it opens
    an array or object that does not end there.  Only first splits are looked at, and one row a file leaves the tasks."""
    line = X.strip("value")
    rows = (text_rows(spark, path).where((F.col("split_start") == 0) & (line != ""))
            .withColumn("_at", F.monotonically_increasing_id()))
    opens = (line == "{") | (line.startswith("[") & ~line.endswith("]") & F.try_parse_json(line).isNull())
    first = rows.groupBy("file").agg(F.min_by(opens, "_at").alias("opens"))
    return sorted(r["file"] for r in first.where("opens").select("file").collect())
