"""Plain text and delimited files (S3-S5, S8, S9, S11) and title harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions import text as X
from .positions import numbered_lines

H1_PATTERN = r"<h1[^>]*>(.*?)</h1>"
ANCHOR_PATTERN = r"<a href=\"[^\"]*\">([^<]*)</a>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per line, stripped, with its file and its line number there (from 0), however files are split."""
    return numbered_lines(spark, path).select("file", "line_no", X.strip("value").alias("line"))


def write_lines(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    """S11 / titles: one value per line."""
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


def read_metrics(spark: SparkSession, paths) -> DataFrame:
    """Metric TSV files with a header."""
    return (spark.read.schema(SC.METRICS).option("sep", "\t").option("header", True)
            .csv(paths))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """train/test CSV (quoted multi-line text allowed)."""
    return (spark.read.schema(SC.TRAINING).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Header, RFC-4180 quoting (quotes doubled), any separator."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
     .csv(path))


def harvest_titles(pages: DataFrame, pattern: str = H1_PATTERN, id_col: str = "page_id",
                   html_col: str = "html") -> DataFrame:
    """Text of every title element of each page, stripped, with its position."""
    return (pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(pattern), 1))
                         .alias("k", "raw"))
            .select(id_col, F.col("k").cast("int").alias("k"), X.strip("raw").alias("title")))
