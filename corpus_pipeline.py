"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
each stage's result is written as Parquet and read again as the next one's
input.  All but the last return the columns of ``documents``; the texts that a
stage changes are counted anew in ``n_chars``.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
have the results that the operators' own docstrings define: a null or empty text
fails the base rules of the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm import line_dedup, minhash, packing, quality, secret_scan
from threadscope.llm.base import prepare, table
from threadscope.llm.queries import vocabulary
from threadscope.session import ensure_checkpoint_dir


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with n_chars of the new texts."""
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
                            for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far out among their language and source go."""
    prepare(spark)
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood earlier in the corpus, but for one word at most, go."""
    prepare(spark)
    return with_text(docs, line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    prepare(spark)
    return minhash.keep_first(docs, k=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    prepare(spark)
    return with_text(docs, secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences of 1024."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_dedup),
          ("secret_scan", mask_secrets), ("packing", pack)]

#: SQL cannot express robust outliers and packing; tests hold the pipeline against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written under the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
