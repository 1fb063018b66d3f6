"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.session import ensure_checkpoint_dir

#: Words are runs of anything but the six ASCII blanks; ``bytes.split()`` on UTF-8 splits at the same places.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch, so that a worker's memory does not depend on the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches, a shared
    checkpoint folder, and this package on the Python workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table under the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, and lets shuffle files go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash128(*cols) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same columns, as one 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7919), *cols)
