"""Keyword rules and lexicon sentiment on a stream of posts.

The reference has no streaming operator.  The enrichment operators are
stateless row-level expressions (the lexicon is an inlined literal map), so
they run unchanged on ``readStream``; the checkpoint lives under the shared
checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import keywords as K
from ..functions import text as X
from ..operators import enrich as EN
from ..session import scratch_path


def enrich_stream(stream: DataFrame, lexicon=None) -> DataFrame:
    """Row-level enrichment (X1-X5, X13, M4) of a post stream."""
    full = X.full_text("title", "text")
    d = stream.withColumn("_full", full)
    d = EN.lexicon_sentiment(d, "_full", lexicon if lexicon is not None else None, "sentiment")
    return d.select(
        "post_id", K.label_post("_full").alias("label"),
        F.array_join(K.detect_platform("_full"), ",").alias("platforms"),
        K.detect_severity("_full").alias("severity"),
        F.array_join(K.keywords_found("_full"), ",").alias("bug_keywords"),
        K.has_any("_full", rules.RESOLVED_KEYWORDS).alias("is_resolved"),
        F.col("sentiment.polarity").alias("polarity"))


def run_enrichment(spark: SparkSession, source_dir: str, schema, sink_dir: str,
                   fmt: str = "parquet", checkpoint: str | None = None) -> None:
    """Process everything available in ``source_dir`` once (availableNow) and
    append enriched rows to ``sink_dir``."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = (enrich_stream(src).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .option("path", sink_dir).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
