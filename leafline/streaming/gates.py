"""Gates over streams of documents: an extension, as findings are row-local or keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import style


def style_stream(docs: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Style findings of a stream, each fingerprint once within the watermark's delay.

    docs: (doc_id, text, ts). Bounded state: a fingerprint is forgotten once the watermark passes.
    """
    seen = style(docs.withColumn("doc_id", F.struct("doc_id", F.col(ts).alias("ts"))), path=F.col("doc_id.doc_id").cast("string"))
    flat = seen.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.ts").alias("ts"), "line_no", "rule", "excerpt", "token", "fingerprint")
    return flat.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def rule_counts(findings: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Findings of each rule in tumbling windows, late rows up to ``delay`` included."""
    return findings.withWatermark("ts", delay).groupBy(F.window("ts", window), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "rule", "n")
