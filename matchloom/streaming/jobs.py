"""Structured Streaming forms (W1-W3, W7; those with keyed state are in ``state``). Each returns a ``DataStreamWriter`` or a streaming DataFrame built from
the same columns as its batch operator; the caller sets checkpoint, trigger and sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import INJECTION_PATTERNS
from ..operators import text


def dedupe_webhooks(stream: DataFrame, keys: list[str], at: str = "received_at", delay: str = "1 day") -> DataFrame:
    """One event per key; state older than the watermark is dropped, so a replay within the delay is caught."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def quota_counts(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls per key and tumbling window of ``(key, at)``; later events than the watermark are dropped."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", window).alias("w"), "key").agg(
        F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def weekly_consumption(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Consumptions per user in 7-day windows sliding by a day, over ledger entries."""
    used = stream.filter("reason = 'Consumption'").withWatermark("created_at", delay)
    return used.groupBy(F.window("created_at", "7 days", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


# --- W7 -------------------------------------------------------------------------------------------


def screened_documents(stream: DataFrame, patterns: list[str] | None = None, col: str = "text") -> DataFrame:
    """Stateless part for new documents: over-long ones rejected, personal data redacted, hostile ones marked. A document is
    read and redacted once; its verdict is worked out from what came of it."""
    long = F.coalesce(F.length(col), F.lit(0)) > text.MAX_REDACT_CHARS
    redacted = stream.withColumn("_long", long).withColumn(col, F.when(F.col("_long"), F.col(col)).otherwise(text.redacted(F.col(col))))
    rows = tx.evaluated(redacted, *redacted.columns)
    hostile = text.hostile(F.col(col), patterns if patterns is not None else INJECTION_PATTERNS)
    verdict = F.when(F.col("_long"), "rejected").when(hostile, "quarantined").otherwise("clean")
    return rows.withColumn("verdict", verdict).drop("_long")


def score_writer(path: str, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that scores each batch of documents with a batch operator."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return apply
