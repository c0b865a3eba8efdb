"""Invoices and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segmented import Running, running, time_bucket

# Document prefixes and the automatic range.
PREFIXES = {"Invoice": "FV", "CreditNote": "NC", "SupportDocument": "DS"}
RANGE_FROM, RANGE_TO = 1, 99_999_999


def document_kind(docs: DataFrame, invoice_prefix: str = PREFIXES["Invoice"]) -> DataFrame:
    """Prefix of each document kind."""
    return docs.withColumn("prefix", F.when(F.col("kind") == "CreditNote", PREFIXES["CreditNote"])
                           .when(F.col("kind") == "SupportDocument", PREFIXES["SupportDocument"]).otherwise(invoice_prefix))


def number_documents(docs: DataFrame, ranges: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Gap-free ``number`` per prefix in (created_at, id) order, continuing each range; a prefix without
    range starts at 1. One prefix may hold all documents: it is counted per time bucket."""
    seq = running(docs, ["prefix"], ["created_at", "id"], time_bucket("created_at", bucket_seconds), [Running("_n", "count")])
    start = ranges.select("prefix", F.col("current").cast("long").alias("_current"))
    no = F.coalesce("_current", F.lit(RANGE_FROM - 1).cast("long")) + F.col("_n")
    return seq.join(start, "prefix", "left").withColumn("no", no).withColumn(
        "number", F.format_string("%s-%08d", "prefix", "no")).drop("_n", "_current")


def invoices_from_payments(payments: DataFrame) -> DataFrame:
    """One draft per approved payment."""
    return payments.filter("status = 'Approved'").select(
        F.col("id").cast("string").alias("reference"), "user_id", F.lit("Invoice").alias("kind"), "amount_in_cents", "currency",
        F.lit("Draft").alias("status"), F.concat_ws(" ", F.col("credits").cast("string"), F.lit("credits")).alias("description"),
        F.col("paid_at").alias("created_at"))


def audit_numbering(invoices: DataFrame, ranges: DataFrame, block: int = 100_000) -> DataFrame:
    """I4: ``(prefix, no, code)`` for numbers out of range, used twice, or preceded by a gap.

    Gaps are found inside blocks of numbers; the first number of a block is compared with the last of the
    preceding one, so a prefix is never ordered in one task.
    """
    dim = ranges.select("prefix", "from_no", "to_no")
    used = invoices.groupBy("prefix", "no").agg(F.count(F.lit(1)).alias("n")).join(dim, "prefix", "left")
    low, high = F.coalesce("from_no", F.lit(RANGE_FROM)), F.coalesce("to_no", F.lit(RANGE_TO))
    outside = used.filter(~F.col("no").between(low, high)).select("prefix", "no", F.lit("OUT_OF_RANGE").alias("code"))
    twice = used.filter("n > 1").select("prefix", "no", F.lit("DUPLICATE").alias("code"))
    cut = used.select("prefix", "no", F.floor(F.col("no") / block).alias("_b"))
    inner = Window.partitionBy("prefix", "_b").orderBy("no")
    gap_in = cut.withColumn("_p", F.lag("no").over(inner)).filter(F.col("_p") < F.col("no") - 1).select("prefix", "no")
    edges = cut.groupBy("prefix", "_b").agg(F.min("no").alias("no"), F.max("no").alias("_last"))
    outer = Window.partitionBy("prefix").orderBy("_b")
    gap_out = edges.withColumn("_p", F.lag("_last").over(outer)).filter(F.col("_p") < F.col("no") - 1).select("prefix", "no")
    gaps = gap_in.unionByName(gap_out).withColumn("code", F.lit("GAP_BEFORE"))
    return outside.unionByName(twice).unionByName(gaps)
