"""Payments and webhooks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .privacy import flag_asof

TERMINAL = ["Approved", "Failed", "Error"]

# Credit packages (id, credits, price in cents, currency).
PACKAGES = [("starter", 10, 1_500_000, "COP"), ("standard", 50, 6_000_000, "COP"), ("pro", 100, 10_000_000, "COP")]


def packages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKAGES, "package_id string, credits int, amount_in_cents long, currency string")


def attach_package(orders: DataFrame, package_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(known, rejected)``. The join is planned by the package table's size."""
    dim = package_table.select(F.lower("package_id").alias("_p"), F.col("package_id").alias("_canonical"), "credits", "amount_in_cents", "currency")
    joined = orders.join(dim, F.lower("package_id") == F.col("_p"), "left").drop("_p")
    known = joined.filter("_canonical is not null").withColumn("package_id", F.col("_canonical")).drop("_canonical")
    rejected = joined.filter("_canonical is null").select(*orders.columns, F.lit("PAYMENT/INVALID_PACKAGE").alias("error_code"))
    return known, rejected


def dedupe_checkouts(df: DataFrame, key: Column | None = None) -> DataFrame:
    """First checkout per idempotency key, by default ``user:package``."""
    key = key if key is not None else F.concat_ws(":", "user_id", "package_id")
    cols = df.columns
    first = F.min_by(F.struct(*cols), F.struct("created_at", "id"))
    return df.groupBy(key.alias("idempotency_key")).agg(first.alias("_c")).select("_c.*", "idempotency_key")


def hmac_sha256(payload: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text, from two built-in hashes over padded keys."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(payload, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def verify_hmac(events: DataFrame, secret: str, payload: str = "payload", signature: str = "signature") -> DataFrame:
    """Add ``valid_signature``; an empty secret or signature never verifies."""
    if not secret:
        return events.withColumn("valid_signature", F.lit(False))
    good = F.lower(signature) == hmac_sha256(F.col(payload), secret)
    return events.withColumn("valid_signature", F.coalesce(good, F.lit(False)))


def parse_webhooks(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Project the payload; markers are found anywhere in it, the first occurrence counts."""
    p = F.col(payload)

    def text_field(name: str) -> Column:
        # The last element keeps an empty value apart from a missing one.
        return F.get(F.regexp_extract_all(p, F.lit(f'"{name}":"([^"]*)"'), F.lit(1)), F.lit(0))

    rest = F.regexp_replace(p, r'(?s)^.*?"id": *', "")
    has_id = p.contains('"id":')
    quoted = F.when(rest.startswith('"'), F.when(rest.rlike(r'(?s)^"[^"]*"'), F.regexp_extract(rest, r'(?s)^"([^"]*)"', 1)))
    number = F.regexp_extract(rest, r"(?U)^([\d-]+)", 1)
    tx_id = F.when(has_id, F.when(rest.startswith('"'), quoted).otherwise(F.when(number != "", number)))
    status = (F.when(p.contains('"APPROVED"'), "Approved").when(p.contains('"DECLINED"'), "Failed")
              .when(p.contains('"ERROR"'), "Error").otherwise("Pending"))
    return events.withColumns({
        "event_type": text_field("event"), "transaction_id": tx_id, "payment_source_id": text_field("payment_source_id"),
        "charge_id": F.coalesce(text_field("charge_id"), text_field("payment_source_id")), "reason": text_field("reason"),
        "mapped_status": status,
        "is_recurring": F.coalesce(text_field("event").isin("recurring_charge.successful", "recurring_charge.failed"), F.lit(False)),
    })


def merge_payments(payments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5: ``(payments, rejected events)``. Terminal states stay; a pending payment takes its first terminal event.

    ``events(event_id, transaction_id, mapped_status, received_at)``. Replays of one transaction are reduced
    before the shuffle, so a hot transaction costs one row per task.
    """
    at = F.struct("received_at", "event_id")
    ended = F.col("mapped_status").isin(TERMINAL)
    per_tx = events.filter("transaction_id is not null").groupBy("transaction_id").agg(
        F.min_by(F.struct("mapped_status", "received_at"), F.when(ended, at)).alias("_first"), F.max(F.when(ended, 1).otherwise(0)).alias("_ended"),
        F.max("received_at").alias("_seen"))
    joined = payments.join(per_tx, payments["provider_tx_id"] == per_tx["transaction_id"], "left").drop("transaction_id")
    open_ = ~F.col("status").isin(TERMINAL)
    moves = open_ & (F.coalesce(F.col("_ended"), F.lit(0)) == 1)
    merged = joined.select(
        *[c for c in payments.columns if c not in ("status", "updated_at", "paid_at")],
        F.when(moves, F.col("_first.mapped_status")).otherwise(F.col("status")).alias("status"),
        F.when(moves, F.col("_first.received_at")).when(open_ & F.col("_seen").isNotNull(), F.col("_seen"))
        .otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(moves & (F.col("_first.mapped_status") == "Approved"), F.col("_first.received_at")).otherwise(F.col("paid_at")).alias("paid_at"))
    known = payments.select(F.col("provider_tx_id").alias("transaction_id")).distinct()
    lost = events.filter("transaction_id is not null").join(known, "transaction_id", "left_anti").withColumn("error_code", F.lit("PAYMENT/NOT_FOUND"))
    blank = events.filter("transaction_id is null").withColumn("error_code", F.lit("PAYMENT/INVALID_PAYLOAD"))
    return merged, lost.unionByName(blank)


def fan_out_approved(payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ledger entries, invoice requests)`` of approved payments, both keyed so that a rerun adds nothing."""
    ok = payments.filter("status = 'Approved'")
    entries = ok.select("user_id", F.lit("Purchase").alias("reason"), F.concat(F.lit("payment:"), "id").alias("reference"),
                        F.col("credits").cast("long").alias("delta"), F.col("paid_at").alias("created_at"))
    invoices = ok.select(F.col("id").cast("string").alias("reference"), "user_id", F.lit("Invoice").alias("kind"), "amount_in_cents", "currency",
                         F.lit("Draft").alias("status"), F.col("paid_at").alias("created_at"))
    return entries, invoices


def gated_fan_out(payments: DataFrame, flag: Column, changes: DataFrame, defaults: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P6 behind F1: ``(ledger entries, invoice requests, rejected)``. An approved payment is invoiced regardless; it is
    credited only while its flag is on at ``paid_at``. One whose flag is unknown is not credited and is rejected."""
    ok = payments.filter("status = 'Approved'").withColumns({"flag": flag, "at": F.col("paid_at")})
    known, unknown = flag_asof(ok, changes, defaults)
    entries, _ = fan_out_approved(known.filter("value").drop("flag", "at", "value"))
    return entries, fan_out_approved(payments)[1], unknown.drop("flag", "at")


def stale_pending(payments: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """P7."""
    cutoff = as_of - F.expr(f"interval {minutes} minutes")
    return payments.filter((F.col("status") == "Pending") & F.col("provider_tx_id").isNotNull() & (F.col("created_at") <= cutoff))


def reconcile(stale: DataFrame, provider_status: DataFrame, as_of: Column) -> DataFrame:
    """Changed payments only. ``provider_status(transaction_id, status)``."""
    mapped = (F.when(F.col("_s") == "APPROVED", "Approved").when(F.col("_s") == "DECLINED", "Failed")
              .when(F.col("_s") == "ERROR", "Error").otherwise("Pending"))
    known = provider_status.filter("status is not null").select("transaction_id", F.col("status").alias("_s"))
    joined = stale.join(known, stale["provider_tx_id"] == known["transaction_id"]).withColumn("_new", mapped)
    changed = joined.filter((F.col("_new") != "Pending") & (F.col("_new") != F.col("status")))
    return changed.withColumns({
        "status": F.col("_new"), "updated_at": as_of,
        "paid_at": F.when(F.col("_new") == "Approved", as_of).otherwise(F.col("paid_at")),
    }).select(*stale.columns)


def unsettled(payments: DataFrame, ledger: DataFrame, invoices: DataFrame) -> DataFrame:
    """Approved payments without ledger entry or invoice, ``(id, missing)``."""
    ok = payments.filter("status = 'Approved'").select(F.col("id").cast("string").alias("id"))
    credited = ledger.filter("reason = 'Purchase'").select(F.expr("substring(reference, 9)").alias("id"))
    no_credit = ok.join(credited, "id", "left_anti").withColumn("missing", F.lit("credit"))
    no_invoice = ok.join(invoices.select(F.col("reference").alias("id")), "id", "left_anti").withColumn("missing", F.lit("invoice"))
    return no_credit.unionByName(no_invoice)


def payment_page(payments: DataFrame, page: int, per_page: int) -> DataFrame:
    """P10: page ``page`` (from 1) of every user, newest first; ranks are limited before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = payments.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= page * per_page)
    return ranked.filter(F.col("rn") > (page - 1) * per_page)


def audit_payments(payments: DataFrame) -> DataFrame:
    """``(key, code)`` of violated constraints."""
    def repeated(col: str, code: str) -> DataFrame:
        return payments.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("key")).count().filter(
            "count > 1").select("key", F.lit(code).alias("code"))

    checks = F.array_compact(F.array(F.when(F.col("credits") <= 0, "CREDITS"), F.when(F.col("amount_in_cents") <= 0, "AMOUNT")))
    rows = payments.select(F.col("id").cast("string").alias("key"), F.explode(checks).alias("code"))
    return rows.unionByName(repeated("idempotency_key", "IDEMPOTENCY_KEY")).unionByName(repeated("provider_tx_id", "TRANSACTION_ID"))
