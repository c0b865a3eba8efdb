"""Credit ledger (G1-G8). Entries: ``id, user_id, reason, reference, delta, created_at``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.segmented import Running, running, time_bucket

ORDER = ["created_at", "id"]
WELCOME_CREDITS = 3


def entries_from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``events(id, user_id, kind, ref, amount, created_at)`` to ``(ledger entries, rejected events)``.

    Kinds: welcome, purchase, consumption, batch_consumption, refund, manual. Events of another kind, or none, are
    rejected with a code.
    """
    kind, ref, amount = F.col("kind"), F.col("ref"), F.col("amount")
    reason = (F.when(kind == "welcome", "Welcome").when(kind == "purchase", "Purchase")
              .when(kind.isin("consumption", "batch_consumption"), "Consumption")
              .when(kind == "refund", "Refund").when(kind == "manual", "ManualAdjustment"))
    reference = (F.when(kind == "welcome", F.concat(F.lit("welcome:"), "user_id"))
                 .when(kind == "purchase", F.concat(F.lit("payment:"), ref))
                 .when(kind == "consumption", F.concat(F.lit("adapt:"), ref))
                 .when(kind == "batch_consumption", F.concat(F.lit("iterate:"), ref))
                 .when(kind == "refund", F.concat(F.lit("adapt:"), ref, F.lit(":refund")))
                 .when(kind == "manual", F.concat(F.lit("admin:"), ref)))
    delta = (F.when(kind == "welcome", F.lit(WELCOME_CREDITS)).when(kind == "purchase", amount)
             .when(kind == "consumption", F.lit(-1)).when(kind == "batch_consumption", -amount)
             .when(kind == "refund", F.lit(1)).when(kind == "manual", amount))
    known = events.filter(reason.isNotNull())
    entries = known.select("id", "user_id", reason.alias("reason"), reference.alias("reference"), delta.cast("long").alias("delta"), "created_at")
    return entries, events.filter(reason.isNull()).withColumn("error_code", F.lit("UNKNOWN_KIND"))


def first_entries(entries: DataFrame) -> DataFrame:
    """First entry per (user, reason, reference). The minimum combines before the shuffle."""
    cols = [c for c in entries.columns if c not in ("user_id", "reason", "reference")]
    first = F.min_by(F.struct(*cols), F.struct(*ORDER))
    return entries.groupBy("user_id", "reason", "reference").agg(first.alias("_e")).select(
        "user_id", "reason", "reference", "_e.*").select(*entries.columns)


def running_balance(entries: DataFrame, opening: DataFrame | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """``balance_after`` per user in (created_at, id) order; a user's history is summed per time bucket."""
    spec = Running("balance_after", "sum", F.col("delta"))
    out = running(entries, ["user_id"], ORDER, time_bucket("created_at", bucket_seconds), [spec])
    if opening is None:
        return out
    start = opening.select("user_id", F.col("balance").alias("_open"))
    joined = out.join(start, "user_id", "left")
    return joined.withColumn("balance_after", F.col("balance_after") + F.coalesce("_open", F.lit(0))).drop("_open")


def entry_code() -> Column:
    """Why an entry is rejected whatever the balance; null if it is not."""
    return F.when(F.coalesce("delta", F.lit(0)) == 0, "ZERO_DELTA").when(tx.is_blank(F.col("reference")), "BLANK_REFERENCE")


_VERDICT = "user_id string, id string, created_at timestamp, balance_after long, error_code string"


def _fold_sorted(batches):
    """Fold rows sorted by (user, created_at, id), carrying only a balance and the keys seen more than once."""
    user, balance, accepted = None, 0, set()
    for batch in batches:
        out_balance, out_code = [], []
        for row_user, opening, delta, repeated, reason, reference in zip(
                batch["user_id"], batch["opening"], batch["delta"], batch["repeated"], batch["reason"], batch["reference"]):
            if row_user != user:
                user, balance, accepted = row_user, int(opening), set()
            key = (reason, reference)
            if repeated and key in accepted:
                out_balance.append(balance)
                out_code.append("DUPLICATE")
            elif balance + delta < 0:
                out_balance.append(balance)
                out_code.append("NEGATIVE_BALANCE")
            else:
                balance += int(delta)
                if repeated:
                    accepted.add(key)
                out_balance.append(balance)
                out_code.append(None)
        yield pd.DataFrame({"user_id": batch["user_id"], "id": batch["id"], "created_at": batch["created_at"],
                            "balance_after": out_balance, "error_code": out_code})


def apply_entries(entries: DataFrame, opening: DataFrame | None = None,
                  bucket_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """G1: ``(accepted, rejected)``.

    Per user in (created_at, id) order: a zero delta, a blank reference or a debit below zero is rejected with
    a code; an entry whose (reason, reference) was accepted before is a ``DUPLICATE``. A debit rejected once may
    be accepted when it comes again.

    Only a user whose running balance, over first entries, would ever fall below zero needs the ordered
    fold. All others, whatever their size, take the bucketed running sum. The fold reads rows sorted in their
    partition and holds no history.
    """
    start = opening.select("user_id", F.col("balance").alias("opening")) if opening is not None else None
    coded = entries.withColumn("error_code", entry_code())
    bad = coded.filter("error_code is not null").withColumn("balance_after", F.lit(None).cast("long"))
    good = coded.filter("error_code is null").drop("error_code")

    ids = good.groupBy("user_id", "reason", "reference").agg(
        F.min(F.struct(*ORDER)).alias("_first"), (F.count(F.lit(1)) > 1).alias("repeated"))
    marked = good.join(ids, ["user_id", "reason", "reference"]).withColumn(
        "_is_first", F.struct(*ORDER) == F.col("_first")).drop("_first")
    balanced = running_balance(marked.withColumn("delta", F.when(F.col("_is_first"), F.col("delta")).otherwise(0)), opening, bucket_seconds)
    lowest = balanced.groupBy("user_id").agg((F.min("balance_after") < 0).alias("_short"))
    short = lowest.filter("_short").select("user_id")

    safe = balanced.join(short, "user_id", "left_anti").withColumn(
        "error_code", F.when(~F.col("_is_first"), "DUPLICATE")).select("user_id", "id", "created_at", "balance_after", "error_code")
    folding = marked.join(short, "user_id", "left_semi")
    folding = folding.withColumn("opening", F.lit(0)) if start is None else folding.join(
        start, "user_id", "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    types = dict(good.dtypes)
    schema = f"user_id {types['user_id']}, id {types['id']}, created_at {types['created_at']}, balance_after long, error_code string"
    folded = (
        folding.select("user_id", "id", "created_at", "opening", "delta", "repeated", "reason", "reference")
        .repartition("user_id").sortWithinPartitions("user_id", *ORDER).mapInPandas(_fold_sorted, schema)
    )
    verdict = safe.unionByName(folded).drop("created_at")
    done = good.join(verdict, ["user_id", "id"]).unionByName(bad.select(*good.columns, "balance_after", "error_code"))
    accepted = done.filter("error_code is null").drop("error_code")
    return accepted, done.filter("error_code is not null")


def valid_refunds(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: a refund needs an earlier consumption of the same request, once."""
    used = entries.filter("reason = 'Consumption'").groupBy("user_id", F.concat("reference", F.lit(":refund")).alias("reference")).agg(
        F.min(F.struct(*ORDER)).alias("_used"))
    refunds = entries.filter("reason = 'Refund'")
    first = refunds.groupBy("user_id", "reference").agg(F.min(F.struct(*ORDER)).alias("_first_any"))
    rows = refunds.join(used, ["user_id", "reference"], "left").withColumn("_at", F.struct(*ORDER))
    prior = rows.withColumn("_ok", F.coalesce(F.col("_used") < F.col("_at"), F.lit(False)))
    first = prior.filter("_ok").groupBy("user_id", "reference").agg(F.min("_at").alias("_first"))
    checked = prior.join(first, ["user_id", "reference"], "left")
    code = F.when(~F.col("_ok"), "NO_PRIOR_CONSUMPTION").when(F.col("_at") != F.col("_first"), "ALREADY_REFUNDED")
    out = checked.withColumn("error_code", code).select(*entries.columns, "error_code")
    return out.filter("error_code is null").drop("error_code"), out.filter("error_code is not null")


def balance_view(entries: DataFrame, as_of: Column) -> DataFrame:
    """Latest ``balance_after`` and consumptions of the 7 days up to ``as_of`` per user."""
    recent = (F.col("reason") == "Consumption") & (F.col("created_at") >= as_of - F.expr("interval 7 days"))
    return entries.groupBy("user_id").agg(
        F.max_by("balance_after", F.struct(*ORDER)).alias("balance"), F.count_if(recent).alias("consumed_7d"))


def cursor(created_at: Column, id_: Column) -> Column:
    """Opaque cursor of a row: base64 of ``ticks:id``, ticks being 100 ns since year 1."""
    ticks = F.unix_micros(created_at) * 10 + F.lit(621_355_968_000_000_000)
    return F.base64(F.encode(F.concat_ws(":", ticks.cast("string"), id_.cast("string")), "UTF-8"))


def history_page(entries: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """One page per user, newest first, with ``next_cursor`` when more rows follow.

    ``cursors(user_id, cursor)`` continues behind a row; an unreadable cursor starts anew. The limit is
    clamped to 1..200 and one row is looked ahead; ranks are limited before the shuffle. Rows of one instant are
    ordered by their id as text, as the cursor holds it, so pages neither skip nor repeat a row.
    """
    limit = min(max(limit, 1), 200)
    rows = entries
    if cursors is not None:
        raw = F.decode(F.try_to_binary("cursor", F.lit("base64")), "UTF-8")
        parts = cursors.select("user_id", F.regexp_extract(raw, r"^(-?\d+):", 1).try_cast("long").alias("_ticks"),
                               F.regexp_extract(raw, r"^-?\d+:(.*)\z", 1).alias("_id"))
        parts = parts.filter("_ticks is not null")
        at = F.timestamp_micros(F.expr("(_ticks - 621355968000000000L) div 10"))
        rows = rows.join(parts.select("user_id", at.alias("_at"), "_id"), "user_id", "left").filter(
            F.col("_at").isNull() | (F.col("created_at") < F.col("_at"))
            | ((F.col("created_at") == F.col("_at")) & (F.col("id").cast("string") < F.col("_id")))).drop("_at", "_id")
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").cast("string").desc())
    ranked = rows.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= limit + 1)
    more = F.lead("id").over(newest).isNotNull() & (F.col("rn") == limit)
    return ranked.withColumn("next_cursor", F.when(more, cursor(F.col("created_at"), F.col("id")))).filter(F.col("rn") <= limit)


def spend_eligibility(balances: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(request_id, user_id, required)``; users without ledger have balance 0."""
    rows = requests.join(balances.select("user_id", "balance"), "user_id", "left").na.fill(0, ["balance"])
    return rows.select("request_id", "user_id", "required", "balance", (F.col("balance") >= F.col("required")).alias("eligible"),
                       F.greatest(F.col("required") - F.col("balance"), F.lit(0)).alias("shortfall"))


def audit_ledger(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Violations only, ``(user_id, code)``."""
    per_user = entries.groupBy("user_id").agg(
        F.sum("delta").alias("total"), F.max_by("balance_after", F.struct(*ORDER)).alias("last"),
        F.count_if(F.col("delta") == 0).alias("zero"), F.count_if(F.col("balance_after") < 0).alias("negative"))
    joined = users.select("user_id", "credit_balance").join(per_user, "user_id", "full_outer")
    balance = F.coalesce("credit_balance", F.lit(0))
    codes = F.array_compact(F.array(
        F.when(balance != F.coalesce("total", F.lit(0)), "BALANCE_NOT_SUM"),
        F.when(F.col("last").isNotNull() & (balance != F.col("last")), "BALANCE_NOT_LAST"),
        F.when(F.col("zero") > 0, "ZERO_DELTA"),
        F.when((F.col("negative") > 0) | (balance < 0), "NEGATIVE_BALANCE")))
    keys = entries.groupBy("user_id", "reason", "reference").count().filter("count > 1").select(
        "user_id", F.lit("DUPLICATE_KEY").alias("code")).distinct()
    return joined.select("user_id", F.explode(codes).alias("code")).unionByName(keys)
