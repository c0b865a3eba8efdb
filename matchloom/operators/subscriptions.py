"""Subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.segmented import Running, running, time_bucket

# Plan -> (credits per month, price), period, lead and retry rules.
PLANS = {"Starter": (30, 30_000), "Standard": (100, 80_000)}
PERIOD_DAYS = 30
CHARGE_DAYS = 27
RETRY_DELAY_DAYS = [1, 3, 7]
MAX_RETRIES = 3


def _plan(col: Column, which: int) -> Column:
    out = F.lit(0)
    for name, values in PLANS.items():
        out = F.when(col == name, F.lit(values[which])).otherwise(out)
    return out


def _days(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def create_subscriptions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests(id, user_id, plan, payment_source_id, at)`` to ``(subscriptions, rejected)``."""
    blank = tx.is_blank(F.col("payment_source_id"))
    made = requests.filter(~blank).select(
        "id", "user_id", "plan", "payment_source_id", F.lit("Active").alias("status"), F.col("at").alias("started_at"),
        F.col("at").alias("period_start"), (F.col("at") + _days(PERIOD_DAYS)).alias("period_end"),
        (F.col("at") + _days(CHARGE_DAYS)).alias("next_charge_at"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("canceled_at"), F.lit(None).cast("timestamp").alias("last_charge_at"),
        _plan(F.col("plan"), 0).alias("credits_per_month"), _plan(F.col("plan"), 1).cast("decimal(18,2)").alias("price"))
    return made, requests.filter(blank).withColumn("error_code", F.lit("PAYMENT_SOURCE_REQUIRED"))


def fold_charges(subs: DataFrame, events: DataFrame, delays: list[int] | None = None,
                 bucket_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """``(states, errors)``.

    ``events(event_id, subscription_id, outcome, at)`` with outcome success, failure or cancel. The state
    machine has no memory but the failures since the last success and the successes so far, so the state
    after each event comes from running counts: the third failure in a row or the first cancel ends the
    subscription, and every later charge is an error row. Counts are bucketed by time; a subscription with
    very many events is not one task.
    """
    delays = delays or RETRY_DELAY_DAYS
    known = subs.select(F.col("id").alias("subscription_id"), F.col("retry_count").alias("_r0"), F.col("status").alias("_s0"))
    ev = events.join(known, "subscription_id")
    order, bucket = ["at", "event_id"], time_bucket("at", bucket_seconds)
    fail, good = (F.col("outcome") == "failure").cast("long"), (F.col("outcome") == "success").cast("long")
    counted = running(ev, ["subscription_id"], order, bucket, [Running("_fails", "sum", fail), Running("_goods", "sum", good)])
    # Failures up to the last success; before any success the failures carried in count as well.
    counted = counted.withColumn("_mark", F.when(F.col("outcome") == "success", F.col("_fails")))
    marked = running(counted, ["subscription_id"], order, bucket, [Running("_base", "last", F.col("_mark"))])
    in_row = F.col("_fails") - F.coalesce(F.col("_base"), -F.col("_r0").cast("long"))
    marked = marked.withColumn("_in_row", in_row)
    ends = (F.col("outcome") == "cancel") | ((F.col("outcome") == "failure") & (F.col("_in_row") >= MAX_RETRIES))
    end = marked.filter(ends).groupBy("subscription_id").agg(F.min(F.struct(*order)).alias("_end"))
    staged = marked.join(end, "subscription_id", "left")
    ended_before = (F.col("_s0") == "Canceled") | F.coalesce(F.struct(*order) > F.col("_end"), F.lit(False))
    staged = staged.withColumn("_late", ended_before)
    errors = staged.filter(F.col("_late") & (F.col("outcome") != "cancel")).select(
        "subscription_id", "event_id", "outcome", "at", F.lit("SUBSCRIPTION/INVALID_TRANSITION").alias("error_code"))

    live = staged.filter(~F.col("_late"))
    last = live.groupBy("subscription_id").agg(
        F.max(F.struct(*order, "outcome", "_in_row", "_goods")).alias("l"),
        F.max(F.when(F.col("outcome") == "success", F.col("at"))).alias("_charged"),
        F.min("_end").alias("_end"))
    joined = subs.join(last, subs["id"] == last["subscription_id"], "left").drop("subscription_id")
    any_ = F.col("l").isNotNull()
    ended = any_ & F.col("_end").isNotNull()
    n = F.coalesce(F.col("l._goods"), F.lit(0)).cast("int")
    in_row_end = F.least(F.col("l._in_row"), F.lit(MAX_RETRIES - 1)).cast("int")
    period_end = F.col("period_end") + _days(n * PERIOD_DAYS)
    delay = F.element_at(F.array(*[F.lit(d) for d in delays]), F.greatest(F.col("l._in_row").cast("int"), F.lit(1)))
    retry = F.when(~any_, F.col("retry_count")).otherwise(F.greatest(in_row_end, F.lit(0)))
    state = {
        "status": F.when(~any_, F.col("status")).when(ended, "Canceled").when(F.col("l.outcome") == "success", "Active")
        .when(F.col("l.outcome") == "failure", "PastDue").otherwise(F.col("status")),
        "period_start": F.when(n > 0, F.col("period_end") + _days((n - 1) * PERIOD_DAYS)).otherwise(F.col("period_start")),
        "period_end": period_end,
        "last_charge_at": F.coalesce("_charged", "last_charge_at"),
        "next_charge_at": F.when(~any_, F.col("next_charge_at")).when(ended, F.lit(None).cast("timestamp"))
        .when(F.col("l.outcome") == "success", F.col("period_end") + _days((n - 1) * PERIOD_DAYS + CHARGE_DAYS))
        .otherwise(F.col("l.at") + _days(delay)),
        "retry_count": retry,
        "canceled_at": F.when(ended, F.col("_end.at")).otherwise(F.col("canceled_at")),
    }
    return joined.select(*[state[c].alias(c) if c in state else F.col(c) for c in subs.columns]), errors


def charges_from_webhooks(webhooks: DataFrame, subs: DataFrame, bucket_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """U2 from P4: ``(charges, rejected)``. ``webhooks(event_id, event_type, payment_source_id, charge_id, is_recurring,
    received_at)`` are verified and parsed; ``charges(event_id, subscription_id, outcome, at)`` suit ``fold_charges``.

    A charge belongs to the subscription that its payment source was last given to at or before the charge. A webhook
    that comes again, by its charge id or else by its event id, counts once, for whom it first belonged to. Charges
    without a payment source or without an owner at their time are rejected with a code; other webhooks are left out.

    Replays are reduced before the shuffle. Charges and starts are merged in time per payment source and the last owner
    is carried along, bucket by bucket, so a source with most charges is not one task.
    """
    recurring = webhooks.filter("is_recurring")
    kept = ["event_id", "event_type", "payment_source_id", "received_at"]
    blank = recurring.filter(tx.is_blank(F.col("payment_source_id"))).select(*kept).groupBy("event_id").agg(
        F.min_by(F.struct(*kept[1:]), F.struct("received_at", "event_type")).alias("_w")).select("event_id", "_w.*")
    named = F.col("charge_id").isNotNull() & (F.col("charge_id") != F.col("payment_source_id"))
    key = F.when(named, F.struct(F.lit("charge").alias("by"), F.col("charge_id").alias("key"))).otherwise(
        F.struct(F.lit("event").alias("by"), F.col("event_id").cast("string").alias("key")))
    once = recurring.filter(~tx.is_blank(F.col("payment_source_id"))).groupBy("payment_source_id", "event_type", key.alias("_key")).agg(
        F.min(F.struct("received_at", "event_id")).alias("_first"))
    once = once.select("_first.event_id", "event_type", "payment_source_id", "_first.received_at")
    rows = once.select("*", F.col("received_at").alias("_at"), F.lit(1).alias("_o"), F.lit("").alias("_id"), F.lit(None).cast("string").alias("_sub")).unionByName(
        subs.select("payment_source_id", F.col("started_at").alias("_at"), F.lit(0).alias("_o"), F.col("id").cast("string").alias("_id"),
                    F.col("id").cast("string").alias("_sub")), allowMissingColumns=True)
    owned = running(rows, ["payment_source_id"], ["_at", "_o", "_id"], time_bucket("_at", bucket_seconds), [Running("_owner", "last", F.col("_sub"))]).filter("_o = 1")
    outcome = F.when(F.col("event_type") == "recurring_charge.successful", "success").otherwise("failure")
    charges = owned.filter("_owner is not null").select(
        "event_id", F.col("_owner").cast(subs.schema["id"].dataType).alias("subscription_id"), outcome.alias("outcome"), F.col("received_at").alias("at"))
    rejected = blank.withColumn("error_code", F.lit("PAYMENT/INVALID_PAYLOAD")).unionByName(
        owned.filter("_owner is null").select(*kept, F.lit("SUBSCRIPTION/NOT_FOUND").alias("error_code")))
    return charges, rejected


def due_for_retry(subs: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """U4: the report of the ``limit`` earliest past-due subscriptions."""
    due = subs.filter((F.col("status") == "PastDue") & (F.col("next_charge_at") <= as_of))
    return due.orderBy("next_charge_at", "id").limit(limit)


def current_subscription(subs: DataFrame, include_canceled: bool) -> DataFrame:
    """Latest start per user."""
    rows = subs if include_canceled else subs.filter("status <> 'Canceled'")
    latest = F.max_by(F.struct(*subs.columns), F.struct("started_at", "id"))
    return rows.groupBy("user_id").agg(latest.alias("s")).select("s.*")


def overlapping_subscriptions(subs: DataFrame) -> DataFrame:
    """Users with more than one subscription that is not canceled."""
    return subs.filter("status <> 'Canceled'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cancel(subs: DataFrame, requests: DataFrame) -> DataFrame:
    """Cancel each user's latest subscription; canceled ones stay as they are and access lasts to the period end."""
    first = requests.groupBy("user_id").agg(F.min("at").alias("_at"))
    latest = subs.groupBy("user_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("_latest"))
    joined = subs.join(latest.join(first, "user_id"), "user_id", "left")
    hit = (F.col("id") == F.col("_latest")) & (F.col("status") != "Canceled")
    hit = F.coalesce(hit, F.lit(False))
    return joined.withColumns({
        "status": F.when(hit, "Canceled").otherwise(F.col("status")),
        "canceled_at": F.when(hit, F.col("_at")).otherwise(F.col("canceled_at")),
        "next_charge_at": F.when(hit, F.lit(None).cast("timestamp")).otherwise(F.col("next_charge_at")),
    }).select(*subs.columns)


def grants(subs: DataFrame, events: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Ledger entries per creation and per successful charge, keyed on the charge so a replay adds nothing."""
    credits = _plan(F.col("plan"), 0).cast("long")
    made = subs.select("user_id", F.lit("Purchase").alias("reason"), F.concat(F.lit("subscription:"), "id").alias("reference"),
                       credits.alias("delta"), F.col("started_at").alias("created_at"))
    good = events.filter("outcome = 'success'")
    if errors is not None:
        good = good.join(errors.select("event_id"), "event_id", "left_anti")
    charged = good.join(subs.select(F.col("id").alias("subscription_id"), "user_id", "plan"), "subscription_id").select(
        "user_id", F.lit("Purchase").alias("reason"), F.concat_ws(":", F.lit("subscription"), "subscription_id", "event_id").alias("reference"),
        credits.alias("delta"), F.col("at").alias("created_at"))
    return made.unionByName(charged)
