"""Ledger, payment, subscription and invoice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import invoices as inv
from ..operators import ledger, payments as pay, subscriptions as sub
from . import common as c

AS_OF = "2024-01-20 00:00:00"
PAY_AS_OF = "2000-06-01 00:04:00"
START = "2024-01-01 00:00:00"
SECRET = "shared-secret"


def ts(text):
    return F.lit(text).cast("timestamp")


def us(name):
    return F.coalesce(F.unix_micros(name), F.lit(-1)).alias(name)


# --- inputs ---------------------------------------------------------------------------------------


def ledger_events(spark, sf):
    e = c.table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "signup", "welcome").when(F.col("event_type") == "purchase", "purchase")
            .when(F.col("event_type") == "click", "consumption").when(F.col("event_type") == "error", "refund")
            .when(F.col("event_id") % 5 == 0, "batch_consumption"))
    ref = F.when(F.col("event_type").isin("click", "error"), F.col("event_id") % 200).otherwise(F.col("event_id")).cast("string")
    return e.select(
        F.col("event_id").alias("id"), "user_id", kind.alias("kind"), ref.alias("ref"),
        F.when(F.col("event_type") == "purchase", 10).otherwise(7).alias("amount"), F.col("ts").alias("created_at"))


def entries(spark, sf):
    return ledger.entries_from_events(ledger_events(spark, sf))[0]


def payments(spark, sf):
    o = c.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "F", "Approved").otherwise("Failed")
    package = F.element_at(F.array(F.lit("STARTER"), F.lit("standard"), F.lit("Pro"), F.lit("gold")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), package.alias("package_id"), F.lit(10).alias("credits"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_in_cents"), F.lit("COP").alias("currency"), status.alias("status"),
        F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("tx"), "o_orderkey")).alias("provider_tx_id"),
        F.concat_ws(":", "o_custkey", package).alias("idempotency_key"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"), F.when(status == "Approved", F.col("o_orderdate")).alias("paid_at"))


def webhooks(spark, sf):
    li = c.table(spark, sf, "lineitem")
    word = F.element_at(F.array(F.lit("PENDING"), F.lit("APPROVED"), F.lit("DECLINED"), F.lit("ERROR")), F.col("l_linenumber") % 4 + 1)
    payload = F.when(F.col("l_linenumber") == 5, F.concat(F.lit('{"event":"recurring_charge.failed","payment_source_id":"ps'), "l_orderkey", F.lit('","reason":"funds"}'))).otherwise(
        F.concat(F.lit('{"event":"transaction.updated","data":{"id": "tx'), "l_orderkey", F.lit('","status":"'), word, F.lit('"}}')))
    good = pay.hmac_sha256(F.col("payload"), SECRET)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), payload.alias("payload"), F.col("l_shipdate").alias("received_at"),
                     F.col("l_partkey")).withColumn("signature", F.when(F.col("l_partkey") % 7 == 0, F.lit("00")).otherwise(good))


def subscriptions(spark, sf):
    users = c.table(spark, sf, "events").select("user_id").distinct()
    requests = users.select(
        F.concat(F.lit("s"), "user_id").alias("id"), "user_id", F.when(F.col("user_id") % 2 == 0, "Starter").otherwise("Standard").alias("plan"),
        F.when(F.col("user_id") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("ps"), "user_id")).alias("payment_source_id"), ts(START).alias("at"))
    return sub.create_subscriptions(requests)


def charges(spark, sf):
    e = c.table(spark, sf, "events")
    outcome = (F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure")
               .when((F.col("event_type") == "signup") & (F.col("event_id") % 37 == 0), "cancel"))
    return e.select("event_id", F.concat(F.lit("s"), "user_id").alias("subscription_id"), outcome.alias("outcome"), F.col("ts").alias("at")).filter("outcome is not null")


def _prefix():
    return F.concat(F.lit("P"), F.left("o_orderpriority", F.lit(1)))


def ranges(spark):
    return spark.createDataFrame([("P1", 1, 9_999_999, 100), ("P2", 50, 400, 49)], "prefix string, from_no int, to_no int, current int")


# --- ledger ---------------------------------------------------------------------------------------


def g1(spark, sf):
    ok, bad = ledger.apply_entries(entries(spark, sf))
    ok = ok.select("id", "user_id", "delta", "balance_after", F.lit("ACCEPTED").alias("verdict"))
    return ok.unionByName(bad.select("id", "user_id", "delta", "balance_after", F.col("error_code").alias("verdict")))


def g2(spark, sf):
    return ledger.running_balance(entries(spark, sf)).select("id", "user_id", "balance_after")


def g3(spark, sf):
    ok, bad = ledger.entries_from_events(ledger_events(spark, sf))
    return ok.select("id", "user_id", "reason", "reference", "delta", F.lit("").alias("error_code")).unionByName(
        bad.select("id", "user_id", F.lit("").alias("reason"), F.lit("").alias("reference"), F.lit(0).cast("long").alias("delta"), "error_code"))


def g4(spark, sf):
    ok, bad = ledger.valid_refunds(entries(spark, sf))
    return ok.select("id", F.lit("VALID").alias("verdict")).unionByName(bad.select("id", F.col("error_code").alias("verdict")))


def _balanced(spark, sf):
    return ledger.running_balance(entries(spark, sf))


def g5(spark, sf):
    return ledger.balance_view(_balanced(spark, sf), ts(AS_OF))


def g6(spark, sf):
    first = ledger.history_page(_balanced(spark, sf), 5)
    cursors = first.filter("next_cursor is not null").select("user_id", F.col("next_cursor").alias("cursor"))
    second = ledger.history_page(_balanced(spark, sf), 5, cursors).join(cursors, "user_id", "left_semi")
    pages = first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))
    return pages.select("user_id", "page", "rn", "id", F.col("next_cursor").isNotNull().alias("more"))


def g7(spark, sf):
    requests = c.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 400).alias("user_id"), (F.col("c_custkey") % 200).alias("required"))
    return ledger.spend_eligibility(ledger.balance_view(_balanced(spark, sf), ts(AS_OF)), requests)


def g8(spark, sf):
    users = _balanced(spark, sf).groupBy("user_id").agg((F.sum("delta") + F.when(F.col("user_id") % 9 == 0, 1).otherwise(0)).alias("credit_balance"))
    return ledger.audit_ledger(_balanced(spark, sf), users)


# --- payments -------------------------------------------------------------------------------------


def p1(spark, sf):
    orders = payments(spark, sf).select("id", "package_id")
    ok, bad = pay.attach_package(orders, pay.packages(spark))
    return ok.select("id", "package_id", "credits", "amount_in_cents", F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("id", "package_id", F.lit(None).cast("int").alias("credits"), F.lit(None).cast("long").alias("amount_in_cents"), "error_code")).na.fill(-1)


def p2(spark, sf):
    rows = payments(spark, sf).drop("idempotency_key")
    return pay.dedupe_checkouts(rows).select("id", "idempotency_key")


def p3(spark, sf):
    return pay.verify_hmac(webhooks(spark, sf), SECRET).select("event_id", "signature", "valid_signature")


def p4(spark, sf):
    return pay.parse_webhooks(webhooks(spark, sf)).select(
        "event_id", "event_type", "transaction_id", "payment_source_id", "charge_id", "reason", "mapped_status", "is_recurring")


def _merged(spark, sf):
    read = pay.parse_webhooks(pay.verify_hmac(webhooks(spark, sf), SECRET))
    read = tx.evaluated(read, "event_id", "transaction_id", "mapped_status", "received_at", "valid_signature", "is_recurring")
    parsed = read.filter("valid_signature and not is_recurring").drop("valid_signature", "is_recurring")
    return pay.merge_payments(payments(spark, sf), parsed)


def p5(spark, sf):
    return _merged(spark, sf)[0].select("id", "status", us("updated_at"), us("paid_at"))


def p5_rejected(spark, sf):
    return _merged(spark, sf)[1].select("event_id", "error_code")


def p6(spark, sf):
    credit, invoices = pay.fan_out_approved(_merged(spark, sf)[0])
    return credit.select(F.lit("ledger").alias("target"), "user_id", "reference", F.col("delta").alias("amount"), us("created_at")).unionByName(
        invoices.select(F.lit("invoice").alias("target"), "user_id", "reference", F.col("amount_in_cents").alias("amount"), us("created_at")))


def p6_gated(spark, sf):
    """A failed payment switches the flag of its users' group: on if its id is even."""
    paid = _merged(spark, sf)[0]
    changes = payments(spark, sf).filter("status = 'Failed'").select(
        "id", F.concat(F.lit("f"), F.col("user_id") % 7).alias("flag"), F.col("created_at").alias("changed_at"), (F.col("id") % 2 == 0).alias("new_value"))
    defaults = spark.createDataFrame([("f1", True), ("f2", False)], "name string, default_value boolean")
    group = F.when(F.col("user_id") % 7 < 6, F.concat(F.lit("f"), F.col("user_id") % 7)).otherwise("f9")
    credit, invoices, lost = pay.gated_fan_out(paid, group, changes, defaults)
    return credit.select(F.lit("ledger").alias("target"), "reference").unionByName(invoices.select(F.lit("invoice").alias("target"), "reference")).unionByName(
        lost.select(F.col("error_code").alias("target"), F.col("id").cast("string").alias("reference")))


def p7(spark, sf):
    return pay.stale_pending(payments(spark, sf), ts(PAY_AS_OF)).select("id", "user_id", us("created_at"))


def p8(spark, sf):
    word = F.element_at(F.array(F.lit("APPROVED"), F.lit("DECLINED"), F.lit("ERROR"), F.lit("PENDING"), F.lit(None)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    provider = c.table(spark, sf, "orders").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"), word.alias("status"))
    out = pay.reconcile(pay.stale_pending(payments(spark, sf), ts(PAY_AS_OF)), provider, ts(PAY_AS_OF))
    return out.select("id", "status", us("updated_at"), us("paid_at"))


def p9(spark, sf):
    rows = payments(spark, sf)
    credit, invoices = pay.fan_out_approved(rows)
    return pay.unsettled(rows, credit.filter("delta > 0 and user_id % 3 <> 0"), invoices.filter("user_id % 4 <> 0"))


def p10(spark, sf):
    return pay.payment_page(payments(spark, sf), 2, 3).select("id", "user_id", "rn")


def p11(spark, sf):
    rows = payments(spark, sf).withColumns({
        "credits": F.when(F.col("id") % 50 == 0, 0).otherwise(F.col("credits")),
        "provider_tx_id": F.when(F.col("id") % 30 == 1, F.lit("tx1")).otherwise(F.col("provider_tx_id"))})
    return pay.audit_payments(rows)


# --- subscriptions --------------------------------------------------------------------------------


def u1(spark, sf):
    ok, bad = subscriptions(spark, sf)
    return ok.select("id", "status", us("period_end"), us("next_charge_at"), "credits_per_month", F.col("price").cast("double").alias("price"), F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("period_end"), F.lit(None).cast("long").alias("next_charge_at"),
                   F.lit(None).cast("int").alias("credits_per_month"), F.lit(None).cast("double").alias("price"), "error_code")).na.fill(-1)


def _folded(spark, sf):
    return sub.fold_charges(subscriptions(spark, sf)[0], charges(spark, sf))


def u2(spark, sf):
    return _folded(spark, sf)[0].select("id", "status", "retry_count", us("period_start"), us("period_end"), us("last_charge_at"), us("next_charge_at"), us("canceled_at"))


def recurring(spark, sf):
    """``(subscriptions, webhooks)``: two users share a payment source, the odd one later; signed webhooks of its charges,
    some of them delivered twice."""
    e = c.table(spark, sf, "events")
    start = ts(START) + F.make_dt_interval(F.when(F.col("user_id") % 2 == 1, F.col("user_id") % 10 + 1).otherwise(F.when(F.col("user_id") % 7 == 0, 9).otherwise(0)).cast("int"))
    source = F.concat(F.lit("ps"), F.floor(F.col("user_id") / 2).cast("string"))
    subs = sub.create_subscriptions(e.select("user_id").distinct().select(
        F.concat(F.lit("s"), "user_id").alias("id"), "user_id", F.lit("Starter").alias("plan"), source.alias("payment_source_id"), start.alias("at")))[0]
    good = F.concat(F.lit('{"event":"recurring_charge.successful","payment_source_id":"'), source, F.lit('","charge_id":"ch'), F.col("event_id").cast("string"), F.lit('"}'))
    bad = F.when(F.col("event_id") % 53 == 0, F.lit('{"event":"recurring_charge.failed","reason":"funds"}')).otherwise(
        F.concat(F.lit('{"event":"recurring_charge.failed","payment_source_id":"'), source, F.lit('","reason":"funds"}')))
    sent = e.filter("event_type in ('purchase', 'error')").select(
        F.col("event_id").cast("long"), F.when(F.col("event_type") == "purchase", good).otherwise(bad).alias("payload"), F.col("ts").alias("received_at"))
    again = sent.filter("event_id % 3 = 0").select(
        F.when(F.col("payload").contains("charge_id"), -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("event_id"), "payload",
        (F.col("received_at") + F.expr("interval 2 days")).alias("received_at"))
    first = F.when(F.col("event_id") < 0, -F.col("event_id") - 1).otherwise(F.col("event_id"))
    signature = F.when(first % 41 == 0, F.lit("00")).otherwise(pay.hmac_sha256(F.col("payload"), SECRET))
    return subs, pay.parse_webhooks(pay.verify_hmac(sent.unionByName(again).withColumn("signature", signature), SECRET)).filter("valid_signature")


def u2_charges(spark, sf):
    subs, hooks = recurring(spark, sf)
    charges, rejected = sub.charges_from_webhooks(hooks, subs)
    return charges.select("event_id", "subscription_id", "outcome", us("at"), F.lit("").alias("error_code")).unionByName(
        rejected.select("event_id", F.lit("").alias("subscription_id"), F.when(F.col("event_type").endswith("successful"), "success").otherwise("failure").alias("outcome"),
                        F.unix_micros("received_at").alias("at"), "error_code"))


def u2_from_webhooks(spark, sf):
    subs, hooks = recurring(spark, sf)
    states, _ = sub.fold_charges(subs, sub.charges_from_webhooks(hooks, subs)[0])
    return states.select("id", "status", "retry_count", us("period_end"), us("last_charge_at"), us("canceled_at"))


def u3(spark, sf):
    return _folded(spark, sf)[1].select("event_id", "subscription_id", "outcome", "error_code")


def past_due(spark, sf):
    o = c.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PastDue").when(F.col("o_orderstatus") == "F", "Canceled").otherwise("Active")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"),
                    (F.col("o_orderdate") + F.expr("interval 27 days")).alias("next_charge_at"), F.lit(None).cast("timestamp").alias("canceled_at"))


def u4(spark, sf):
    return sub.due_for_retry(past_due(spark, sf), ts(PAY_AS_OF)).select("id", us("next_charge_at"))


def u5(spark, sf):
    rows = past_due(spark, sf)
    return sub.current_subscription(rows, True).select("user_id", "id", F.lit("any").alias("mode")).unionByName(
        sub.current_subscription(rows, False).select("user_id", "id", F.lit("open").alias("mode")))


def u5_overlaps(spark, sf):
    return sub.overlapping_subscriptions(past_due(spark, sf))


def u6(spark, sf):
    requests = c.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), ts(PAY_AS_OF).alias("at"))
    return sub.cancel(past_due(spark, sf), requests).select("id", "status", us("canceled_at"), us("next_charge_at"))


def u7(spark, sf):
    return sub.grants(subscriptions(spark, sf)[0], charges(spark, sf), _folded(spark, sf)[1]).select("user_id", "reference", "delta", us("created_at"))


# --- invoices -------------------------------------------------------------------------------------


def _approved(spark, sf):
    return c.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), _prefix().alias("prefix"), F.col("o_orderdate").alias("created_at"))


def i1(spark, sf):
    return inv.number_documents(_approved(spark, sf), ranges(spark), 86_400 * 90).select("id", "prefix", "no", "number")


def i2(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "Invoice").when(F.col("o_orderstatus") == "O", "CreditNote").otherwise("SupportDocument")
    return inv.document_kind(c.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind")))


def i3(spark, sf):
    return inv.invoices_from_payments(payments(spark, sf)).select("reference", "user_id", "amount_in_cents", "description", us("created_at"))


def i4(spark, sf):
    rows = c.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(_prefix().alias("prefix"), F.floor(F.col("o_orderkey") * 3 / 4).alias("no"))
    return inv.audit_numbering(rows, ranges(spark), 1000)


QUERIES = {
    "g1_apply_entries": g1, "g2_running_balance": g2, "g3_entries_from_events": g3, "g4_valid_refunds": g4, "g5_balance_view": g5,
    "g6_history_page": g6, "g7_spend_eligibility": g7, "g8_audit_ledger": g8,
    "p1_attach_package": p1, "p2_dedupe_checkouts": p2, "p3_verify_hmac": p3, "p4_parse_webhooks": p4, "p5_merge_payments": p5,
    "p5_rejected_webhooks": p5_rejected, "p6_fan_out_approved": p6, "p6_gated_fan_out": p6_gated, "p7_stale_pending": p7, "p8_reconcile": p8, "p9_unsettled": p9,
    "p10_payment_page": p10, "p11_audit_payments": p11,
    "u1_create_subscriptions": u1, "u2_fold_charges": u2, "u2_charges_from_webhooks": u2_charges, "u2_from_webhooks": u2_from_webhooks, "u3_illegal_transitions": u3, "u4_due_for_retry": u4,
    "u5_current_subscription": u5, "u5_overlapping_subscriptions": u5_overlaps, "u6_cancel": u6, "u7_grants": u7,
    "i1_number_documents": i1, "i2_document_kind": i2, "i3_invoices_from_payments": i3, "i4_audit_numbering": i4,
}

# --- SQL ------------------------------------------------------------------------------------------

_ENT = """WITH RECURSIVE raw AS (SELECT event_id AS id, user_id, event_type AS t, event_id % 5 = 0 AS fifth, ts AS created_at,
      CASE WHEN event_type IN ('click', 'error') THEN event_id % 200 ELSE event_id END AS ref FROM events),
    ent AS (SELECT id, user_id, created_at,
      CASE t WHEN 'signup' THEN 'Welcome' WHEN 'purchase' THEN 'Purchase' WHEN 'error' THEN 'Refund' ELSE 'Consumption' END AS reason,
      CASE t WHEN 'signup' THEN 'welcome:' || user_id WHEN 'purchase' THEN 'payment:' || ref WHEN 'click' THEN 'adapt:' || ref
        WHEN 'error' THEN 'adapt:' || ref || ':refund' ELSE 'iterate:' || ref END AS reference,
      CAST(CASE t WHEN 'signup' THEN 3 WHEN 'purchase' THEN 10 WHEN 'click' THEN -1 WHEN 'error' THEN 1 ELSE -7 END AS BIGINT) AS delta
      FROM raw WHERE t IN ('signup', 'purchase', 'click', 'error') OR fifth),
    bal AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY created_at, id) AS BIGINT) AS balance_after FROM ent)"""
_VIEW = f""",  view AS (SELECT user_id, arg_max(balance_after, id) AS balance,
    count(*) FILTER (WHERE reason = 'Consumption' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS consumed_7d FROM bal GROUP BY user_id)"""
_PAY = """pays AS (SELECT o_orderkey AS id, o_custkey AS user_id, ['STARTER', 'standard', 'Pro', 'gold'][o_orderkey % 4 + 1] AS package_id,
      10 AS credits, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_in_cents,
      CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Approved' ELSE 'Failed' END AS status,
      CASE WHEN o_orderkey % 10 <> 0 THEN 'tx' || o_orderkey END AS provider_tx_id, o_orderdate AS created_at,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS paid_at FROM orders)"""
_HOOK = """hooks AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_shipdate AS received_at, l_partkey % 7 <> 0 AS good, l_linenumber = 5 AS recurring,
      'tx' || l_orderkey AS tx, ['Pending', 'Approved', 'Failed', 'Error'][l_linenumber % 4 + 1] AS mapped, l_orderkey,
      CASE WHEN l_linenumber = 5 THEN '{"event":"recurring_charge.failed","payment_source_id":"ps' || l_orderkey || '","reason":"funds"}'
        ELSE '{"event":"transaction.updated","data":{"id": "tx' || l_orderkey || '","status":"' || ['PENDING', 'APPROVED', 'DECLINED', 'ERROR'][l_linenumber % 4 + 1] || '"}}' END AS payload
      FROM lineitem)"""
_MERGE = f"""WITH {_PAY}, {_HOOK},
    ev AS (SELECT * FROM hooks WHERE good AND NOT recurring),
    firsts AS (SELECT tx, mapped, received_at FROM ev WHERE mapped <> 'Pending' QUALIFY row_number() OVER (PARTITION BY tx ORDER BY received_at, event_id) = 1),
    seen AS (SELECT tx, max(received_at) AS last_at FROM ev GROUP BY tx),
    merged AS (SELECT p.id, p.user_id, p.credits, p.amount_in_cents,
      CASE WHEN p.status = 'Pending' THEN coalesce(mapped, 'Pending') ELSE p.status END AS status,
      CASE WHEN p.status = 'Pending' THEN coalesce(received_at, last_at, created_at) ELSE created_at END AS updated_at,
      CASE WHEN p.status = 'Pending' AND mapped = 'Approved' THEN received_at ELSE paid_at END AS paid_at
      FROM pays p LEFT JOIN firsts f ON f.tx = provider_tx_id LEFT JOIN seen s ON s.tx = provider_tx_id)"""
_IPAD = "".join(f"\\x{(b ^ 0x36):02X}" for b in SECRET.encode().ljust(64, b"\0"))
_OPAD = "".join(f"\\x{(b ^ 0x5C):02X}" for b in SECRET.encode().ljust(64, b"\0"))
_SUBS = f"""subs AS (SELECT DISTINCT 's' || user_id AS id, user_id, CASE WHEN user_id % 2 = 0 THEN 'Starter' ELSE 'Standard' END AS plan FROM events),
    ch AS (SELECT event_id, 's' || user_id AS sid, ts AS at, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'cancel' END AS outcome,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
      WHERE user_id % 11 <> 0 AND (event_type IN ('purchase', 'error') OR (event_type = 'signup' AND event_id % 37 = 0))),
    walk AS (
      SELECT id AS sid, CAST(0 AS BIGINT) AS rn, 'Active' AS status, 0 AS retry, 0 AS n, NULL::TIMESTAMP AS charged, TIMESTAMP '{START}' + INTERVAL 27 DAY AS next_at,
        NULL::TIMESTAMP AS ended, CAST(NULL AS BIGINT) AS bad_event, '' AS bad_outcome FROM subs WHERE user_id % 11 <> 0
      UNION ALL
      SELECT w.sid, ch.rn,
        CASE WHEN status = 'Canceled' OR outcome = 'cancel' THEN 'Canceled' WHEN outcome = 'success' THEN 'Active' WHEN retry + 1 >= 3 THEN 'Canceled' ELSE 'PastDue' END,
        CASE WHEN status = 'Canceled' OR outcome = 'cancel' THEN retry WHEN outcome = 'success' THEN 0 WHEN retry + 1 >= 3 THEN retry ELSE retry + 1 END,
        CASE WHEN status <> 'Canceled' AND outcome = 'success' THEN n + 1 ELSE n END,
        CASE WHEN status <> 'Canceled' AND outcome = 'success' THEN ch.at ELSE charged END,
        CASE WHEN status = 'Canceled' OR outcome = 'cancel' THEN NULL WHEN outcome = 'success' THEN TIMESTAMP '{START}' + INTERVAL 30 DAY * (n + 1) + INTERVAL 27 DAY
          WHEN retry + 1 >= 3 THEN NULL ELSE ch.at + INTERVAL 1 DAY * (CASE retry WHEN 0 THEN 1 ELSE 3 END) END,
        CASE WHEN status = 'Canceled' THEN ended WHEN outcome = 'cancel' OR (outcome = 'failure' AND retry + 1 >= 3) THEN ch.at END,
        CASE WHEN status = 'Canceled' AND outcome <> 'cancel' THEN ch.event_id END, outcome
      FROM walk w JOIN ch ON ch.sid = w.sid AND ch.rn = w.rn + 1)"""
_REC = f"""subs AS (SELECT DISTINCT 's' || user_id AS id, 'ps' || CAST(floor(user_id / 2) AS BIGINT) AS source,
      TIMESTAMP '{START}' + INTERVAL 1 DAY * CAST(CASE WHEN user_id % 2 = 1 THEN user_id % 10 + 1 WHEN user_id % 7 = 0 THEN 9 ELSE 0 END AS INTEGER) AS started FROM events),
    sent AS (SELECT event_id, 'ps' || CAST(floor(user_id / 2) AS BIGINT) AS source, ts AS at, CASE event_type WHEN 'purchase' THEN 'success' ELSE 'failure' END AS outcome,
      event_type = 'error' AND event_id % 53 = 0 AS unnamed FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 41 <> 0),
    named AS (SELECT event_id, sent.at, outcome, unnamed, arg_max(id, started) AS sid FROM sent LEFT JOIN subs s ON sent.source = s.source AND sent.at >= s.started GROUP BY ALL),
    owned AS (SELECT * REPLACE (CASE WHEN NOT unnamed THEN sid END AS sid) FROM named),
    ch AS (SELECT event_id, sid, owned.at, outcome, row_number() OVER (PARTITION BY sid ORDER BY owned.at, event_id) AS rn FROM owned WHERE sid IS NOT NULL)"""
_REC_WALK = f"""{_REC}, walk AS (
      SELECT id AS sid, CAST(0 AS BIGINT) AS rn, 'Active' AS status, 0 AS retry, 0 AS n, NULL::TIMESTAMP AS charged, NULL::TIMESTAMP AS ended, started FROM subs
      UNION ALL
      SELECT w.sid, ch.rn, CASE WHEN status = 'Canceled' THEN 'Canceled' WHEN outcome = 'success' THEN 'Active' WHEN retry + 1 >= 3 THEN 'Canceled' ELSE 'PastDue' END,
        CASE WHEN status = 'Canceled' THEN retry WHEN outcome = 'success' THEN 0 WHEN retry + 1 >= 3 THEN retry ELSE retry + 1 END,
        CASE WHEN status <> 'Canceled' AND outcome = 'success' THEN n + 1 ELSE n END, CASE WHEN status <> 'Canceled' AND outcome = 'success' THEN ch.at ELSE charged END,
        CASE WHEN status = 'Canceled' THEN ended WHEN outcome = 'failure' AND retry + 1 >= 3 THEN ch.at END, started
      FROM walk w JOIN ch ON ch.sid = w.sid AND ch.rn = w.rn + 1)"""
_OLD = """old AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'PastDue' WHEN 'F' THEN 'Canceled' ELSE 'Active' END AS status,
    o_orderdate AS started_at, o_orderdate + INTERVAL 27 DAY AS next_charge_at FROM orders)"""
_GAPS = """used AS (SELECT 'P' || left(o_orderpriority, 1) AS prefix, CAST(floor(o_orderkey * 3 / 4) AS BIGINT) AS no, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"""

ORACLES = {
    "g1_apply_entries": f"""{_ENT}, seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn FROM ent),
      fold AS (
        SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS balance, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS delta, '' AS verdict
        FROM (SELECT DISTINCT user_id FROM ent)
        UNION ALL
        SELECT s.user_id, s.rn,
          CASE WHEN NOT list_contains(held, reason || reference) AND balance + s.delta >= 0 THEN balance + s.delta ELSE balance END,
          CASE WHEN NOT list_contains(held, reason || reference) AND balance + s.delta >= 0 THEN list_append(held, reason || reference) ELSE held END, s.id, s.delta,
          CASE WHEN list_contains(held, reason || reference) THEN 'DUPLICATE' WHEN balance + s.delta < 0 THEN 'NEGATIVE_BALANCE' ELSE 'ACCEPTED' END
        FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
      SELECT id, user_id, delta, balance AS balance_after, verdict FROM fold WHERE id IS NOT NULL""",
    "g2_running_balance": f"{_ENT} SELECT id, user_id, balance_after FROM bal",
    "g3_entries_from_events": f"""{_ENT} SELECT id, user_id, reason, reference, delta, '' AS error_code FROM ent
        UNION ALL SELECT id, user_id, '', '', 0, 'UNKNOWN_KIND' FROM raw WHERE t NOT IN ('signup', 'purchase', 'click', 'error') AND NOT fifth""",
    "g4_valid_refunds": f"""{_ENT}, r AS (SELECT e.*, EXISTS (SELECT 1 FROM ent u WHERE u.user_id = e.user_id AND u.reason = 'Consumption'
          AND u.reference || ':refund' = e.reference AND (u.created_at, u.id) < (e.created_at, e.id)) AS ok FROM ent e WHERE reason = 'Refund')
        SELECT id, CASE WHEN NOT ok THEN 'NO_PRIOR_CONSUMPTION' WHEN row_number() OVER (PARTITION BY user_id, reference, ok ORDER BY created_at, id) = 1
          THEN 'VALID' ELSE 'ALREADY_REFUNDED' END AS verdict FROM r""",
    "g5_balance_view": f"{_ENT}{_VIEW} SELECT * FROM view",
    "g6_history_page": f"""{_ENT}, r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC) AS k,
          count(*) OVER (PARTITION BY user_id) AS n FROM bal)
        SELECT user_id, CAST((k - 1) // 5 + 1 AS INTEGER) AS page, CAST((k - 1) % 5 + 1 AS INTEGER) AS rn, id, k % 5 = 0 AND n > k AS more FROM r WHERE k <= 10""",
    "g7_spend_eligibility": f"""{_ENT}{_VIEW} SELECT c_custkey AS request_id, c_custkey % 400 AS user_id, c_custkey % 200 AS required, coalesce(balance, 0) AS balance,
        coalesce(balance, 0) >= c_custkey % 200 AS eligible, greatest(c_custkey % 200 - coalesce(balance, 0), 0) AS shortfall
        FROM customer LEFT JOIN view ON user_id = c_custkey % 400""",
    "g8_audit_ledger": f"""{_ENT} SELECT DISTINCT user_id, 'DUPLICATE_KEY' AS code FROM (SELECT user_id FROM ent GROUP BY user_id, reason, reference HAVING count(*) > 1)
        UNION ALL SELECT user_id, unnest(['BALANCE_NOT_SUM', 'BALANCE_NOT_LAST']) FROM (SELECT DISTINCT user_id FROM ent WHERE user_id % 9 = 0)
        UNION ALL SELECT user_id, 'NEGATIVE_BALANCE' FROM bal GROUP BY user_id HAVING min(balance_after) < 0 OR sum(delta) + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END < 0""",
    "p1_attach_package": f"""WITH {_PAY} SELECT id, coalesce(p, package_id) AS package_id, k.credits, k.cents AS amount_in_cents,
        CASE WHEN p IS NULL THEN 'PAYMENT/INVALID_PACKAGE' END AS error_code FROM pays LEFT JOIN (VALUES ('starter', 10, 1500000::BIGINT),
        ('standard', 50, 6000000::BIGINT), ('pro', 100, 10000000::BIGINT)) k(p, credits, cents) ON p = lower(package_id)""",
    "p2_dedupe_checkouts": f"""WITH {_PAY} SELECT id, user_id || ':' || package_id AS idempotency_key FROM pays
        QUALIFY row_number() OVER (PARTITION BY user_id, package_id ORDER BY created_at, id) = 1""",
    "p3_verify_hmac": f"""WITH {_HOOK} SELECT event_id, CASE WHEN good THEN sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode(payload)))) ELSE '00' END AS signature,
        good AS valid_signature FROM hooks""",
    "p4_parse_webhooks": f"""WITH {_HOOK} SELECT event_id, payload->>'$.event' AS event_type, payload->>'$.data.id' AS transaction_id,
        payload->>'$.payment_source_id' AS payment_source_id, payload->>'$.payment_source_id' AS charge_id, payload->>'$.reason' AS reason,
        CASE WHEN recurring THEN 'Pending' ELSE mapped END AS mapped_status, recurring AS is_recurring FROM hooks""",
    "p5_merge_payments": f"{_MERGE} SELECT id, status, epoch_us(updated_at) AS updated_at, epoch_us(paid_at) AS paid_at FROM merged",
    "p5_rejected_webhooks": f"{_MERGE} SELECT event_id, 'PAYMENT/NOT_FOUND' AS error_code FROM ev WHERE NOT EXISTS (SELECT 1 FROM pays WHERE provider_tx_id = tx)",
    "p6_fan_out_approved": f"""{_MERGE} SELECT 'ledger' AS target, user_id, 'payment:' || id AS reference, CAST(credits AS BIGINT) AS amount, epoch_us(paid_at) AS created_at FROM merged WHERE status = 'Approved'
        UNION ALL SELECT 'invoice', user_id, CAST(id AS VARCHAR), amount_in_cents, epoch_us(paid_at) FROM merged WHERE status = 'Approved'""",
    "p6_gated_fan_out": f"""{_MERGE}, ok AS (SELECT *, CASE WHEN user_id % 7 < 6 THEN 'f' || (user_id % 7) ELSE 'f9' END AS flag FROM merged WHERE status = 'Approved'),
        chg AS (SELECT 'f' || (user_id % 7) AS flag, created_at AS ts, arg_max(id % 2 = 0, id) AS v FROM pays WHERE status = 'Failed' GROUP BY ALL),
        flagged AS (SELECT id, coalesce(v, CASE ok.flag WHEN 'f1' THEN true WHEN 'f2' THEN false END) AS value FROM ok ASOF LEFT JOIN chg ON ok.flag = chg.flag AND ok.paid_at >= chg.ts)
        SELECT 'ledger' AS target, 'payment:' || id AS reference FROM flagged WHERE value
        UNION ALL SELECT 'invoice', CAST(id AS VARCHAR) FROM ok
        UNION ALL SELECT 'FLAG_NOT_FOUND', CAST(id AS VARCHAR) FROM flagged WHERE value IS NULL""",
    "p7_stale_pending": f"""WITH {_PAY} SELECT id, user_id, epoch_us(created_at) AS created_at FROM pays WHERE status = 'Pending' AND provider_tx_id IS NOT NULL
        AND created_at <= TIMESTAMP '{PAY_AS_OF}' - INTERVAL 5 MINUTE""",
    "p8_reconcile": f"""WITH {_PAY} SELECT id, ['Approved', 'Failed', 'Error'][id % 5 + 1] AS status, epoch_us(TIMESTAMP '{PAY_AS_OF}') AS updated_at,
        CASE WHEN id % 5 = 0 THEN epoch_us(TIMESTAMP '{PAY_AS_OF}') END AS paid_at FROM pays WHERE status = 'Pending' AND provider_tx_id IS NOT NULL
        AND created_at <= TIMESTAMP '{PAY_AS_OF}' - INTERVAL 5 MINUTE AND id % 5 < 3""",
    "p9_unsettled": f"""WITH {_PAY} SELECT CAST(id AS VARCHAR) AS id, 'credit' AS missing FROM pays WHERE status = 'Approved' AND user_id % 3 = 0
        UNION ALL SELECT CAST(id AS VARCHAR), 'invoice' FROM pays WHERE status = 'Approved' AND user_id % 4 = 0""",
    "p10_payment_page": f"""WITH {_PAY} SELECT id, user_id, rn FROM (SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rn FROM pays)
        WHERE rn BETWEEN 4 AND 6""",
    "p11_audit_payments": f"""WITH {_PAY}, t AS (SELECT id, amount_in_cents, user_id || ':' || package_id AS k, CASE WHEN id % 30 = 1 THEN 'tx1' ELSE provider_tx_id END AS tx FROM pays)
        SELECT CAST(id AS VARCHAR) AS key, 'CREDITS' AS code FROM t WHERE id % 50 = 0 UNION ALL SELECT CAST(id AS VARCHAR), 'AMOUNT' FROM t WHERE amount_in_cents <= 0
        UNION ALL SELECT k, 'IDEMPOTENCY_KEY' FROM t GROUP BY k HAVING count(*) > 1
        UNION ALL SELECT tx, 'TRANSACTION_ID' FROM t WHERE tx IS NOT NULL GROUP BY tx HAVING count(*) > 1""",
    "u1_create_subscriptions": f"""WITH RECURSIVE {_SUBS.split('ch AS')[0].rstrip().rstrip(',')} SELECT id, CASE WHEN ok THEN 'Active' END AS status,
        CASE WHEN ok THEN epoch_us(TIMESTAMP '{START}' + INTERVAL 30 DAY) END AS period_end, CASE WHEN ok THEN epoch_us(TIMESTAMP '{START}' + INTERVAL 27 DAY) END AS next_charge_at,
        CASE WHEN ok THEN CASE plan WHEN 'Starter' THEN 30 ELSE 100 END END AS credits_per_month, CASE WHEN ok THEN CASE plan WHEN 'Starter' THEN 30000.0::DOUBLE ELSE 80000.0::DOUBLE END END AS price,
        CASE WHEN NOT ok THEN 'PAYMENT_SOURCE_REQUIRED' END AS error_code FROM (SELECT *, user_id % 11 <> 0 AS ok FROM subs)""",
    "u2_fold_charges": f"""WITH RECURSIVE {_SUBS} SELECT sid AS id, status, retry AS retry_count,
        epoch_us(TIMESTAMP '{START}' + INTERVAL 30 DAY * n) AS period_start, epoch_us(TIMESTAMP '{START}' + INTERVAL 30 DAY * (n + 1)) AS period_end,
        epoch_us(charged) AS last_charge_at, epoch_us(next_at) AS next_charge_at, epoch_us(ended) AS canceled_at
        FROM walk QUALIFY row_number() OVER (PARTITION BY sid ORDER BY rn DESC) = 1""",
    "u2_charges_from_webhooks": f"""WITH {_REC} SELECT event_id, coalesce(sid, '') AS subscription_id, outcome, epoch_us(owned.at) AS at,
        CASE WHEN unnamed THEN 'PAYMENT/INVALID_PAYLOAD' WHEN sid IS NULL THEN 'SUBSCRIPTION/NOT_FOUND' ELSE '' END AS error_code FROM owned""",
    "u2_from_webhooks": f"""WITH RECURSIVE {_REC_WALK} SELECT sid AS id, status, retry AS retry_count, epoch_us(started + INTERVAL 30 DAY * (n + 1)) AS period_end,
        epoch_us(charged) AS last_charge_at, epoch_us(ended) AS canceled_at FROM walk QUALIFY row_number() OVER (PARTITION BY sid ORDER BY rn DESC) = 1""",
    "u3_illegal_transitions": f"""WITH RECURSIVE {_SUBS} SELECT bad_event AS event_id, sid AS subscription_id, bad_outcome AS outcome,
        'SUBSCRIPTION/INVALID_TRANSITION' AS error_code FROM walk WHERE bad_event IS NOT NULL""",
    "u4_due_for_retry": f"WITH {_OLD} SELECT id, epoch_us(next_charge_at) AS next_charge_at FROM old WHERE status = 'PastDue' AND next_charge_at <= TIMESTAMP '{PAY_AS_OF}' ORDER BY next_charge_at, id LIMIT 50",
    "u5_current_subscription": f"""WITH {_OLD} SELECT user_id, id, 'any' AS mode FROM old QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) = 1
        UNION ALL (SELECT user_id, id, 'open' FROM old WHERE status <> 'Canceled' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) = 1)""",
    "u5_overlapping_subscriptions": f"WITH {_OLD} SELECT user_id, count(*) AS n FROM old WHERE status <> 'Canceled' GROUP BY user_id HAVING count(*) > 1",
    "u6_cancel": f"""WITH {_OLD}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) = 1 AND user_id % 2 = 0 AND status <> 'Canceled'
          AND user_id IN (SELECT c_custkey FROM customer) AS hit FROM old)
        SELECT id, CASE WHEN hit THEN 'Canceled' ELSE status END AS status, CASE WHEN hit THEN epoch_us(TIMESTAMP '{PAY_AS_OF}') END AS canceled_at,
          CASE WHEN NOT hit THEN epoch_us(next_charge_at) END AS next_charge_at FROM r""",
    "u7_grants": f"""WITH RECURSIVE {_SUBS} SELECT user_id, 'subscription:' || id AS reference, CAST(CASE plan WHEN 'Starter' THEN 30 ELSE 100 END AS BIGINT) AS delta,
          epoch_us(TIMESTAMP '{START}') AS created_at FROM subs WHERE user_id % 11 <> 0
        UNION ALL SELECT user_id, 'subscription:' || sid || ':' || event_id, CAST(CASE plan WHEN 'Starter' THEN 30 ELSE 100 END AS BIGINT), epoch_us(ch.at)
        FROM ch JOIN subs ON id = sid WHERE outcome = 'success' AND event_id NOT IN (SELECT bad_event FROM walk WHERE bad_event IS NOT NULL)""",
    "i1_number_documents": """WITH d AS (SELECT o_orderkey AS id, 'P' || left(o_orderpriority, 1) AS prefix, o_orderdate AS made FROM orders WHERE o_orderstatus = 'F'),
        n AS (SELECT id, prefix, row_number() OVER (PARTITION BY prefix ORDER BY made, id) + CASE prefix WHEN 'P1' THEN 100 WHEN 'P2' THEN 49 ELSE 0 END AS no FROM d)
        SELECT id, prefix, no, prefix || '-' || lpad(CAST(no AS VARCHAR), 8, '0') AS number FROM n""",
    "i2_document_kind": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Invoice' WHEN 'O' THEN 'CreditNote' ELSE 'SupportDocument' END AS kind,
        CASE o_orderstatus WHEN 'F' THEN 'FV' WHEN 'O' THEN 'NC' ELSE 'DS' END AS prefix FROM orders""",
    "i3_invoices_from_payments": f"""WITH {_PAY} SELECT CAST(id AS VARCHAR) AS reference, user_id, amount_in_cents, '10 credits' AS description, epoch_us(paid_at) AS created_at
        FROM pays WHERE status = 'Approved'""",
    "i4_audit_numbering": f"""WITH {_GAPS} SELECT prefix, no, 'DUPLICATE' AS code FROM used WHERE n > 1
        UNION ALL SELECT prefix, no, 'OUT_OF_RANGE' FROM used WHERE no < CASE prefix WHEN 'P2' THEN 50 ELSE 1 END OR no > CASE prefix WHEN 'P1' THEN 9999999 WHEN 'P2' THEN 400 ELSE 99999999 END
        UNION ALL SELECT prefix, no, 'GAP_BEFORE' FROM (SELECT *, lag(no) OVER (PARTITION BY prefix ORDER BY no) AS p FROM used) WHERE p < no - 1""",
}

_NULLABLE = {
    "p1_attach_package": ["credits", "amount_in_cents"], "p5_merge_payments": ["updated_at", "paid_at"], "p8_reconcile": ["paid_at"],
    "u1_create_subscriptions": ["period_end", "next_charge_at", "credits_per_month", "price"],
    "u2_from_webhooks": ["last_charge_at", "canceled_at"], "u2_fold_charges": ["last_charge_at", "next_charge_at", "canceled_at"], "u6_cancel": ["canceled_at", "next_charge_at"],
}
for _name, _cols in _NULLABLE.items():
    ORACLES[_name] = c.sql_no_null(ORACLES[_name], *_cols)
