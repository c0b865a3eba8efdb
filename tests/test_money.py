"""Ledger, payments, subscriptions, numbering, flags and quotas on small rows and against brute force."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import Window

from matchloom.functions.segmented import Running, running, time_bucket
from matchloom.operators import invoices, ledger, payments, privacy, subscriptions

T0 = datetime(2024, 1, 1)
ENTRY = "id long, user_id long, reason string, reference string, delta long, created_at timestamp"


def brute(rows):
    balance, held, out = {}, set(), {}
    for i, user, reason, ref, delta, at in sorted(rows, key=lambda r: (r[1], r[5], r[0])):
        now = balance.get(user, 0)
        if delta == 0:
            out[i] = "ZERO_DELTA"
        elif not ref.strip():
            out[i] = "BLANK_REFERENCE"
        elif (user, reason, ref) in held:
            out[i] = "DUPLICATE"
        elif now + delta < 0:
            out[i] = "NEGATIVE_BALANCE"
        else:
            balance[user] = now + delta
            held.add((user, reason, ref))
            out[i] = balance[user]
    return out


def test_ledger_fixture_and_random_histories(spark):
    rng = random.Random(3)
    rows = [(i, 1, "R", f"k{i}", d, T0 + timedelta(hours=i)) for i, d in enumerate([3, -1, -5, 2])]
    # One user holds a third of all rows; references repeat, so rejected debits come again.
    for i in range(10, 1500):
        user = 7 if i % 3 == 0 else rng.randint(10, 40)
        rows.append((i, user, rng.choice("AB"), rng.choice(["", *[f"k{j}" for j in range(60)]]), rng.choice([0, 4, 2, -1, -1, -3]),
                     T0 + timedelta(minutes=rng.randint(0, 20_000))))
    ok, bad = ledger.apply_entries(spark.createDataFrame(rows, ENTRY))
    got = {r["id"]: r["balance_after"] for r in ok.collect()} | {r["id"]: r["error_code"] for r in bad.collect()}
    assert got == brute(rows)
    assert [got[i] for i in range(4)] == [3, 2, "NEGATIVE_BALANCE", 4]


def test_pages_lose_no_row(spark):
    """Many rows at one instant, in 2024 and where ticks no longer fit a double."""
    rows = [(i, 1 + i % 2, datetime(2024 if i % 4 < 2 else 2031, 3, 1) + timedelta(microseconds=7 * (i // 9))) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp").coalesce(1).cache()
    seen, cursors = [], None
    while True:
        page = ledger.history_page(frame, 25, cursors).collect()
        page = page if cursors is None else [r for r in page if r["user_id"] in live]
        seen += [r["id"] for r in page]
        following = [(r["user_id"], r["next_cursor"]) for r in page if r["next_cursor"]]
        if not following:
            break
        live = {u for u, _ in following}
        cursors = spark.createDataFrame(following, "user_id long, cursor string")
    frame.unpersist()
    assert sorted(seen) == [r[0] for r in rows]


def test_unknown_events_are_rejected(spark):
    events = spark.createDataFrame([(1, 1, "welcome", None, None, T0), (2, 1, "gift", "x", 5, T0), (3, 1, None, "x", 5, T0)],
                                   "id long, user_id long, kind string, ref string, amount long, created_at timestamp")
    ok, bad = ledger.entries_from_events(events)
    assert [r["reference"] for r in ok.collect()] == ["welcome:1"] and {(r["id"], r["error_code"]) for r in bad.collect()} == {(2, "UNKNOWN_KIND"), (3, "UNKNOWN_KIND")}


def test_running_equals_window_under_any_partitioning(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaab"), rng.randint(-5, 5), T0 + timedelta(minutes=rng.randint(0, 9_000))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, v long, at timestamp")
    w = Window.partitionBy("k").orderBy("at", "id")
    want = {r["id"]: r for r in df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("p")).collect()}
    for parts in (1, 7, 60):
        specs = [Running("s", "sum", F.col("v")), Running("p", "last", F.col("v"), inclusive=False)]
        got = running(df.repartition(parts), ["k"], ["at", "id"], time_bucket("at", 3600), specs).collect()
        assert all((r["s"], r["p"]) == (want[r["id"]]["s"], want[r["id"]]["p"]) for r in got) and len(got) == len(rows)


def test_hmac(spark):
    body = '{"event":"transaction.updated","data":{"id": "tx1","status":"DECLINED"}}'
    sign = hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(1, body, sign.upper()), (2, body, "00")], "event_id long, payload string, signature string")
    assert [r["valid_signature"] for r in payments.verify_hmac(df, "k").orderBy("event_id").collect()] == [True, False]
    row = payments.parse_webhooks(df).first()
    assert (row["event_type"], row["transaction_id"], row["mapped_status"]) == ("transaction.updated", "tx1", "Failed")


def test_replay_keeps_terminal_state(spark):
    pay = spark.createDataFrame([(1, 1, "Pending", "t1", T0, T0, None, 10, 5, "COP"), (2, 1, "Pending", "t2", T0, T0, None, 10, 5, "COP")],
                                "id long, user_id long, status string, provider_tx_id string, created_at timestamp, updated_at timestamp, paid_at timestamp, credits int, amount_in_cents long, currency string")
    ev = spark.createDataFrame([(1, "t1", "Approved", T0 + timedelta(1)), (2, "t1", "Failed", T0 + timedelta(2)), (3, "zz", "Approved", T0), (4, "t2", "Pending", T0)],
                               "event_id long, transaction_id string, mapped_status string, received_at timestamp")
    merged, lost = payments.merge_payments(pay, ev)
    assert {r["id"]: (r["status"], r["paid_at"]) for r in merged.collect()} == {1: ("Approved", T0 + timedelta(1)), 2: ("Pending", None)}
    assert [r["error_code"] for r in lost.collect()] == ["PAYMENT/NOT_FOUND"]
    stale = payments.stale_pending(pay, F.lit(T0 + timedelta(minutes=5)))
    assert stale.count() == 2 and payments.stale_pending(pay, F.lit(T0 + timedelta(minutes=4))).count() == 0


def test_subscription_transitions(spark):
    made, _ = subscriptions.create_subscriptions(spark.createDataFrame(
        [(f"s{i}", i, "Starter", "ps", T0) for i in range(1, 5)], "id string, user_id long, plan string, payment_source_id string, at timestamp"))
    plan = {"s1": "f", "s2": "ff", "s3": "fffs", "s4": "ffsf"}
    events = [(n * 10 + j, s, {"f": "failure", "s": "success"}[c], T0 + timedelta(days=j + 1)) for n, (s, seq) in enumerate(plan.items()) for j, c in enumerate(seq)]
    states, errors = subscriptions.fold_charges(made, spark.createDataFrame(events, "event_id long, subscription_id string, outcome string, at timestamp"))
    got = {r["id"]: r for r in states.collect()}
    assert (got["s1"]["status"], got["s1"]["next_charge_at"], got["s1"]["retry_count"]) == ("PastDue", T0 + timedelta(2), 1)
    assert (got["s2"]["status"], got["s2"]["next_charge_at"]) == ("PastDue", T0 + timedelta(5))
    assert (got["s3"]["status"], got["s3"]["canceled_at"], got["s3"]["next_charge_at"]) == ("Canceled", T0 + timedelta(3), None)
    assert (got["s4"]["status"], got["s4"]["retry_count"], got["s4"]["period_end"]) == ("PastDue", 1, T0 + timedelta(60))
    assert [(r["subscription_id"], r["error_code"]) for r in errors.collect()] == [("s3", "SUBSCRIPTION/INVALID_TRANSITION")]


def test_numbering(spark):
    docs = invoices.document_kind(spark.createDataFrame(
        [(1, "Invoice", T0), (2, "Invoice", T0 + timedelta(2)), (3, "CreditNote", T0)], "id long, kind string, created_at timestamp"), "X")
    none = spark.createDataFrame([], "prefix string, from_no int, to_no int, current int")
    assert [r["number"] for r in invoices.number_documents(docs, none).orderBy("id").collect()] == ["X-00000001", "X-00000002", "NC-00000001"]


def test_flag_in_force(spark):
    reads = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + timedelta(1)), (3, "b", T0), (4, "c", T0)], "event_id long, flag string, at timestamp")
    changes = spark.createDataFrame([(1, "a", T0 + timedelta(1), True)], "id long, flag string, changed_at timestamp, new_value boolean")
    defaults = spark.createDataFrame([("a", False), ("b", True)], "name string, default_value boolean")
    ok, bad = privacy.flag_asof(reads, changes, defaults)
    assert {r["event_id"]: r["value"] for r in ok.collect()} == {1: False, 2: True, 3: True}
    assert [r["event_id"] for r in bad.collect()] == [4]


def test_quotas(spark):
    calls = spark.createDataFrame([(i, "k", "score", T0 + timedelta(milliseconds=900 * i)) for i in range(61)], "event_id long, key string, policy string, at timestamp")
    out = privacy.fixed_window_quota(calls)
    assert out.filter("admitted").count() == 60 and [r["event_id"] for r in out.filter("not admitted").collect()] == [60]
    rng = random.Random(1)
    ev = sorted((T0 + timedelta(seconds=rng.randint(0, 4000)), i) for i in range(300))
    df = spark.createDataFrame([(i, "k", at) for at, i in ev], "event_id long, key string, at timestamp")
    got = {r["event_id"]: r["n"] for r in privacy.anchored_window_quota(df, 5, 60).collect()}
    anchor, n, want = None, 0, {}
    for at, i in ev:
        if anchor is None or (at - anchor).total_seconds() >= 60:
            anchor, n = at, 0
        n += 1
        want[i] = n
    assert got == want


def test_charges_from_webhooks(spark):
    day = lambda n: T0 + timedelta(days=n)
    subs = spark.createDataFrame([("a", 1, "Starter", "p", day(0)), ("b", 2, "Starter", "p", day(10)), ("c", 3, "Starter", "q", day(5))],
                                 "id string, user_id long, plan string, payment_source_id string, at timestamp")
    subs = subscriptions.create_subscriptions(subs)[0]
    good = '{"event":"recurring_charge.successful","payment_source_id":"%s","charge_id":"%s"}'
    bad = '{"event":"recurring_charge.failed","payment_source_id":"%s","reason":"funds"}'
    sent = [(1, good % ("p", "c1"), day(9)), (2, good % ("p", "c2"), day(10)), (3, bad % "q", day(4)), (4, bad % "q", day(6)), (5, bad % " ", day(6)),
            (6, '{"event":"recurring_charge.failed"}', day(6)), (7, '{"event":"transaction.updated"}', day(6)), (8, good % ("none", "c9"), day(20))]
    again = [(90, good % ("p", "c1"), day(11)), (4, bad % "q", day(8)), (6, '{"event":"recurring_charge.failed"}', day(7))]
    want = {(1, "a", "success"), (2, "b", "success"), (4, "c", "failure")}
    lost = {(3, "SUBSCRIPTION/NOT_FOUND"), (5, "PAYMENT/INVALID_PAYLOAD"), (6, "PAYMENT/INVALID_PAYLOAD"), (8, "SUBSCRIPTION/NOT_FOUND")}
    for rows in (sent, sent + again, again + sent + sent):
        hooks = payments.parse_webhooks(spark.createDataFrame(rows, "event_id long, payload string, received_at timestamp"))
        charges, rejected = subscriptions.charges_from_webhooks(hooks, subs)
        got = charges.collect()
        assert len(got) == 3 and {(r["event_id"], r["subscription_id"], r["outcome"]) for r in got} == want
        assert sorted((r["event_id"], r["error_code"]) for r in rejected.collect()) == sorted(lost)
        granted = subscriptions.grants(subs, charges).collect()
        assert sorted(r["reference"] for r in granted) == ["subscription:a", "subscription:a:1", "subscription:b", "subscription:b:2", "subscription:c"]
    none = payments.parse_webhooks(spark.createDataFrame([], "event_id long, payload string, received_at timestamp"))
    assert [x.count() for x in subscriptions.charges_from_webhooks(none, subs)] == [0, 0]
