"""Keyed state over many batches: ledger accounts, subscriptions and stale payments against plain versions."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from test_money import ENTRY, T0, brute

from matchloom.operators.subscriptions import RETRY_DELAY_DAYS
from matchloom.plans import streams as plans
from matchloom.streaming import state


def test_processors_travel_without_their_modules(spark):
    """Functions go by value: a module reached by name would go along with all it holds, sessions and locks too."""
    from pyspark import cloudpickle

    from matchloom.operators import ledger

    ledger._held_by_a_driver = threading.RLock()
    try:
        for processor in (state._Accounts(["id"]), state._Subscriptions([1]), state._Payments(1)):
            assert cloudpickle.dumps(processor)
    finally:
        del ledger._held_by_a_driver


class Replay:
    """Batches of rows, one file a batch, through a streaming operator with a checkpoint and a file sink."""

    def __init__(self, spark, folder, schema, operator):
        self.spark, self.folder, self.schema, self.operator, self.n = spark, folder, schema, operator, 0

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n:03}")
            self.n += 1

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{self.folder}/in/*")
        out = self.operator(stream)
        with state.state_store(self.spark):
            query = out.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/mark").trigger(availableNow=True).start(f"{self.folder}/out")
        query.awaitTermination()
        self.progress = query.recentProgress
        return self.spark.read.schema(out.schema).parquet(f"{self.folder}/out").collect()


def cut(rows, n):
    return [rows[i * len(rows) // n:(i + 1) * len(rows) // n] for i in range(n)]


def test_ledger_over_ten_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 5), "R", rng.choice(["", f"k{rng.randint(0, 40)}"]) if i % 9 == 0 else f"k{rng.randint(0, 40)}", rng.choice([3, -1, -2, 0]), T0 + timedelta(minutes=i)) for i in range(250)]
    replay = Replay(spark, tmp_path, ENTRY, state.ledger_accounts)
    replay.add(*cut(rows, 10))
    got = replay.run()
    assert {r["id"]: r["error_code"] or r["balance_after"] for r in got} == brute(rows) and len(got) == len(rows)
    assert {r["error_code"] for r in got} == {None, "DUPLICATE", "NEGATIVE_BALANCE", "ZERO_DELTA", "BLANK_REFERENCE"}
    done = [p for p in replay.progress if p["numInputRows"]]
    # a batch reads its own rows and writes the state of those alone, however many came before
    assert [p["numInputRows"] for p in done] == [25] * 10
    assert all(sum(op["numRowsUpdated"] for op in p["stateOperators"]) <= 2 * 25 for p in done)
    # nothing new, then all of it again as new files: no entry takes effect twice
    assert len(replay.run()) == len(rows)
    accepted = [r for r in rows if not isinstance(brute(rows)[r[0]], str)]
    replay.add(*cut(accepted, 2))
    again = replay.run()[0:]
    assert len(again) == len(rows) + len(accepted)
    assert sum(1 for r in again if r["error_code"] == "DUPLICATE") == sum(1 for r in got if r["error_code"] == "DUPLICATE") + len(accepted)


def test_ledger_of_odd_entries(spark, tmp_path):
    replay = Replay(spark, tmp_path, ENTRY, state.ledger_accounts)
    replay.add([(1, None, "R", "a", 2, T0), (2, 7, None, "a", None, T0), (3, 7, "R", None, 1, None), (4, 7, "R", "b", 2**40, None)], [(5, None, "R", "b", -2, T0), (6, 7, "R", "c", -1, None)])
    got = {r["id"]: r["error_code"] or r["balance_after"] for r in replay.run()}
    assert got == {1: 2, 2: "ZERO_DELTA", 3: "BLANK_REFERENCE", 4: 2**40, 5: 0, 6: 2**40 - 1}


def test_ledger_keeps_entries_in_parts_that_split(spark, tmp_path):
    """State is written by parts of a user's entries, not entry by entry, and every part is found again after it split."""
    rng = random.Random(5)
    rows = [(i, 1 if i % 10 else 2, rng.choice(["R", "S"]), f"k{rng.randrange(600)}", 1, T0 + timedelta(minutes=i)) for i in range(1200)]
    replay = Replay(spark, tmp_path, ENTRY, state.ledger_accounts)
    replay.add(rows[:700], rows[700:720], rows[720:])
    got = replay.run()
    assert {r["id"]: r["error_code"] or r["balance_after"] for r in got} == brute(rows) and len(got) == len(rows)
    updated = [sum(op["numRowsUpdated"] for op in p["stateOperators"]) for p in replay.progress if p["numInputRows"]]
    assert updated[0] < 60 and updated[1] <= 2 * 20 and updated[2] < 100


def subscription(events, start, end):
    """Transitions and due retries of one subscription up to a watermark, in order."""
    day, out = timedelta(days=1), []
    status, retry, n, due = "Active", 0, 0, None
    for event, outcome, at in sorted(events, key=lambda e: (e[2], e[0])):
        if due is not None and due < at:
            out.append((None, due, "PastDue", retry, "retry_due"))
            due = None
        if status == "Canceled":
            pass
        elif outcome == "success":
            status, retry, n, due = "Active", 0, n + 1, None
        elif outcome == "cancel" or retry == 2:
            status, due = "Canceled", None
        else:
            status, due = "PastDue", at + RETRY_DELAY_DAYS[retry] * day
            retry += 1
        out.append((event, at, status, retry, "transition"))
    if due is not None and due <= end:
        out.append((None, due, status, retry, "retry_due"))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_subscription_timers_do_not_depend_on_batches(spark, tmp_path, batches):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    events = [(i, f"s{rng.randrange(12)}", rng.choice(["success", "failure", "failure", "failure", "cancel" if i % 11 == 0 else "failure"]), start + timedelta(hours=5 * i + rng.randrange(3)), start) for i in range(140)]
    replay = Replay(spark, tmp_path, "event_id long, subscription_id string, outcome string, at timestamp, started_at timestamp", lambda s: state.subscription_states(s, delay="3 hours"))
    replay.add(*cut(events, batches))
    got = {}
    for r in replay.run():
        got.setdefault(r["subscription_id"], []).append((r["event_id"], r["at_us"], r["status"], r["retry_count"], r["kind"]))
    micros = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    end = max(e[3] for e in events) - timedelta(hours=3)
    for key in {e[1] for e in events}:
        wanted = subscription([(e[0], e[2], e[3]) for e in events if e[1] == key], start, end)
        assert sorted(got[key], key=lambda r: (r[1], r[0] is not None, r[0])) == sorted(((a, micros(b), *c) for a, b, *c in wanted), key=lambda r: (r[1], r[0] is not None, r[0]))
    assert sum(r[-1] == "retry_due" for rows in got.values() for r in rows) > 10


def test_stale_payments_over_batches(spark, tmp_path):
    minute = timedelta(minutes=1)
    batches = [[(1, "created", T0), (2, "created", T0), (3, "terminal", T0 + 2 * minute), (5, "created", T0)], [(2, "terminal", T0 + 4 * minute), (3, "created", T0 + minute), (5, "terminal", T0 + 9 * minute)],
               [(4, "created", T0 + 40 * minute), (6, "noise", T0 + 40 * minute)], [(9, "created", T0 + 60 * minute)]]
    replay = Replay(spark, tmp_path, "payment_id long, kind string, at timestamp", state.stale_alerts)
    replay.add(*batches)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) + 300
    assert sorted((r["payment_id"], r["due_us"] // 1_000_000 - base) for r in replay.run()) == [(1, 0), (4, 2400), (5, 0)]


def test_stale_payments_share_state_and_timers(spark, tmp_path):
    """The store is asked per bucket; payments of a bucket fall due one after the other, strictly before the watermark."""
    minute, n = timedelta(minutes=1), 300
    made = [(i, "created", T0 + (i % 60) * minute) for i in range(n)] + [(None, "created", T0 + 7 * minute), (2**60 + 1, "created", T0), (2**60 + 1, "terminal", None)]
    ended = [(i, "terminal", T0 + (i % 60 + (2 if i % 4 else 9)) * minute) for i in range(0, n, 2)]
    replay = Replay(spark, tmp_path, "payment_id long, kind string, at timestamp", lambda s: state.stale_alerts(s, delay="90 minutes", buckets=4))
    replay.add(made, ended, [(None, "noise", T0 + 125 * minute)])
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    due = lambda i: base + (i % 60 + 5) * 60_000_000
    late = {(i, due(i)) for i in range(0, n, 4)}
    quiet = {(i, due(i)) for i in range(1, n, 2) if i % 60 + 5 < 35}  # the watermark ends at minute 35
    rows = replay.run()
    assert {tuple(r) for r in rows} == late | quiet | {(None, base + 12 * 60_000_000), (2**60 + 1, base + 5 * 60_000_000)}
    assert len(rows) == len(late | quiet) + 2
    assert all(op["numRowsUpdated"] <= 6 * 5 for p in replay.progress for op in p["stateOperators"])


@pytest.mark.parametrize("folder", [False, True])
def test_replayed_table_is_a_file_or_a_folder(spark, tmp_path, folder):
    """A table of many files has none of its own name; a stream that looks for that name finds nothing."""
    rows, folders = spark.range(40).withColumnRenamed("id", "event_id"), tmp_path / "folders"
    rows.repartition(3).write.parquet(f"{folders}/events.parquet")
    if not folder:
        rows.toPandas().to_parquet(tmp_path / "events.parquet")
    sf = str(folders if folder else tmp_path)
    got = plans.drain(spark, plans.replay(spark, sf, "events"), "replayed")
    assert sorted(r[0] for r in got.collect()) == list(range(40))
