"""Keyed state and event-time timers: ledger accounts (W6), subscriptions (W4) and stale payments.

State lives in the state store, so the work of a batch follows its own rows, not what came before. A key's rows of one
batch are ordered in memory; nothing else of a key is held by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ledger import ORDER, entry_code
from ..operators.subscriptions import CHARGE_DAYS, MAX_RETRIES, PERIOD_DAYS, RETRY_DELAY_DAYS

DAY_US = 86_400_000_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within it keep maps and timers in RocksDB, which they need; the session's setting returns."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _at(row: Row, *names: str) -> tuple:
    return tuple((row[n] is not None, row[n]) for n in names)


# --- W6 -------------------------------------------------------------------------------------------


#: Entries a part of a user's accepted ones holds, about; a user has as many parts as they fill.
_PART = 64


def _parts(n: int) -> int:
    """Parts of ``n`` accepted entries: a power of two, so that parts only ever split."""
    return 1 << (n // _PART).bit_length()


def _place(entry: tuple) -> int:
    return crc32(f"{entry[0]}\0{entry[1]}".encode())


class _Accounts(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.account = handle.getValueState("account", "balance long, n_held long")
        self.held = handle.getMapState("held", "part long", "reasons array<string>, references array<string>")

    def _part(self, part: int) -> set[tuple]:
        kept = self.held.getValue((part,))
        return set(zip(*kept, strict=True)) if kept else set()

    def _keep(self, part: int, entries: list[tuple]) -> None:
        self.held.updateValue((part,), ([e[0] for e in entries], [e[1] for e in entries]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        account, out = self.account.get(), Row(*self.columns, "balance_after", "error_code")
        balance, before = account or (0, 0)
        parts, n, read, grown = _parts(before), before, {}, set()
        for row in sorted(rows, key=lambda r: _at(r, *ORDER)):
            code, entry = row["_code"], (row["reason"], row["reference"])
            if code is None:
                part = _place(entry) % parts
                if part not in read:
                    read[part] = self._part(part) if before else set()
                if entry in read[part]:
                    code = "DUPLICATE"
                elif balance + row["delta"] < 0:
                    code = "NEGATIVE_BALANCE"
                else:
                    balance += row["delta"]
                    read[part].add(entry)
                    grown.add(part)
                    n += 1
            after = None if row["_code"] else balance
            yield out(*(row[c] for c in self.columns), after, code)
        if n == before:
            return
        self.account.update((balance, n))
        if (more := _parts(n)) == parts:
            for part in grown:
                self._keep(part, list(read[part]))
            return
        for part in range(parts):  # each splits by itself, so one part is held at a time beside those of this batch
            split = {}
            for entry in read.pop(part) if part in read else self._part(part) if before else ():
                split.setdefault(_place(entry) % more, []).append(entry)
            for new, entries in split.items():
                self._keep(new, entries)
            if before and part not in split:
                self.held.removeKey((part,))

    def close(self) -> None:
        pass


def ledger_accounts(entries: DataFrame) -> DataFrame:
    """A stream of ledger entries with ``balance_after`` and ``error_code`` (null: accepted).

    State per user is the balance and the (reason, reference) of accepted entries, in parts of about 64 by their hash: a
    batch reads and writes the parts its own entries fall into, none if the user is new, not one value per entry. Parts
    split in two as they fill, so an entry is moved a bounded number of times on average. Entries of one batch are applied in (created_at, id) order, batches in the order they come. Rejected entries come out with a
    code, as in G1, and change nothing; an entry that comes again is a ``DUPLICATE``. Through a checkpoint and a file
    sink each entry takes effect once.
    """
    out = T.StructType([*entries.schema.fields, T.StructField("balance_after", T.LongType()), T.StructField("error_code", T.StringType())])
    coded = entries.withColumn("_code", entry_code())
    return coded.groupBy("user_id").transformWithState(_Accounts(entries.columns), out, "Append", "None")


# --- W4 -------------------------------------------------------------------------------------------

_SUB_STATE = "status string, retry_count int, n_success int, charged_us long, next_us long, canceled_us long, due_us long"
_SUB_OUT = ("subscription_id string, event_id long, at_us long, status string, retry_count int, n_success int, charged_us long, "
            "next_us long, canceled_us long, error_code string, kind string")
_SUB_ROW = Row(*(field.split()[0] for field in _SUB_OUT.split(", ")))


class _Subscriptions(StatefulProcessor):
    def __init__(self, delays: list[int]):
        self.delays = delays

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _SUB_STATE)

    def _step(self, state: tuple, start_us: int, outcome: str, at: int) -> tuple[tuple, str | None]:
        status, retry, n, charged, next_us, ended, due = state
        if status == "Canceled":
            return state, None if outcome == "cancel" else "SUBSCRIPTION/INVALID_TRANSITION"
        if outcome == "success":
            next_us = start_us + ((n + 1) * PERIOD_DAYS + CHARGE_DAYS) * DAY_US
            return ("Active", 0, n + 1, at, next_us, ended, -1), None
        if outcome == "cancel" or retry + 1 >= MAX_RETRIES:
            return ("Canceled", retry, n, charged, -1, at, -1), None
        next_us = at + self.delays[min(retry, len(self.delays) - 1)] * DAY_US
        return ("PastDue", retry + 1, n, charged, next_us, ended, next_us), None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted(rows, key=lambda r: _at(r, "at_us", "event_id"))
        start = events[0]["start_us"]
        state = tuple(self.state.get()) if self.state.exists() else ("Active", 0, 0, -1, start + CHARGE_DAYS * DAY_US, -1, -1)
        before = state[-1]
        for e in events:
            if 0 <= state[-1] < e["at_us"]:  # the timer would have gone off before this event
                yield _SUB_ROW(key[0], None, state[-1], *state[:6], None, "retry_due")
                state = (*state[:6], -1)
            state, code = self._step(state, start, e["outcome"], e["at_us"])
            yield _SUB_ROW(key[0], e["event_id"], e["at_us"], *state[:6], code, "transition")
        self.state.update(state)
        if state[-1] != before:
            if before >= 0:
                self.handle.deleteTimer(_ms(before))
            if state[-1] >= 0:
                self.handle.registerTimer(_ms(state[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else None
        if state and 0 <= state[-1] and _ms(state[-1]) == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((*state[:6], -1))
            yield _SUB_ROW(key[0], None, state[-1], *state[:6], None, "retry_due")

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    return -(-us // 1000)


def subscription_states(stream: DataFrame, delays: list[int] | None = None, delay: str = "1 hour") -> DataFrame:
    """``stream(event_id, subscription_id, outcome, at, started_at)`` to one ``transition`` row per event and one
    ``retry_due`` row whenever a subscription that is past due reaches ``next_charge_at`` without another event.

    State is seven values and at most one event-time timer per subscription. The timer goes off once the watermark
    (``delay`` behind the latest event) passes it, or before a later event of the same subscription is applied, so
    the rows do not depend on how events fall into batches. Events of one batch are applied in (at, event_id) order;
    those behind the watermark are dropped.
    """
    rows = stream.withWatermark("at", delay).select(
        "event_id", "subscription_id", "outcome", "at", F.unix_micros("at").alias("at_us"), F.unix_micros("started_at").alias("start_us"))
    return rows.groupBy("subscription_id").transformWithState(_Subscriptions(delays or RETRY_DELAY_DAYS), _SUB_OUT, "Append", "EventTime")


# --- W5 -------------------------------------------------------------------------------------------


class _Payments(StatefulProcessor):
    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "ids array<long>, created array<long>, done array<long>, timer_ms long")

    def _open(self) -> tuple[dict, int | None]:
        """Times ``(created, done)`` of each open payment, -1 if not known, and the timer; None if there is no state."""
        kept = self.state.get()
        return (dict(zip(kept[0], zip(kept[1], kept[2], strict=True), strict=True)), kept[3]) if kept else ({}, None)

    def _due_ms(self, created: int) -> int:
        return _ms(created + self.wait_us)

    def _keep(self, payments: dict, known: bool, timer: int) -> None:
        """``timer`` is the registered one, -1 if none; from here on it is that of the payment that is due first."""
        due = min((created for created, _ in payments.values() if created >= 0), default=-1)
        due = self._due_ms(due) if due >= 0 else -1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        if payments:
            self.state.update((list(payments), [t[0] for t in payments.values()], [t[1] for t in payments.values()], due))
        elif known:
            self.state.clear()

    def _alerts(self, key, alerts: list[tuple]) -> pd.DataFrame:
        ids = pd.array([None if key[0] < 0 else a[0] for a in alerts], "Int64")
        return pd.DataFrame({"payment_id": ids, "due_us": pd.array([a[1] for a in alerts], "Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payments, timer = self._open()
        touched, alerts = set(), []
        for frame in rows:
            for payment, kind, at in zip(frame["id"].tolist(), frame["kind"].tolist(), frame["at_us"].tolist(), strict=True):
                created, done = payments.get(payment, (-1, -1))
                if kind == "created":
                    created = at if created < 0 else min(created, at)
                elif kind == "terminal":
                    done = at if done < 0 else min(done, at)
                else:
                    continue
                payments[payment] = created, done
                touched.add(payment)
        for payment in touched:
            created, done = payments[payment]
            if created >= 0 and done >= 0:
                del payments[payment]
                if done > created + self.wait_us:
                    alerts.append((payment, created + self.wait_us))
        if touched:
            self._keep(payments, timer is not None, -1 if timer is None else timer)
        if alerts:
            yield self._alerts(key, alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payments, timer = self._open()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        due = [p for p, (created, _) in payments.items() if created >= 0 and self._due_ms(created) < mark]
        alerts = [(p, payments.pop(p)[0] + self.wait_us) for p in due]
        self._keep(payments, True, -1)  # the timer that went off is deleted by Spark
        if alerts:
            yield self._alerts(key, alerts)

    def close(self) -> None:
        pass


def stale_alerts(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """``stream(payment_id, kind, at)`` with kind created or terminal; ``(payment_id, due_us)`` of every payment
    without terminal event within ``minutes`` of its creation, raised by an event-time timer. State is two times per
    open payment. Payments are dealt by their hash into ``buckets``, whose open ones are read and written together and
    share a timer, that of the first one due: a batch asks the state store once per bucket, not several times per
    payment. A task holds one bucket; payments without id are one payment, in a bucket of its own, and rows without
    time are passed over."""
    bucket = F.when(F.col("payment_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("payment_id"), F.lit(buckets)))
    rows = stream.withWatermark("at", delay).select(
        bucket.alias("bucket"), F.coalesce("payment_id", F.lit(0)).cast("long").alias("id"),
        F.when(F.col("at").isNotNull(), F.col("kind")).alias("kind"), "at", F.coalesce(F.unix_micros("at"), F.lit(0)).alias("at_us"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Payments(minutes * 60_000_000), "payment_id long, due_us long", "Append", "EventTime")
