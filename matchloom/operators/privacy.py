"""Consent, access and erasure (N1-N5), flags (F1, F2), retention (D1) and quotas (Q1, Q2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.anchored import openers
from ..functions.segmented import Running, running, time_bucket

# --- N1-N3: consent records (id, user_id, policy_version, consent_date, revoked_at, purpose) --------

_CONSENT_KEY = ["user_id", "purpose"]


def latest_consent(records: DataFrame) -> DataFrame:
    """Newest record per (user, purpose), valid or not."""
    newest = F.max_by(F.struct(*records.columns), F.struct("consent_date", "id"))
    return records.groupBy(*_CONSENT_KEY).agg(newest.alias("r")).select("r.*")


def active_consent(records: DataFrame) -> DataFrame:
    """Newest record per (user, purpose) among those not revoked."""
    return latest_consent(records.filter("revoked_at is null"))


def grant(records: DataFrame, requests: DataFrame, revocations: DataFrame | None = None,
          bucket_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """``(granted, rejected)`` of ``requests(request_id, user_id, purpose, policy_version, at)``.

    A request is rejected while the latest consent is valid and of the same or a newer policy. Between two
    revocations accepted policies only rise, so a request is accepted exactly when it exceeds every earlier
    one of its stretch; ``revocations(user_id, purpose, at)`` start a new stretch.
    """
    latest = latest_consent(records).filter("revoked_at is null").select(*_CONSENT_KEY, F.col("policy_version").alias("_held"))
    rows = requests.select(*_CONSENT_KEY, "at", F.lit(1).alias("_o"), F.col("request_id").cast("string").alias("_id"), F.lit(0).alias("_cut"),
                           "policy_version", "request_id")
    if revocations is not None:
        cuts = revocations.select(*_CONSENT_KEY, "at", F.lit(0).alias("_o"), F.lit("").alias("_id"), F.lit(1).alias("_cut"))
        rows = rows.unionByName(cuts, allowMissingColumns=True)
    order, bucket = ["at", "_o", "_id"], time_bucket("at", bucket_seconds)
    cut = running(rows, _CONSENT_KEY, order, bucket, [Running("_stretch", "sum", F.col("_cut"))])
    asked = cut.filter("_cut = 0")
    seen = running(asked, [*_CONSENT_KEY, "_stretch"], order, bucket, [Running("_before", "max", F.col("policy_version"), inclusive=False)])
    seen = seen.join(latest, _CONSENT_KEY, "left")
    held = F.greatest("_before", F.when(F.col("_stretch") == 0, F.col("_held")))
    ok = held.isNull() | (F.col("policy_version") > held)
    out = seen.withColumn("_ok", ok)
    cols = requests.columns
    return (out.filter("_ok").select(*cols),
            out.filter("not _ok").select(*cols, F.lit("CONSENT/ALREADY_GRANTED").alias("error_code")))


def consent_history(records: DataFrame, bucket_seconds: int = 86_400 * 30) -> DataFrame:
    """Rank of each record in its user's history, newest first: all records less those before it, which are
    counted bucket by bucket, so that a user with very many records is not one task."""
    place = running(records, ["user_id"], ["consent_date", "id"], time_bucket("consent_date", bucket_seconds), [Running("_n", "count")])
    total = records.groupBy(F.col("user_id").alias("_user")).agg(F.count(F.lit(1)).alias("_all"))
    joined = place.join(total, F.col("user_id").eqNullSafe(F.col("_user")))
    return joined.select(*records.columns, (F.col("_all") - F.col("_n") + 1).cast("int").alias("rank"))


def revoke(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejected)``; each ``(user_id, purpose, at)`` revokes the newest active record by its id."""
    first = requests.groupBy(*_CONSENT_KEY).agg(F.min("at").alias("_at"))
    target = active_consent(records).select(F.col("id").alias("_hit"), *_CONSENT_KEY).join(first, _CONSENT_KEY)
    joined = records.join(target.select("_hit", "_at"), F.col("id") == F.col("_hit"), "left")
    out = joined.withColumn("revoked_at", F.coalesce("revoked_at", "_at")).select(*records.columns)
    lost = first.join(active_consent(records), _CONSENT_KEY, "left_anti")
    return out, lost.select(*_CONSENT_KEY, F.lit("CONSENT/REQUIRED").alias("error_code"))


def revoke_all(records: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(user_id, at)`` revoke every active record of the user."""
    first = requests.groupBy("user_id").agg(F.min("at").alias("_at"))
    return records.join(first, "user_id", "left").withColumn("revoked_at", F.coalesce("revoked_at", "_at")).select(*records.columns)


# --- N4, N5 ---------------------------------------------------------------------------------------

PURPOSES = {"access": "data-access", "rectify": "rectification"}


def _log(rows: DataFrame, action: Column) -> DataFrame:
    return rows.select("user_id", F.lit("profile").alias("data_type"), action.alias("action"), F.col("at").alias("ts"))


def gated_requests(requests: DataFrame, consents: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(users after rectification, rejected requests, treatment log)``.

    ``requests(request_id, user_id, kind, email, name, at)``; the last given value of a field wins, missing
    fields keep the stored value.
    """
    purpose = F.when(F.col("kind") == "access", PURPOSES["access"]).otherwise(PURPOSES["rectify"])
    asked = requests.withColumn("purpose", purpose)
    active = active_consent(consents).select(*_CONSENT_KEY)
    allowed = asked.join(active, _CONSENT_KEY, "left_semi")
    denied = asked.join(active, _CONSENT_KEY, "left_anti").withColumn("error_code", F.lit("CONSENT/REQUIRED"))
    known = allowed.join(users.select("user_id"), "user_id", "left_semi")
    missing = allowed.join(users.select("user_id"), "user_id", "left_anti").withColumn("error_code", F.lit("ARCO/DATA_NOT_FOUND"))
    at = F.struct("at", "request_id")
    patch = known.filter("kind = 'rectify'").groupBy("user_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in ("email", "name")])
    patched = users.join(patch, "user_id", "left").withColumns({
        "email": F.coalesce("_email", "email"), "name": F.coalesce("_name", "name")}).select(*users.columns)
    return patched, denied.unionByName(missing).select(*requests.columns, "error_code"), _log(known, F.col("kind"))


ANONYMIZED_EMAIL = "[deleted]@anonymized"
ANONYMIZED_NAME = "[Deleted User]"


def erase(users: DataFrame, payments: DataFrame, consents: DataFrame, children: dict[str, DataFrame],
          requests: DataFrame) -> dict[str, DataFrame]:
    """Erasure of ``requests(user_id, at)`` with an active ``data-access`` consent.

    Users with payments are anonymised, others deleted with their rows in every child table (ledger,
    consents, subscriptions); payments stay. Returns users, consents, the children, log and rejected.
    """
    active = active_consent(consents).filter(F.col("purpose") == PURPOSES["access"]).select("user_id")
    once = requests.groupBy("user_id").agg(F.min("at").alias("at"))
    allowed = once.join(active, "user_id", "left_semi").join(users.select("user_id"), "user_id", "left_semi")
    rejected = once.join(active, "user_id", "left_anti").select("user_id", F.lit("CONSENT/REQUIRED").alias("error_code"))
    payers = payments.select("user_id").distinct()
    keep = allowed.join(payers, "user_id", "left_semi")
    drop = allowed.join(payers, "user_id", "left_anti")
    marked = users.join(keep.select("user_id", F.lit(True).alias("_anon")), "user_id", "left").join(drop, "user_id", "left_anti")
    anon = F.coalesce("_anon", F.lit(False))
    masks = {"provider": "redacted", "provider_id": "redacted", "email": ANONYMIZED_EMAIL, "name": ANONYMIZED_NAME}
    out = marked.select(*[F.when(anon, F.lit(masks[c])).otherwise(F.col(c)).alias(c) if c in masks else F.col(c) for c in users.columns])
    result = {name: df.join(drop.select("user_id"), "user_id", "left_anti") for name, df in children.items()}
    result["users"] = out
    result["consents"] = revoke_all(consents, keep).join(drop.select("user_id"), "user_id", "left_anti")
    result["log"] = _log(keep, F.lit("anonymize")).unionByName(_log(drop, F.lit("delete")))
    result["rejected"] = rejected
    return result


# --- F1, F2 ---------------------------------------------------------------------------------------


def flag_asof(events: DataFrame, changes: DataFrame, defaults: DataFrame, bucket_seconds: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """``(resolved, rejected)``: value of ``events(event_id, flag, at)`` from the last of
    ``changes(id, flag, changed_at, new_value)`` at or before it, else the default, else an error.

    Events and changes are merged in time and the last value is carried along, bucket by bucket, so neither a
    long change log nor a flag read by most events becomes one task.
    """
    rows = events.select("flag", F.col("at").alias("_at"), F.lit(1).alias("_o"), F.lit("").alias("_id"), F.lit(None).cast("boolean").alias("_v"), *[
        c for c in events.columns if c != "flag"]).unionByName(
        changes.select("flag", F.col("changed_at").alias("_at"), F.lit(0).alias("_o"), F.format_string("%020d", F.col("id").cast("long")).alias("_id"), F.col("new_value").alias("_v")),
        allowMissingColumns=True)
    carried = running(rows, ["flag"], ["_at", "_o", "_id"], time_bucket("_at", bucket_seconds), [Running("value", "last", F.col("_v"))])
    dim = defaults.select(F.col("name").alias("flag"), "default_value")
    out = carried.filter("_o = 1").join(dim, "flag", "left").withColumn("value", F.coalesce("value", "default_value"))
    cols = events.columns
    return (out.filter("value is not null").select(*cols, "value"),
            out.filter("value is null").select(*cols, F.lit("FLAG_NOT_FOUND").alias("error_code")))


def flag_audit(changes: DataFrame, defaults: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """change log with ``old_value``; the default precedes the first change, no-op changes are kept."""
    log = running(changes, ["flag"], ["changed_at", "id"], time_bucket("changed_at", bucket_seconds),
                  [Running("old_value", "last", F.col("new_value"), inclusive=False)])
    dim = defaults.select(F.col("name").alias("flag"), "default_value")
    return log.join(dim, "flag", "left").withColumn("old_value", F.coalesce("old_value", "default_value")).drop("default_value")


# --- D1 -------------------------------------------------------------------------------------------

RESULT_TTL = "24 hours"
TOKEN_TTL = "7 days"


def save_results(results: DataFrame) -> DataFrame:
    """The last result saved per request, ``results(request_id, saved_at, save_id, expires_at, ...)``; one saved
    without an expiry expires ``RESULT_TTL`` later. Saves are reduced before the shuffle, so a request saved very often
    costs one row per task."""
    last = F.max_by(F.struct(*results.columns), F.struct("saved_at", "save_id")).alias("r")
    kept = results.groupBy("request_id").agg(last).select("r.*")
    return kept.withColumn("expires_at", F.coalesce("expires_at", F.col("saved_at") + F.expr(f"interval {RESULT_TTL}")))


def with_expiry(df: DataFrame, created: str, ttl: str) -> DataFrame:
    return df.withColumn("expires_at", F.col(created) + F.expr(f"interval {ttl}"))


def expire(df: DataFrame, as_of: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """``(kept, deleted count)``; a row expires strictly before ``as_of``."""
    gone = F.coalesce(F.col(expires) < as_of, F.lit(False))
    return df.filter(~gone), df.agg(F.count_if(gone).alias("n_deleted"))


# --- Q1, Q2 ---------------------------------------------------------------------------------------

# Policy, permits, window seconds.
POLICIES = [
    ("score", 60, 60), ("ai", 5, 3600), ("export", 20, 3600), ("import", 30, 3600), ("auth", 30, 60), ("consent", 10, 60),
    ("admin", 30, 60), ("subscription", 10, 60), ("subscription-cancel", 5, 3600), ("subscription-webhook", 60, 60), ("iterate", 10, 3600),
]


def fixed_window_quota(events: DataFrame, policies: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Q1: ``events(event_id, key, policy, at)`` with ``window_start`` and ``admitted``.

    Only the first permits of a window are ranked (limited before the shuffle); the last admitted event gives a
    threshold that all events of the window are compared with. Events of a policy that is not listed are not limited:
    they are admitted and have no window.
    """
    policies = policies or POLICIES
    dim = events.sparkSession.createDataFrame(policies, "policy string, permit int, seconds int")
    rows = events.join(dim, "policy")
    free = events.join(dim.select("policy"), "policy", "left_anti").select(
        *events.columns, F.lit(None).cast("timestamp").alias("window_start"), F.lit(True).alias("admitted"))
    width = F.col("seconds").cast("long") * 1_000_000
    start = F.floor(F.unix_micros("at") / width) * width
    rows = rows.withColumn("window_start", F.timestamp_micros(start))
    group = ["key", "policy", "window_start"]
    first = Window.partitionBy(*group).orderBy("at", "event_id")
    top = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= max(p[1] for p in policies))
    last = top.filter(F.col("_rn") <= F.col("permit")).groupBy(*group).agg(F.max(F.struct("at", "event_id")).alias("_last"))
    return rows.join(last, group).withColumn("admitted", F.struct("at", "event_id") <= F.col("_last")).select(
        *events.columns, "window_start", "admitted").unionByName(free)


def anchored_window_quota(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Q2: windows opened by a key's first event and again by the first event at least ``seconds`` later:
    ``(event_id, key, n, admitted, retry_after)``.

    Events of one instant count in the order of their ids. Events without a time are admitted and count for nothing.
    Openers are found by doubling jumps and counts are bucketed by time, so a hot key is spread over its buckets.
    """
    limit, seconds = max(limit, 1), max(seconds, 1)
    width = seconds * 1_000_000
    rows = events.select("event_id", "key", F.unix_micros("at").alias("_us"))
    timed = rows.filter("_us is not null")
    opened = openers(timed, ["key"], "_us", width).select(F.col("key").alias("_ok"), F.col("_us").alias("_open"))
    marked = timed.join(opened, timed["key"].eqNullSafe(opened["_ok"]) & (timed["_us"] == opened["_open"]), "left").drop("_ok")
    order = ["_us", "event_id"]
    anchored = running(marked, ["key"], order, F.floor(F.col("_us") / width), [Running("_anchor", "last", F.col("_open"))])
    counted = running(anchored, ["key", "_anchor"], order, F.floor(F.col("_us") / max(1, width // 16)), [Running("_n", "count")])
    left = F.ceil((F.col("_anchor") + width - F.col("_us")) / 1_000_000)
    n = F.col("_n").cast("int")
    out = counted.select("event_id", "key", n.alias("n"), F.when(n > limit, F.greatest(F.lit(1), left)).otherwise(0).cast("int").alias("retry_after"))
    free = rows.filter("_us is null").select("event_id", "key", F.lit(0).alias("n"), F.lit(0).alias("retry_after"))
    return out.unionByName(free).withColumn("admitted", F.col("n") <= limit)
