"""State tables with fixed schemas, appends, upserts and users by provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "users": "user_id string, provider string, provider_id string, email string, name string, created_at timestamp, last_login_at timestamp, credit_balance int",
    "consents": "id string, user_id string, policy_version int, consent_date timestamp, revoked_at timestamp, purpose string",
    "treatment_log": "id string, user_id string, data_type string, action string, ts timestamp, reason string",
    "ledger": "id string, user_id string, reason string, reference string, delta int, balance_after int, metadata string, created_at timestamp",
    "payments": "id string, user_id string, package_id string, credits int, amount_in_cents bigint, currency string, status string, provider_tx_id string, "
                "idempotency_key string, created_at timestamp, updated_at timestamp, paid_at timestamp",
    "subscriptions": "id string, user_id string, plan string, payment_source_id string, status string, period_start timestamp, period_end timestamp, "
                     "started_at timestamp, canceled_at timestamp, last_charge_at timestamp, next_charge_at timestamp, retry_count int",
    "invoices": "id string, user_id string, kind string, reference string, number string, amount_in_cents bigint, currency string, status string, created_at timestamp",
    "ranges": "prefix string, from_no int, to_no int, current int",
    "flags": "name string, current_value boolean, updated_at timestamp, updated_by string",
    "flag_audit": "id string, flag string, old_value boolean, new_value boolean, changed_by string, changed_at timestamp, reason string",
    "requests": "request_id string, user_id string, cv_text string, vacancy_text string, iteration_count int, threshold int, created_at timestamp, status string",
    "results": "request_id string, status string, best_step int, partial boolean, completed_at timestamp, expires_at timestamp",
    "refresh_tokens": "token string, user_id string, created_at timestamp, expires_at timestamp, revoked_at timestamp",
}


def load_table(spark: SparkSession, directory: str, name: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table with its fixed schema; nothing is inferred, unknown names need a schema."""
    return spark.read.schema(schema or SCHEMAS[name]).format(fmt).load(f"{directory}/{name}")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a table of audit rows."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Newest row per key; at equal order the source wins. Versions combine before the shuffle."""
    both = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct(*target.columns), F.struct(order_col, "_new"))
    return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(newest.alias("r")).select("r.*")


PROVIDERS = ["google", "linkedin"]
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LAST = r"[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]"
_EMAIL = r"^[^@\s]{1,64}@(?:" + _LABEL + r"\.)+" + _LAST + r"\z"


def login_errors(providers: list[str] | None = None):
    """Code of the first violated rule of a login, else null."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"(?U)\S")
    known = F.lower("provider").isin(providers or PROVIDERS)
    bad_email = blank("email") | ~F.length("email").between(3, 254) | ~F.col("email").rlike("(?U)" + _EMAIL)
    return (F.when(blank("provider") | ~known, "AUTH/UNKNOWN_PROVIDER").when(blank("provider_id"), "AUTH/MISSING_PROVIDER_ACCOUNT_ID")
            .when(bad_email, "AUTH/INVALID_EMAIL").when(blank("name"), "AUTH/MISSING_NAME"))


def upsert_users(users: DataFrame, logins: DataFrame, providers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(users, rejected logins)``; ``logins(provider, provider_id, email, name, at)``.

    The latest login refreshes e-mail, name and last login; a new account gets an id derived from its key.
    """
    coded = logins.withColumn("error_code", login_errors(providers))
    good = coded.filter("error_code is null").withColumn("provider", F.lower("provider"))
    last = good.groupBy("provider", "provider_id").agg(
        F.max(F.struct("at", "email", "name")).alias("l"), F.min("at").alias("_first"))
    joined = users.withColumn("_old", F.lit(True)).join(last, ["provider", "provider_id"], "full_outer")
    fresh = {
        "user_id": F.coalesce("user_id", F.sha2(F.concat_ws("\u0001", "provider", "provider_id"), 256)),
        "email": F.coalesce("l.email", "email"), "name": F.coalesce("l.name", "name"),
        "created_at": F.coalesce("created_at", "_first"), "last_login_at": F.coalesce("l.at", "last_login_at"),
        "credit_balance": F.coalesce("credit_balance", F.lit(0)),
    }
    out = joined.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in users.columns])
    return out, coded.filter("error_code is not null")
