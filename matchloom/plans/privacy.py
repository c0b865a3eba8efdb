"""Consent, erasure, flag, retention, quota and state-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy as pv
from ..sources import tables
from . import common as c
from .money import ts, us

AS_OF = "2024-01-10 00:00:00"
_PURPOSE = "CASE WHEN event_id % 2 = 0 THEN 'data-access' ELSE 'rectification' END"


def _events(spark, sf, kind=None):
    e = c.table(spark, sf, "events").withColumn("purpose", F.expr(_PURPOSE))
    return e.filter(F.col("event_type") == kind) if kind else e


def consents(spark, sf):
    return _events(spark, sf, "signup").select(
        F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 4).cast("int").alias("policy_version"), F.col("ts").alias("consent_date"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 1 day")).alias("revoked_at"), "purpose")


def users(spark, sf):
    cu = c.table(spark, sf, "customer")
    return cu.select(F.col("c_custkey").alias("user_id"), F.lit("google").alias("provider"), F.col("c_custkey").cast("string").alias("provider_id"),
                     F.concat("c_custkey", F.lit("@mail.org")).alias("email"), F.col("c_name").alias("name"), ts("2023-01-01").alias("created_at"),
                     ts("2023-06-01").alias("last_login_at"), F.lit(5).alias("credit_balance"))


def s1(spark, sf):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return tables.load_table(spark, sf, "orders.parquet", schema).withColumn("o_orderdate", F.unix_micros("o_orderdate"))


def s5(spark, sf):
    e = c.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    old, new = e.filter("event_type <> 'click'"), e.filter("event_type = 'click'")
    return tables.upsert(old, new, ["user_id"], "ts").select("user_id", "event_id", "event_type")


def s7(spark, sf):
    e = c.table(spark, sf, "events")
    logins = e.select(
        F.element_at(F.array(F.lit("LinkedIn"), F.lit("google"), F.lit("myspace")), (F.col("event_id") % 3 + 1).cast("int")).alias("provider"),
        F.when(F.col("event_id") % 50 == 0, " ").otherwise((F.col("user_id") * 11).cast("string")).alias("provider_id"),
        F.when(F.col("event_id") % 20 == 7, F.lit("a@b@c.org")).otherwise(F.concat("event_id", F.lit("@site-x.org"))).alias("email"),
        F.concat(F.lit("n"), "event_id").alias("name"), F.col("ts").alias("at"))
    out, bad = tables.upsert_users(users(spark, sf).withColumn("user_id", F.col("user_id").cast("string")), logins)
    return out.select("user_id", "provider", "provider_id", "email", "name", us("created_at"), us("last_login_at"), F.lit("").alias("error_code")).unionByName(
        bad.select(F.lit("").alias("user_id"), "provider", "provider_id", "email", "name", us("at").alias("created_at"), us("at").alias("last_login_at"), "error_code"))


def n1(spark, sf):
    rows = consents(spark, sf)
    return pv.active_consent(rows).select("user_id", "purpose", "id", F.lit("active").alias("mode")).unionByName(
        pv.latest_consent(rows).select("user_id", "purpose", "id", F.lit("latest").alias("mode")))


def n2(spark, sf):
    asked = _events(spark, sf, "purchase").filter(F.col("ts") >= ts(AS_OF)).select(
        F.col("event_id").alias("request_id"), "user_id", "purpose", (F.col("event_id") % 7).cast("int").alias("policy_version"), F.col("ts").alias("at"))
    cuts = _events(spark, sf, "error").filter(F.col("ts") >= ts(AS_OF)).select("user_id", "purpose", F.col("ts").alias("at"))
    ok, bad = pv.grant(consents(spark, sf).filter(F.col("consent_date") < ts(AS_OF)), asked, cuts)
    return ok.select("request_id", F.lit("GRANTED").alias("verdict")).unionByName(bad.select("request_id", F.col("error_code").alias("verdict")))


def n3(spark, sf):
    return pv.consent_history(consents(spark, sf)).select("user_id", "id", "rank")


def _revocations(spark, sf):
    return _events(spark, sf, "error").select("user_id", "purpose", F.col("ts").alias("at"))


def n3_revoke(spark, sf):
    out, lost = pv.revoke(consents(spark, sf), _revocations(spark, sf))
    return out.select("id", "user_id", "purpose", us("revoked_at"), F.lit("").alias("error_code")).unionByName(
        lost.select(F.lit(-1).cast("long").alias("id"), "user_id", "purpose", F.lit(-1).cast("long").alias("revoked_at"), "error_code"))


def n3_revoke_all(spark, sf):
    return pv.revoke_all(consents(spark, sf), _revocations(spark, sf).select("user_id", "at")).select("id", us("revoked_at"))


def _gated(spark, sf):
    asked = _events(spark, sf, "click").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 3 % 200).alias("user_id"), F.when(F.col("event_id") % 3 == 0, "access").otherwise("rectify").alias("kind"),
        F.when(F.col("event_id") % 5 < 3, F.concat("event_id", F.lit("@new.org"))).alias("email"), F.when(F.col("event_id") % 7 < 3, F.concat(F.lit("N"), "event_id")).alias("name"),
        F.col("ts").alias("at"))
    return pv.gated_requests(asked, consents(spark, sf), users(spark, sf))


def n4(spark, sf):
    return _gated(spark, sf)[0].select("user_id", "email", "name")


def n4_log(spark, sf):
    _, bad, log = _gated(spark, sf)
    return log.select("user_id", "action", us("ts")).unionByName(bad.select("user_id", F.col("error_code").alias("action"), us("at").alias("ts")))


def _erased(spark, sf):
    asked = _events(spark, sf, "error").select("user_id", F.col("ts").alias("at"))
    payments = c.table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("user_id"))
    ledger = c.table(spark, sf, "events").select("event_id", "user_id")
    return pv.erase(users(spark, sf), payments, consents(spark, sf), {"ledger": ledger}, asked)


def n5(spark, sf):
    return _erased(spark, sf)["users"].select("user_id", "provider", "email", "name")


def n5_children(spark, sf):
    e = _erased(spark, sf)
    return e["ledger"].select(F.lit("ledger").alias("target"), "user_id", F.col("event_id").alias("id"), F.lit(-1).cast("long").alias("at")).unionByName(
        e["consents"].select(F.lit("consents").alias("target"), "user_id", "id", us("revoked_at").alias("at"))).unionByName(
        e["log"].select(F.concat(F.lit("log "), "action").alias("target"), "user_id", F.lit(-1).cast("long").alias("id"), us("ts").alias("at"))).unionByName(
        e["rejected"].select(F.col("error_code").alias("target"), "user_id", F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("at")))


def _changes(spark, sf):
    return _events(spark, sf, "error").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id") % 5).alias("flag"),
                                              F.col("ts").alias("changed_at"), (F.col("event_id") % 2 == 0).alias("new_value"))


def _defaults(spark):
    return spark.createDataFrame([("f0", True), ("f5", True)], "name string, default_value boolean")


def f1(spark, sf):
    reads = _events(spark, sf, "purchase").select("event_id", F.concat(F.lit("f"), F.col("user_id") % 7).alias("flag"), F.col("ts").alias("at"))
    ok, bad = pv.flag_asof(reads, _changes(spark, sf), _defaults(spark))
    return ok.select("event_id", "flag", F.col("value").cast("string").alias("value")).unionByName(bad.select("event_id", "flag", F.col("error_code").alias("value")))


def f2(spark, sf):
    out = pv.flag_audit(_changes(spark, sf), _defaults(spark))
    return out.select("id", "flag", F.coalesce(F.col("old_value").cast("string"), F.lit("none")).alias("old_value"), "new_value")


def d1(spark, sf):
    rows = pv.with_expiry(c.table(spark, sf, "events"), "ts", pv.TOKEN_TTL)
    kept, gone = pv.expire(rows, ts("2024-01-20"))
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(
        gone.select(F.lit("deleted").alias("what"), F.col("n_deleted").alias("n")))


def d1_results(spark, sf):
    e = c.table(spark, sf, "events")
    given = F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("interval 90 minutes"))
    results = e.select((F.col("event_id") % 997).alias("request_id"), F.col("ts").alias("saved_at"), F.col("event_id").alias("save_id"), given.alias("expires_at"))
    saved = pv.save_results(results)
    return saved.select("request_id", "save_id", F.unix_micros("expires_at").alias("expires_at"), (F.col("expires_at") < ts("2024-01-30 12:00:00")).alias("expired"))


def quota_events(spark, sf):
    return c.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("policy"), F.col("ts").alias("at"))


QUOTA = [("view", 1, 86_400), ("click", 2, 86_400 * 7), ("purchase", 3, 86_400 * 7), ("error", 1, 3_600)]


def q1(spark, sf):
    return pv.fixed_window_quota(quota_events(spark, sf), QUOTA).select("event_id", us("window_start"), "admitted")


def q2(spark, sf):
    out = pv.anchored_window_quota(quota_events(spark, sf).select("event_id", "key", "at"), 2, 2 * 86_400)
    return out.select("event_id", "key", "n", "admitted", "retry_after")


QUERIES = {
    "s1_load_table": s1, "s5_upsert": s5, "s7_upsert_users": s7,
    "n1_active_consent": n1, "n2_grant": n2, "n3_consent_history": n3, "n3_revoke": n3_revoke, "n3_revoke_all": n3_revoke_all,
    "n4_gated_requests": n4, "n4_treatment_log": n4_log, "n5_erase": n5, "n5_erase_children": n5_children,
    "f1_flag_asof": f1, "f2_flag_audit": f2, "d1_expire": d1, "d1_save_results": d1_results, "q1_fixed_window_quota": q1, "q2_anchored_window_quota": q2,
}

_CONS = f"""cons AS (SELECT event_id AS id, user_id, CAST(event_id % 4 AS INTEGER) AS policy_version, ts AS consent_date,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS revoked_at, {_PURPOSE} AS purpose FROM events WHERE event_type = 'signup'),
  act AS (SELECT * FROM cons WHERE revoked_at IS NULL QUALIFY row_number() OVER (PARTITION BY user_id, purpose ORDER BY consent_date DESC, id DESC) = 1),
  lat AS (SELECT * FROM cons QUALIFY row_number() OVER (PARTITION BY user_id, purpose ORDER BY consent_date DESC, id DESC) = 1)"""
_REV = f"rev AS (SELECT user_id, {_PURPOSE} AS purpose, ts FROM events WHERE event_type = 'error')"
_GATE = f"""WITH {_CONS}, asked AS (SELECT event_id AS request_id, user_id * 3 % 200 AS user_id, CASE WHEN event_id % 3 = 0 THEN 'access' ELSE 'rectify' END AS kind,
    CASE WHEN event_id % 5 < 3 THEN event_id || '@new.org' END AS email, CASE WHEN event_id % 7 < 3 THEN 'N' || event_id END AS name, ts FROM events WHERE event_type = 'click'),
  g AS (SELECT a.*, EXISTS (SELECT 1 FROM act WHERE act.user_id = a.user_id AND purpose = CASE kind WHEN 'access' THEN 'data-access' ELSE 'rectification' END) AS ok,
    EXISTS (SELECT 1 FROM customer WHERE c_custkey = a.user_id) AS known FROM asked a)"""
_ERASE = f"""WITH {_CONS}, asked AS (SELECT user_id, min(ts) AS at_ts FROM events WHERE event_type = 'error' GROUP BY user_id),
  okd AS (SELECT *, EXISTS (SELECT 1 FROM orders WHERE o_custkey * 2 = user_id) AS payer FROM asked
    WHERE user_id IN (SELECT user_id FROM act WHERE purpose = 'data-access') AND user_id IN (SELECT c_custkey FROM customer))"""
_CHG = "chg AS (SELECT event_id AS id, 'f' || (user_id % 5) AS flag, ts, event_id % 2 = 0 AS v FROM events WHERE event_type = 'error')"

ORACLES = {
    "s1_load_table": "SELECT * REPLACE (epoch_us(o_orderdate) AS o_orderdate) FROM orders",
    "s5_upsert": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'click' DESC) = 1",
    "s7_upsert_users": """WITH l AS (SELECT ['LinkedIn', 'google', 'myspace'][event_id % 3 + 1] AS provider, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE CAST(user_id * 11 AS VARCHAR) END AS provider_id,
          CASE WHEN event_id % 20 = 7 THEN 'a@b@c.org' ELSE event_id || '@site-x.org' END AS email, 'n' || event_id AS name, ts, event_id FROM events),
        k AS (SELECT *, CASE WHEN provider = 'myspace' THEN 'AUTH/UNKNOWN_PROVIDER' WHEN provider_id = ' ' THEN 'AUTH/MISSING_PROVIDER_ACCOUNT_ID' WHEN email = 'a@b@c.org' THEN 'AUTH/INVALID_EMAIL' END AS code FROM l),
        n AS (SELECT lower(provider) AS provider, provider_id, arg_max(email, ts) AS email, arg_max(name, ts) AS name, min(ts) AS first_ts, max(ts) AS last_ts FROM k WHERE code IS NULL GROUP BY 1, 2),
        u AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'google' AS provider, CAST(c_custkey AS VARCHAR) AS provider_id, c_custkey || '@mail.org' AS email, c_name AS name FROM customer)
        SELECT coalesce(user_id, sha256(n.provider || chr(1) || n.provider_id)) AS user_id, coalesce(u.provider, n.provider) AS provider, coalesce(u.provider_id, n.provider_id) AS provider_id,
          coalesce(n.email, u.email) AS email, coalesce(n.name, u.name) AS name, CASE WHEN user_id IS NULL THEN epoch_us(first_ts) ELSE epoch_us(TIMESTAMP '2023-01-01') END AS created_at,
          coalesce(epoch_us(last_ts), epoch_us(TIMESTAMP '2023-06-01')) AS last_login_at, '' AS error_code
        FROM u FULL JOIN n ON u.provider = n.provider AND u.provider_id = n.provider_id
        UNION ALL SELECT '', provider, provider_id, email, name, epoch_us(ts), epoch_us(ts), code FROM k WHERE code IS NOT NULL""",
    "n1_active_consent": f"WITH {_CONS} SELECT user_id, purpose, id, 'active' AS mode FROM act UNION ALL SELECT user_id, purpose, id, 'latest' FROM lat",
    "n2_grant": f"""WITH RECURSIVE old AS (SELECT user_id, {_PURPOSE} AS purpose, event_id % 4 AS p, event_id % 3 = 0 AS gone FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '{AS_OF}'
          QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC) = 1),
        seq AS (SELECT user_id, {_PURPOSE} AS purpose, event_id, event_type = 'error' AS cut, event_id % 7 AS p,
          row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_type) AS rn FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '{AS_OF}'),
        walk AS (SELECT s.user_id, s.purpose, CAST(0 AS BIGINT) AS rn, CAST(CASE WHEN o.gone THEN NULL ELSE o.p END AS BIGINT) AS held, CAST(NULL AS BIGINT) AS request_id, false AS ok
          FROM (SELECT DISTINCT user_id, purpose FROM seq) s LEFT JOIN old o ON o.user_id = s.user_id AND o.purpose = s.purpose
          UNION ALL SELECT s.user_id, s.purpose, s.rn, CASE WHEN cut THEN NULL WHEN held IS NULL OR s.p > held THEN s.p ELSE held END,
            CASE WHEN NOT cut THEN s.event_id END, NOT cut AND (held IS NULL OR s.p > held)
          FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.purpose = w.purpose AND s.rn = w.rn + 1)
        SELECT request_id, CASE WHEN ok THEN 'GRANTED' ELSE 'CONSENT/ALREADY_GRANTED' END AS verdict FROM walk WHERE request_id IS NOT NULL""",
    "n3_consent_history": f"WITH {_CONS} SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY consent_date DESC, id DESC) AS INTEGER) AS rank FROM cons",
    "n3_revoke": f"""WITH {_CONS}, {_REV}, r AS (SELECT user_id, purpose, min(ts) AS ts FROM rev GROUP BY ALL)
        SELECT c.id, c.user_id, c.purpose, coalesce(epoch_us(c.revoked_at), epoch_us(r.ts), -1) AS revoked_at, '' AS error_code
        FROM cons c LEFT JOIN act a ON a.id = c.id LEFT JOIN r ON a.user_id = r.user_id AND a.purpose = r.purpose
        UNION ALL SELECT -1, user_id, purpose, -1, 'CONSENT/REQUIRED' FROM r WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.user_id = r.user_id AND a.purpose = r.purpose)""",
    "n3_revoke_all": f"""WITH {_CONS}, {_REV} SELECT id, coalesce(epoch_us(revoked_at), epoch_us(t), -1) AS revoked_at
        FROM cons LEFT JOIN (SELECT user_id, min(ts) AS t FROM rev GROUP BY user_id) USING (user_id)""",
    "n4_gated_requests": f"""{_GATE}, p AS (SELECT user_id, arg_max(email, ts) FILTER (WHERE email IS NOT NULL) AS e, arg_max(name, ts) FILTER (WHERE name IS NOT NULL) AS n
          FROM g WHERE ok AND known AND kind = 'rectify' GROUP BY user_id)
        SELECT c_custkey AS user_id, coalesce(e, c_custkey || '@mail.org') AS email, coalesce(n, c_name) AS name FROM customer LEFT JOIN p ON p.user_id = c_custkey""",
    "n4_treatment_log": f"""{_GATE} SELECT user_id, CASE WHEN NOT ok THEN 'CONSENT/REQUIRED' WHEN NOT known THEN 'ARCO/DATA_NOT_FOUND' ELSE kind END AS action, epoch_us(ts) AS ts FROM g""",
    "n5_erase": f"""{_ERASE} SELECT c_custkey AS user_id, CASE WHEN payer THEN 'redacted' ELSE 'google' END AS provider,
        CASE WHEN payer THEN '[deleted]@anonymized' ELSE c_custkey || '@mail.org' END AS email, CASE WHEN payer THEN '[Deleted User]' ELSE c_name END AS name
        FROM customer LEFT JOIN okd ON user_id = c_custkey WHERE payer IS NULL OR payer""",
    "n5_erase_children": f"""{_ERASE} SELECT 'ledger' AS target, user_id, event_id AS id, CAST(-1 AS BIGINT) AS at FROM events WHERE user_id NOT IN (SELECT user_id FROM okd WHERE NOT payer)
        UNION ALL SELECT 'consents', c.user_id, id, coalesce(epoch_us(revoked_at), epoch_us(at_ts), -1) FROM cons c LEFT JOIN okd ON okd.user_id = c.user_id WHERE payer IS NULL OR payer
        UNION ALL SELECT CASE WHEN payer THEN 'log anonymize' ELSE 'log delete' END, user_id, -1, epoch_us(at_ts) FROM okd
        UNION ALL SELECT 'CONSENT/REQUIRED', user_id, -1, -1 FROM asked WHERE user_id NOT IN (SELECT user_id FROM act WHERE purpose = 'data-access')""",
    "f1_flag_asof": f"""WITH {_CHG}, r AS (SELECT event_id, 'f' || (user_id % 7) AS flag, ts FROM events WHERE event_type = 'purchase')
        SELECT event_id, r.flag, coalesce(CAST(v AS VARCHAR), CASE WHEN r.flag IN ('f0', 'f5') THEN 'true' ELSE 'FLAG_NOT_FOUND' END) AS value
        FROM r ASOF LEFT JOIN chg ON r.flag = chg.flag AND r.ts >= chg.ts""",
    "f2_flag_audit": f"""WITH {_CHG} SELECT id, flag, coalesce(CAST(lag(v) OVER (PARTITION BY flag ORDER BY ts, id) AS VARCHAR), CASE flag WHEN 'f0' THEN 'true' ELSE 'none' END) AS old_value,
        v AS new_value FROM chg""",
    "d1_save_results": """SELECT request_id, save_id, epoch_us(expires_at) AS expires_at, expires_at < TIMESTAMP '2024-01-30 12:00:00' AS expired FROM (
          SELECT event_id % 997 AS request_id, event_id AS save_id, ts + CASE event_type WHEN 'purchase' THEN INTERVAL 90 MINUTE ELSE INTERVAL 24 HOUR END AS expires_at FROM events
          QUALIFY row_number() OVER (PARTITION BY event_id % 997 ORDER BY ts DESC, event_id DESC) = 1)""",
    "d1_expire": """SELECT CASE WHEN ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20' THEN 'deleted' ELSE 'kept' END AS what, count(*) AS n FROM events GROUP BY 1""",
    "q1_fixed_window_quota": """WITH p(t, permit, s) AS (VALUES ('view', 1, 86400), ('click', 2, 604800), ('purchase', 3, 604800), ('error', 1, 3600)),
        e AS (SELECT event_id, user_id, event_type, ts, permit, epoch_us(ts) // (s * 1000000::BIGINT) * (s * 1000000::BIGINT) AS w FROM events LEFT JOIN p ON t = event_type)
        SELECT event_id, coalesce(w, -1) AS window_start, permit IS NULL OR row_number() OVER (PARTITION BY user_id, event_type, w ORDER BY ts, event_id) <= permit AS admitted FROM e""",
    "q2_anchored_window_quota": """WITH RECURSIVE s AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        walk AS (SELECT event_id, user_id, rn, t, t AS anchor, 1 AS n FROM s WHERE rn = 1
          UNION ALL SELECT s.event_id, s.user_id, s.rn, s.t, CASE WHEN s.t - anchor >= 172800000000 THEN s.t ELSE anchor END, CASE WHEN s.t - anchor >= 172800000000 THEN 1 ELSE n + 1 END
          FROM walk w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
        SELECT event_id, user_id AS key, n, n <= 2 AS admitted,
          CAST(CASE WHEN n <= 2 THEN 0 ELSE greatest(1, ceil((anchor + 172800000000 - t) / 1000000.0::DOUBLE)) END AS INTEGER) AS retry_after FROM walk""",
}
