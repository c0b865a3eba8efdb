"""Rewrite audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.wordlists import ENTITY_CERTIFICATIONS, ENTITY_SKILLS, ENTITY_TITLES
from ..operators import audit
from . import common as c


def originals(spark, sf):
    """Documents with some entities planted by document number; the corpus itself holds few."""
    doc = F.col("doc_id")
    planted = F.concat_ws(
        " ", "text", F.lit(" en Acme"), F.lit("Corp, desde 01/2020, 2019 - 2021 Senior"),
        F.when(doc % 2 == 0, F.lit("Python SQL")), F.concat((doc % 90).cast("string"), F.lit("% java")))
    return c.table(spark, sf, "documents").select("doc_id", planted.alias("text"))


def rewrites(spark, sf):
    """The same with other claims added."""
    doc = F.col("doc_id")
    claim = F.concat_ws(
        " ", "text", F.when(doc % 3 == 0, F.lit("at Globex Labs, PMP")), F.when(doc % 5 == 0, F.lit("Docker, Kubernetes and Redis")),
        F.when(doc % 7 == 0, F.lit("40x growth")), F.when(doc % 4 == 1, F.lit("DIRECTOR Director")))
    return originals(spark, sf).select("doc_id", claim.alias("text"))


def _entities(spark, sf):
    return audit.extract_entities(originals(spark, sf)), audit.extract_entities(rewrites(spark, sf))


def a1(spark, sf):
    return audit.extract_entities(rewrites(spark, sf))


def a2(spark, sf):
    return audit.entity_types(*_entities(spark, sf))


def a3(spark, sf):
    return audit.inventions(*_entities(spark, sf))


def a4(spark, sf):
    return audit.severity(c.table(spark, sf, "documents"), audit.inventions(*_entities(spark, sf)))


def a5(spark, sf):
    out = audit.export_gate(c.table(spark, sf, "documents"), audit.inventions(*_entities(spark, sf)))
    return out.withColumn("offending", F.array_join("offending", ","))


def steps(spark, sf):
    turns = c.table(spark, sf, "conversations")
    return turns.select(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).cast("int").alias("step"),
                        (F.length("text") % 101).cast("int").alias("score"), (F.length("text") % 3 != 0).alias("passed"))


def a6(spark, sf):
    return audit.best_of_n(steps(spark, sf)).na.fill(-1)


def a7(spark, sf):
    requests = steps(spark, sf).groupBy("request_id").agg(
        F.count(F.lit(1)).cast("int").alias("iteration_count"), (F.max("score") * 4).alias("elapsed_seconds")
    ).withColumn("threshold", (F.col("request_id") % 110).cast("int"))
    return audit.run_status(steps(spark, sf), requests).na.fill(-1, ["best_step", "best_score"])


def a8(spark, sf):
    docs = c.table(spark, sf, "documents").select(F.col("doc_id").alias("cv_id"), F.col("text").alias("cv_text"))
    wanted = c.table(spark, sf, "benchmark").select(F.col("item_id").alias("job_id"), F.split("text", " ").alias("requirements"))
    rows = c.pairs(spark, sf).join(docs, "cv_id").join(wanted, "job_id")
    return audit.missing_requirements(rows).select("cv_id", "job_id", F.array_join(F.transform("missing", F.lower), " ").alias("missing"))


def a9(spark, sf):
    mark = F.element_at(F.array(F.lit("Explicit"), F.lit("Inferred"), F.lit("UserConfirmed")), (F.col("turn") % 3 + 1).cast("int"))
    markers = c.table(spark, sf, "conversations").select("conv_id", F.concat_ws("_", "role", F.col("turn")).alias("field"), mark.alias("m"))
    rows = markers.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("confidence"))
    out = audit.confidence_rollup(rows, "conv_id")
    return out.select("conv_id", *[F.array_join(x, ",").alias(x) for x in ("confirmed", "explicit", "risks")])


QUERIES = {
    "a1_extract_entities": a1, "a2_entity_types": a2, "a3_inventions": a3, "a4_severity": a4, "a5_export_gate": a5,
    "a6_best_of_n": a6, "a7_run_status": a7, "a8_missing_requirements": a8, "a9_confidence_rollup": a9,
}


def _list(names: list[str]) -> str:
    return "[" + ", ".join(c.sql_quote(n) for n in names) + "]"


_ORIG = """concat_ws(' ', text, ' en Acme', 'Corp, desde 01/2020, 2019 - 2021 Senior', CASE WHEN doc_id % 2 = 0 THEN 'Python SQL' END,
    (doc_id % 90) || '% java')"""
_ADAPT = f"""concat_ws(' ', {_ORIG}, CASE WHEN doc_id % 3 = 0 THEN 'at Globex Labs, PMP' END,
    CASE WHEN doc_id % 5 = 0 THEN 'Docker, Kubernetes and Redis' END, CASE WHEN doc_id % 7 = 0 THEN '40x growth' END,
    CASE WHEN doc_id % 4 = 1 THEN 'DIRECTOR Director' END)"""
_B = "(?:^|[^\\pL\\pN_])"
_DATE = "(?i)(?:desde|hasta|entre)\\s+(\\d{1,2}/\\d{4})|(\\d{1,2}/\\d{4})\\s*-\\s*(\\d{1,2}/\\d{4})|\\b(\\d{4})\\s*-\\s*(\\d{4})\\b"
_METRIC = ("(?i)\\b(\\d+\\s*%|\\d+x(?:\\s+(?:aumento|growth|incremento))?|\\d+\\s*(?:usuarios|clientes|requests|MB|GB|M\\+|K\\+|millones?)|\\d+M)")
_COMPANY = f"{_B}(?:en|at|@|para|trabaj[ée] en)\\s+([A-Z][A-Za-z0-9&]+(?:\\s+[A-Z][A-Za-z0-9&]+){{0,3}})"
_TITLE = "\\b(" + "|".join(ENTITY_TITLES) + ")\\b"


def _entities_sql(tag: str, text: str) -> str:
    dates = " || ".join(f"regexp_extract_all(text, '{_DATE}', {g})" for g in range(1, 6))
    return f"""
    src_{tag} AS (SELECT doc_id, {text} AS text FROM documents),
    all_{tag} AS (
      SELECT doc_id, 'Skill' AS kind, 1 AS r, unnest(list_filter({_list(ENTITY_SKILLS)}, lambda s: contains(lower(text), lower(s)))) AS value FROM src_{tag}
      UNION ALL SELECT doc_id, 'Company', 2, trim(unnest(regexp_extract_all(text, '{_COMPANY}', 1))) FROM src_{tag}
      UNION ALL SELECT doc_id, 'Date', 3, unnest({dates}) FROM src_{tag}
      UNION ALL SELECT doc_id, 'Metric', 4, trim(unnest(regexp_extract_all(text, '{_METRIC}', 1))) FROM src_{tag}
      UNION ALL SELECT doc_id, 'Certification', 5, unnest(list_filter({_list(ENTITY_CERTIFICATIONS)}, lambda s: contains(lower(text), lower(s)))) FROM src_{tag}
      UNION ALL SELECT doc_id, 'Title', 6, unnest(regexp_extract_all(text, '{_TITLE}', 1)) FROM src_{tag}),
    ents_{tag} AS (SELECT doc_id, kind, r, lower(value) AS low, min(value) AS value FROM all_{tag} WHERE value <> '' GROUP BY doc_id, kind, r, lower(value))"""


_ENTS = f"WITH {_entities_sql('o', _ORIG)}, {_entities_sql('a', _ADAPT)}"
_INV = f"""{_ENTS},
    types AS (SELECT doc_id, low, arg_max(kind, r) AS kind FROM (SELECT * FROM ents_o UNION ALL SELECT * FROM ents_a) GROUP BY doc_id, low),
    inv AS (SELECT doc_id, low, kind, CASE WHEN kind IN ('Company', 'Certification', 'Date', 'Title') THEN 'Hard' ELSE 'Soft' END AS hardness, v AS value FROM types
      JOIN (SELECT doc_id, low, arg_min(value, r) AS v FROM ents_a a WHERE NOT EXISTS (
        SELECT 1 FROM ents_o o WHERE o.doc_id = a.doc_id AND o.low = a.low) GROUP BY doc_id, low) USING (doc_id, low))"""
_STEPS = """WITH steps AS (SELECT conv_id AS request_id, CAST(turn + 1 AS INTEGER) AS step, CAST(length(text) % 101 AS INTEGER) AS score,
    length(text) % 3 <> 0 AS passed FROM conversations),
    best AS (SELECT request_id, count(*) AS n_steps FROM steps GROUP BY request_id),
    top AS (SELECT request_id, step AS best_step, score AS best_score FROM steps WHERE passed
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, step) = 1)"""

ORACLES = {
    "a1_extract_entities": f"{_ENTS} SELECT doc_id, kind, value FROM ents_a",
    "a2_entity_types": f"{_INV} SELECT doc_id, low, kind FROM types",
    "a3_inventions": f"{_INV} SELECT doc_id, kind, value, hardness FROM inv",
    "a4_severity": f"""{_INV} SELECT doc_id, coalesce(h, 0) AS n_hard, coalesce(s, 0) AS n_soft,
        CASE WHEN h >= 1 OR s >= 3 THEN 'Critical' WHEN s > 0 THEN 'Warning' ELSE 'None' END AS severity
        FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE hardness = 'Hard') AS h,
          count(*) FILTER (WHERE hardness = 'Soft') AS s FROM inv GROUP BY doc_id) USING (doc_id)""",
    "a5_export_gate": f"""{_INV} SELECT doc_id, o IS NULL AS can_export, coalesce(o, '') AS offending
        FROM documents LEFT JOIN (SELECT doc_id, string_agg(value, ',' ORDER BY value) AS o FROM inv WHERE hardness = 'Hard' GROUP BY doc_id) USING (doc_id)""",
    "a6_best_of_n": f"{_STEPS} SELECT request_id, best_step, best_score, n_steps FROM best LEFT JOIN top USING (request_id)",
    "a7_run_status": f"""{_STEPS}, req AS (SELECT request_id, CAST(count(*) AS INTEGER) AS iteration_count, CAST(max(score) * 4 AS INTEGER) AS elapsed_seconds,
          CAST(request_id % 110 AS INTEGER) AS threshold FROM steps GROUP BY request_id),
        j AS (SELECT *, iteration_count NOT BETWEEN 1 AND 20 OR threshold NOT BETWEEN 0 AND 100 AS bad FROM req LEFT JOIN top USING (request_id))
        SELECT request_id, iteration_count, elapsed_seconds, threshold, best_step, best_score,
          CASE WHEN bad THEN NULL WHEN best_step IS NULL THEN 'Failed' WHEN elapsed_seconds > 300 THEN 'TimedOut' ELSE 'Completed' END AS status,
          NOT bad AND elapsed_seconds > 300 AND best_step IS NOT NULL AS partial,
          NOT bad AND best_step IS NOT NULL AND coalesce(best_score < threshold, false) AS low_score_warning,
          CASE WHEN bad THEN 'INVALID_REQUEST' END AS error_code FROM j""",
    "a8_missing_requirements": f"""WITH {c.SQL_PAIRS}, r AS (
          SELECT cv_id, job_id, d.text AS cv, lower(unnest(string_split(b.text, ' '))) AS q FROM pairs
          JOIN documents d ON d.doc_id = cv_id JOIN benchmark b ON b.item_id = job_id)
        SELECT cv_id, job_id, coalesce(string_agg(DISTINCT q, ' ' ORDER BY q) FILTER (WHERE NOT contains(lower(cv), q)), '') AS missing
        FROM r GROUP BY cv_id, job_id""",
    "a9_confidence_rollup": """SELECT conv_id,
        coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE m = 2), '') AS confirmed,
        coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE m = 0), '') AS explicit,
        coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE m = 1), '') AS risks
        FROM (SELECT conv_id, role || '_' || turn AS f, turn % 3 AS m FROM conversations) GROUP BY conv_id""",
}

for _name in ("a6_best_of_n", "a7_run_status"):
    ORACLES[_name] = c.sql_no_null(ORACLES[_name], "best_step", "best_score")
