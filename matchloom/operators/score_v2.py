"""Structured scoring engine.

A pair row carries the nested CV (``basics``, ``work``, ``education``, ``skills``, ``certificates``) and the
job (``title``, ``requirements``). Everything is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Weights, thresholds and bands.
W_EXPERIENCE, W_EDUCATION, W_SKILLS, W_CONTACT = 0.40, 0.20, 0.30, 0.10
GAP_MONTHS = 6
HOPPING_MONTHS = 24
HOPPING_JOBS = 3
MISMATCH_BELOW = 50
ENGINE_V2 = "2.0.0"
_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def v2_tokens(text: Column) -> Column:
    """Lower-case runs of ``a-z0-9``; accents split words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _or_empty(array: Column, like: str) -> Column:
    return F.coalesce(array, F.array().cast(like))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def valid_email() -> Column:
    return F.coalesce(F.col("basics.email").rlike(_EMAIL), F.lit(False))


def valid_phone() -> Column:
    return F.coalesce(F.regexp_count(F.col("basics.phone"), F.lit(r"(?U)\d")) >= 10, F.lit(False))


def relevant_jobs() -> Column:
    return tx.let(v2_tokens(F.col("title")), lambda title: F.size(F.filter(
        "work", lambda w: F.coalesce(F.arrays_overlap(v2_tokens(_joined(w["position"], w["name"])), title), F.lit(False)))))


def _experience(n: Column) -> Column:
    return F.when(n >= 3, 95).when(n == 2, 80).when(n == 1, 60).otherwise(30)


def experience_score(pairs: DataFrame) -> DataFrame:
    """R2."""
    return pairs.withColumn("experience", _experience(relevant_jobs()))


def _requirement_tokens() -> Column:
    return F.array_distinct(F.flatten(F.transform(_or_empty(F.col("requirements"), "array<string>"), v2_tokens)))


def education_score(pairs: DataFrame) -> DataFrame:
    """R3."""
    overlap = tx.let(_requirement_tokens(), lambda need: F.exists(
        "education", lambda e: F.coalesce(F.arrays_overlap(v2_tokens(_joined(e["institution"], e["area"], e["study_type"])), need), F.lit(False))))
    return pairs.withColumn("education_score", F.when(F.coalesce(F.size("education"), F.lit(0)) <= 0, 0).when(overlap, 90).otherwise(60))


def skill_coverage(pairs: DataFrame) -> DataFrame:
    """``coverage`` in percent and ``skills_score`` (half to even, or from certificates without requirements)."""
    have = F.array_distinct(F.flatten(F.transform("skills", lambda s: v2_tokens(s["name"]))))
    coverage = tx.let(_requirement_tokens(), lambda need: F.when(F.size(need) > 0, F.lit(100.0) * F.size(F.array_intersect(need, have)) / F.size(need)).otherwise(0.0))
    none = F.size(_or_empty(F.col("requirements"), "array<string>")) == 0
    out = pairs.withColumn("coverage", F.when(none, 0.0).otherwise(coverage))
    from_certificates = F.greatest(F.size("certificates") * 25, F.lit(50))
    return out.withColumn("skills_score", F.when(none, from_certificates).otherwise(F.bround("coverage").cast("int")))


def certification_score(cvs: DataFrame) -> DataFrame:
    """R5."""
    return cvs.withColumn("certification_score", F.least(F.lit(100), F.size("certificates") * 50))


def contact_score(cvs: DataFrame) -> DataFrame:
    """R6."""
    url = ~tx.is_blank(F.col("basics.url"))
    return cvs.withColumn("contact_score", F.when(valid_email() & valid_phone() & url, 100).when(valid_email() & valid_phone(), 70)
                          .when(valid_email(), 40).otherwise(0))


def month_number(text: Column) -> Column:
    """Months since year 0 of an exact ``yyyy-MM``, else null."""
    ok = text.rlike(r"^(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])\z")
    return F.when(ok, F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int"))


def _dated() -> Column:
    jobs = F.transform("work", lambda w, i: F.struct(
        w["start"].alias("start"), i.alias("i"), month_number(w["start"]).alias("from"), month_number(w["end"]).alias("to")))
    return F.array_sort(F.filter(jobs, lambda j: j["from"].isNotNull()))


def employment_gap(cvs: DataFrame) -> DataFrame:
    """``gap_months``: largest gap of more than six months between consecutive jobs by start, else null."""
    def largest(jobs: Column) -> Column:
        gaps = F.zip_with(F.slice(jobs, 2, F.greatest(F.size(jobs) - 1, F.lit(0))), F.slice(jobs, 1, F.greatest(F.size(jobs) - 1, F.lit(0))),
                          lambda cur, prev: cur["from"] - prev["to"])
        return F.array_max(F.filter(gaps, lambda g: g > GAP_MONTHS))

    return cvs.withColumn("gap_months", tx.let(_dated(), largest))


def job_hopping(cvs: DataFrame) -> DataFrame:
    """More than three jobs starting within two years before the latest start."""
    def hops(jobs: Column) -> Column:
        starts = F.transform(jobs, lambda j: j["from"])
        return F.size(F.filter(starts, lambda s: s >= F.array_max(starts) - HOPPING_MONTHS)) > HOPPING_JOBS

    return cvs.withColumn("hopping", tx.let(_dated(), hops))


def band_v2(overall: Column) -> Column:
    return F.when(overall < 40, "Bajo").when(overall < 70, "Medio").otherwise("Alto")


def _flag(code: str, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def context_hash_v2(pairs: DataFrame) -> DataFrame:
    """R11."""
    need = F.array_join(F.array_sort(_or_empty(F.col("requirements"), "array<string>")), ",")
    parts = [F.lit("v2"), F.coalesce("basics.email", F.lit(""))]
    parts += [F.size(x).cast("string") for x in ("work", "education", "skills", "certificates")]
    parts += [F.coalesce("title", F.lit("")), need]
    return pairs.withColumn("context_hash", F.sha2(F.concat_ws("|", *parts), 256))


def score_v2(pairs: DataFrame) -> DataFrame:
    """Section scores, red flags, overall (half to even) and band. Without a valid e-mail every score
    is 0 and the only flag is MISSING_EMAIL."""
    rows = experience_score(pairs)
    for step in (education_score, skill_coverage, certification_score, contact_score, employment_gap, job_hopping, context_hash_v2):
        rows = step(rows)
    has_need = F.size(_or_empty(F.col("requirements"), "array<string>")) > 0
    flags = F.array_compact(F.array(
        F.when(~valid_phone(), _flag("MISSING_PHONE", "Low")),
        F.when(has_need & (F.col("coverage") < MISMATCH_BELOW), _flag("SKILL_MISMATCH", "Medium")),
        F.when(F.col("gap_months").isNotNull(), _flag("EMPLOYMENT_GAP", "Medium")),
        F.when(F.col("hopping"), _flag("JOB_HOPPING", "Low"))))
    raw = (F.col("experience") * F.lit(W_EXPERIENCE) + F.col("education_score") * F.lit(W_EDUCATION)
           + F.col("skills_score") * F.lit(W_SKILLS) + F.col("contact_score") * F.lit(W_CONTACT))
    rows = rows.withColumn("_ok", valid_email())
    gate = lambda col: F.when(F.col("_ok"), col).otherwise(0)
    clamp = lambda col: F.least(F.greatest(col, F.lit(0)), F.lit(100))
    rows = rows.withColumns({
        "overall": gate(clamp(F.bround(raw).cast("int"))),
        "red_flags": F.when(F.col("_ok"), flags).otherwise(F.array(_flag("MISSING_EMAIL", "High"))),
    })
    rows = rows.withColumns({
        **{c: gate(clamp(F.col(c))) for c in ("experience", "education_score", "skills_score", "certification_score", "contact_score")},
        "band": band_v2(F.col("overall")),
        "engine_version": F.lit(ENGINE_V2),
    })
    return rows.drop("_ok")


def red_flags(pairs: DataFrame) -> DataFrame:
    """R9 long form: one row per flag."""
    return score_v2(pairs).select("cv_id", "job_id", F.inline("red_flags"))
