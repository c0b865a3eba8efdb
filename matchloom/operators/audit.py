"""Rewrite audit and best-of-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import ENTITY_CERTIFICATIONS, ENTITY_SKILLS, ENTITY_TITLES

KINDS = ["Skill", "Company", "Date", "Metric", "Certification", "Title"]
HARD_KINDS = ["Company", "Certification", "Date", "Title"]

# Entity patterns. Each looks at the next character first, as word boundaries are costly to find.
_COMPANY = r"(?Ud)(?=[ea@pt])\b(?:en|at|@|para|trabaj[ée] en)\s+([A-Z][A-Za-z0-9&]+(?:\s+[A-Z][A-Za-z0-9&]+){0,3})"
_DATE = (r"(?iU)(?=[dhe\d])(?:(?:desde|hasta|entre)\s+(\d{1,2}/\d{4})|(\d{1,2}/\d{4})\s*-\s*(\d{1,2}/\d{4})"
         r"|\b(\d{4})\s*-\s*(\d{4})\b)")
_METRIC = (r"(?iU)(?=\d)\b(\d+\s*%|\d+x(?:\s+(?:aumento|growth|incremento))?"
           r"|\d+\s*(?:usuarios|clientes|requests|MB|GB|M\+|K\+|millones?)|\d+M)")
_TITLE = r"(?U)(?=[" + "".join(sorted({t[0] for t in ENTITY_TITLES})) + r"])\b(" + "|".join(ENTITY_TITLES) + r")\b"


def _listed(text: Column, names: list[str], mode: str) -> Column:
    def found(low: Column) -> Column:
        def hit(n: str) -> Column:
            if mode == "substring":
                return low.contains(n.lower())
            return low.rlike(r"(?<![\p{L}\p{N}])" + tx.any_of([n.lower()]) + r"(?![\p{L}\p{N}])")

        return F.array_compact(F.array(*[F.when(hit(n), F.lit(n)) for n in names]))

    return tx.let(F.lower(text), found)


def extract_entities(docs: DataFrame, key: str = "doc_id", col: str = "text", skills: list[str] | None = None,
                     certifications: list[str] | None = None, mode: str = "substring") -> DataFrame:
    """A1: distinct ``(key, kind, value)``; values differing only in case are one, the first spelling in the
    text counts. Everything is found inside the row, so no shuffle is needed."""
    text = F.col(col)
    # The text is searched once; what was found gives the same groups again when it stands alone.
    def group(hits: Column, g: int) -> Column:
        return F.transform(hits, lambda hit: F.regexp_extract(hit, _DATE, g))

    dates = tx.let(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)), lambda hits: F.flatten(F.array(*[group(hits, g) for g in (1, 2, 3, 4, 5)])))
    found = {
        "Skill": _listed(text, skills or ENTITY_SKILLS, mode),
        "Company": F.transform(F.regexp_extract_all(text, F.lit(_COMPANY), F.lit(1)), tx.trim_space),
        "Date": F.filter(dates, lambda d: d != ""),
        "Metric": F.transform(F.regexp_extract_all(text, F.lit(_METRIC), F.lit(1)), tx.trim_space),
        "Certification": _listed(text, certifications or ENTITY_CERTIFICATIONS, "substring"),
        "Title": F.regexp_extract_all(text, F.lit(_TITLE), F.lit(1)),
    }

    def distinct_ignoring_case(values: Column) -> Column:
        lows = F.transform(F.array_distinct(values), lambda v: F.struct(F.lower(v).alias("low"), v.alias("value")))
        return tx.let(lows, lambda all_: F.transform(
            F.array_distinct(F.transform(all_, lambda x: x["low"])),
            lambda low: F.element_at(F.filter(all_, lambda x: x["low"] == low), 1)["value"]))

    def rows_of(kind: str, values: Column) -> Column:
        return F.transform(distinct_ignoring_case(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    entries = F.concat(*[rows_of(kind, values) for kind, values in found.items()])
    return docs.filter(~tx.is_blank(text)).select(key, F.inline(entries))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def entity_types(original: DataFrame, adapted: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2: one kind per ``(key, lower value)``; the later kind of :data:`KINDS` wins."""
    both = original.select(key, "kind", "value").unionByName(adapted.select(key, "kind", "value"))
    return both.groupBy(key, F.lower("value").alias("low")).agg(F.max_by("kind", _rank(F.col("kind"))).alias("kind"))


def inventions(original: DataFrame, adapted: DataFrame, types: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """A3: adapted values absent from the original, ignoring case: ``(key, kind, value, hardness)``. Without ``types``, those of
    :func:`entity_types` come out of the same aggregate, so that each side is read once."""
    sides = [side.select(key, "kind", "value", F.lit(own).alias("_own")) for side, own in ((original, True), (adapted, False))]
    both = sides[0].unionByName(sides[1]).withColumns({"low": F.lower("value"), "_r": _rank(F.col("kind"))})
    once = both.filter(F.col(key).isNotNull() & F.col("low").isNotNull()).groupBy(key, "low").agg(
        F.max_by("kind", "_r").alias("kind"), F.bool_or("_own").alias("_held"),
        F.min_by("value", F.when(~F.col("_own"), F.struct("_r", "value"))).alias("value")).filter(~F.col("_held"))
    if types is not None:
        once = once.drop("kind").join(types, [key, "low"])
    hard = F.when(F.col("kind").isin(HARD_KINDS), "Hard").otherwise("Soft")
    return once.select(key, "kind", "value", hard.alias("hardness"))


def severity(docs: DataFrame, invented: DataFrame, key: str = "doc_id") -> DataFrame:
    """A4: severity of every document in ``docs``; None without invention."""
    counts = invented.groupBy(key).agg(
        F.count_if(F.col("hardness") == "Hard").alias("n_hard"), F.count_if(F.col("hardness") == "Soft").alias("n_soft"))
    rows = docs.select(key).join(counts, key, "left").na.fill(0, ["n_hard", "n_soft"])
    level = (F.when((F.col("n_hard") >= 1) | (F.col("n_soft") >= 3), "Critical")
             .when(F.col("n_soft") > 0, "Warning").otherwise("None"))
    return rows.withColumn("severity", level)


def export_gate(docs: DataFrame, invented: DataFrame, key: str = "doc_id") -> DataFrame:
    """A5: blocked by any hard invention, with the sorted offending values. Soft ones never block."""
    bad = invented.filter("hardness = 'Hard'").groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("offending"))
    return docs.select(key).join(bad, key, "left").select(
        key, F.col("offending").isNull().alias("can_export"),
        F.coalesce("offending", F.array().cast("array<string>")).alias("offending"))


def best_of_n(steps: DataFrame, key: str = "request_id") -> DataFrame:
    """Best step that passed; the earliest wins ties. ``steps(request_id, step, score, passed)``."""
    ok = F.col("passed")
    rank = F.when(ok, F.struct("score", (-F.col("step")).alias("o")))
    return steps.groupBy(key).agg(
        F.max_by(F.struct("step", "score"), rank).alias("b"), F.count(F.lit(1)).alias("n_steps"),
        F.max(F.when(ok, 1).otherwise(0)).alias("_any"),
    ).select(key, F.when(F.col("_any") == 1, F.col("b.step")).alias("best_step"),
             F.when(F.col("_any") == 1, F.col("b.score")).alias("best_score"), "n_steps")


def run_status(steps: DataFrame, requests: DataFrame, key: str = "request_id", budget_seconds: int = 300) -> DataFrame:
    """``requests(request_id, iteration_count, threshold, elapsed_seconds)`` with status, partial flag and
    the low-score warning; requests outside the bounds carry an error code instead."""
    best = requests.join(best_of_n(steps, key), key, "left")
    bad = ~F.col("iteration_count").between(1, 20) | ~F.col("threshold").between(0, 100)
    late = F.col("elapsed_seconds") > budget_seconds
    has = F.col("best_step").isNotNull()
    return best.select(
        *requests.columns, "best_step", "best_score",
        F.when(~bad, F.when(~has, "Failed").when(late, "TimedOut").otherwise("Completed")).alias("status"),
        (~bad & late & has).alias("partial"),
        (~bad & has & (F.col("best_score") < F.col("threshold"))).alias("low_score_warning"),
        F.when(bad, "INVALID_REQUEST").alias("error_code"))


def missing_requirements(pairs: DataFrame, cv_text: str = "cv_text", requirements: str = "requirements") -> DataFrame:
    """Requirements that are no substring of the CV text, ignoring case, distinct and sorted so."""
    low = F.lower(cv_text)
    absent = F.filter(requirements, lambda r: ~F.contains(low, F.lower(r)))
    first = tx.let(absent, lambda rs: F.transform(
        F.array_sort(F.array_distinct(F.transform(rs, F.lower))),
        lambda l: F.element_at(F.filter(rs, lambda r: F.lower(r) == l), 1)))
    return pairs.withColumn("missing", first)


def confidence_rollup(markers: DataFrame, key: str = "cv_id") -> DataFrame:
    """Sorted field names by confidence. ``markers(cv_id, confidence map<field, marker>)``."""
    def fields(*values: str) -> Column:
        return F.array_sort(F.map_keys(F.map_filter("confidence", lambda _, v: v.isin(*values))))

    return markers.select(key, fields("UserConfirmed").alias("confirmed"), fields("Explicit").alias("explicit"),
                          fields("Inferred").alias("risks"))
