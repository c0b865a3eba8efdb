"""Text scoring engine (C1-C11). Every component is an expression over the pair row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Component weights and measurability.
WEIGHTS = {"match": 0.45, "structure": 0.20, "achievements": 0.20, "format": 0.10, "length": 0.05}
FORMAT_BASELINE = 0.75
FORMAT_MEASURABILITY = 0.5
ENGINE_V1 = "1.0.0"


def _clamp01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def _fold_sum(array: Column, term) -> Column:
    """Sum in array order, so the result does not depend on partitioning."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + term(x))


def total_weight(matches: str = "matches") -> Column:
    return _fold_sum(F.col(matches), lambda m: m["weight"])


def with_match_score(df: DataFrame, matches: str = "matches") -> DataFrame:
    """C1."""
    total = total_weight(matches)
    credited = _fold_sum(F.col(matches), lambda m: m["weight"] * m["credit"])
    return df.withColumns({
        "match": F.when(total <= 0, 0.0).otherwise(_clamp01(credited / total)),
        "match_confidence": F.when(F.size(matches) >= 4, 0.9).otherwise(0.6),
    })


def match_score(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """C1 over the long form ``(cv_id, job_id, skill_id, weight, credit)``, summed in weight and id order, for every
    pair of ``pairs(cv_id, job_id)``; one without requirements scores 0."""
    item = F.struct((-F.col("weight")).alias("o"), "skill_id", "weight", "credit")
    packed = matches.groupBy("cv_id", "job_id").agg(F.sort_array(F.collect_list(item)).alias("matches"))
    every = pairs.select("cv_id", "job_id").join(packed, ["cv_id", "job_id"], "left")
    none = F.array().cast(packed.schema["matches"].dataType)
    return with_match_score(every.withColumn("matches", F.coalesce("matches", none))).select("cv_id", "job_id", "match", "match_confidence")


def structure_value(contact: str = "has_contact", experience: str = "has_experience",
                    sections: str = "sections_present") -> Column:
    """C2."""
    def has(name: str) -> Column:
        return F.array_contains(sections, name).cast("int")

    score = (has("experience") + has("education") + has("skills")) / F.lit(3.0)
    score = score + F.when(F.col(contact), 0.1).otherwise(0.0)
    score = score + F.when(F.array_contains(sections, "summary"), 0.1).otherwise(0.0)
    score = F.least(score, F.lit(1.0))
    score = F.when(F.col(contact), score).otherwise(F.least(score, F.lit(0.5)))
    return F.when(F.col(experience), score).otherwise(F.least(score, F.lit(0.4)))


def stuffing_penalty(repetition: str = "max_repetition") -> Column:
    rep = F.col(repetition)
    return F.when(rep > 5, F.least(F.lit(0.5), (rep - 5) * F.lit(0.1))).otherwise(0.0)


def achievement_value(verbs: str = "action_verbs", metrics: str = "quantified") -> Column:
    """C3."""
    return (F.lit(0.5) * F.least(F.lit(1.0), F.col(verbs) / F.lit(5.0))
            + F.lit(0.5) * F.least(F.lit(1.0), F.col(metrics) / F.lit(3.0)))


def length_value(word_count: str = "word_count", repetition: str = "max_repetition") -> Column:
    """C5."""
    words = F.col(word_count)
    band = (F.when(words < 150, 0.4).when(words < 250, 0.7).when(words <= 900, 1.0).when(words <= 1200, 0.8).otherwise(0.6))
    return _clamp01(band * (F.lit(1.0) - stuffing_penalty(repetition)))


def gates() -> Column:
    """Gates in the order of the components: ``(component, cap, code)``."""
    def gate(component: str, cap: Column, code: str) -> Column:
        return F.struct(F.lit(component).alias("component"), cap.alias("cap"), F.lit(code).alias("code"))

    return F.array_compact(F.array(
        F.when(~F.col("has_contact"), gate("structure", F.lit(0.5), "no-contact")),
        F.when(~F.col("has_experience"), gate("structure", F.lit(0.4), "no-experience")),
        gate("format", F.lit(0.5), "partial-measurement"),
        F.when(F.col("max_repetition") > 5, gate("length", F.lit(1.0) - stuffing_penalty(), "keyword-stuffing")),
    ))


def structure_score(signals: DataFrame) -> DataFrame:
    return signals.withColumn("structure", structure_value())


def achievement_score(signals: DataFrame) -> DataFrame:
    return signals.withColumn("achievements", achievement_value())


def format_score(docs: DataFrame) -> DataFrame:
    """C4: pasted text cannot be measured, so a fixed baseline at half measurability and a gate."""
    return docs.withColumns({"format": F.lit(FORMAT_BASELINE), "format_measurability": F.lit(FORMAT_MEASURABILITY)})


def length_score(signals: DataFrame) -> DataFrame:
    return signals.withColumn("length", length_value())


def band_v1(overall: Column) -> Column:
    return F.when(overall < 40, "Bajo").when(overall < 65, "Medio").when(overall < 85, "Bueno").otherwise("Fuerte")


def overall_v1(components: DataFrame) -> DataFrame:
    """Weighted mean of the five sub-scores in 0..100, half away from zero, and the band."""
    numerator, denominator = F.lit(0.0), 0.0
    for name, weight in WEIGHTS.items():
        measurability = FORMAT_MEASURABILITY if name == "format" else 1.0
        numerator = numerator + F.lit(weight) * F.lit(measurability) * F.col(name)
        denominator += weight * measurability
    overall = F.round(F.lit(100) * numerator / F.lit(denominator)).cast("int")
    return components.withColumn("overall", overall).withColumn("band", band_v1(F.col("overall")))


def note_code(m: Column) -> Column:
    return (F.when(m["tier"] == "None", "missing").when(m["placement"] == "Buried", "low-visibility").otherwise("direct"))


def classify_keywords(df: DataFrame, matches: str = "matches") -> DataFrame:
    """``present``, ``partial`` and ``missing`` lists in requirement order."""
    def view(tiers: list[str]) -> Column:
        picked = F.filter(matches, lambda m: m["tier"].isin(tiers))
        return F.transform(picked, lambda m: F.struct(
            m["skill_id"].alias("skill_id"), m["display"].alias("term"), m["category"].alias("category"),
            m["section"].alias("section"), m["weight"].alias("weight"), m["tier"].alias("tier"),
            m["placement"].alias("placement"), m["credit"].alias("credit"), note_code(m).alias("note")))

    return df.withColumns({
        "present": view(["Exact", "Alias"]),
        "partial": view(["Related", "Lemma", "Fuzzy"]),
        "missing": view(["None"]),
    })


# Order of recommendation kinds at equal gain (that of their texts).
_KIND_ORDER = {"Learn": 0, "FixFormat": 1, "AddMetric": 2, "Surface": 3}
_REC = "array<struct<neg_gain:int,kind_order:int,sort_key:string,kind:string,component:string,gain:int,term:string>>"


def recommend(df: DataFrame, k: int = 8, matches: str = "matches") -> DataFrame:
    """The ``k`` best recommendations by gain, then by text. They never invent a skill."""
    total = F.greatest(F.lit(0.0001), total_weight(matches))

    def rec(kind: str, component: str, gain: Column, term: Column) -> Column:
        return F.struct(
            (-gain).alias("neg_gain"), F.lit(_KIND_ORDER[kind]).alias("kind_order"),
            F.concat(term, F.lit('"')).alias("sort_key"), F.lit(kind).alias("kind"),
            F.lit(component).alias("component"), gain.alias("gain"), term.alias("term"))

    def of_match(kind: str, keep, factor) -> Column:
        def build(m: Column) -> Column:
            gain = F.greatest(F.lit(1), F.bround(factor(m["weight"]) / total * 100 * F.lit(WEIGHTS["match"])).cast("int"))
            return rec(kind, "match", gain, m["display"])

        return F.transform(F.filter(matches, keep), build)

    learn = of_match("Learn", lambda m: m["tier"] == "None", lambda w: w)
    surface = of_match("Surface", lambda m: (m["placement"] == "Buried") & m["tier"].isin("Exact", "Alias"),
                       lambda w: F.lit(0.4) * w)
    none = F.array().cast(_REC)
    metric = F.when(F.col("quantified") < 2, F.array(rec("AddMetric", "achievements", F.lit(4), F.lit("")))).otherwise(none)
    contact = F.when(~F.col("has_contact"), F.array(rec("FixFormat", "structure", F.lit(3), F.lit("")))).otherwise(none)
    ranked = F.slice(F.sort_array(F.concat(learn, surface, metric, contact).cast(_REC)), 1, k)
    return df.withColumn("recommendations", F.transform(ranked, lambda r: F.struct(
        r["kind"].alias("kind"), r["component"].alias("component"), r["gain"].alias("gain"), r["term"].alias("term"))))


def format_issues(signals: DataFrame) -> DataFrame:
    """C9."""
    def issue(code: str, severity: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    return signals.withColumn("format_issues", F.array_compact(F.array(
        F.when(F.col("quantified") < 2, issue("few-quantified-achievements", "info")),
        F.when(~F.col("has_contact"), issue("missing-contact", "warn")))))


def score_pairs(matched: DataFrame, cvs: DataFrame, lexicon_version: str) -> DataFrame:
    """Full row per pair. ``matched`` comes from ``match_pairs``; ``cvs`` has one row per CV with its
    signals and ``max_repetition``."""
    rows = matched.join(cvs, "cv_id")
    rows = with_match_score(rows).withColumns({
        "structure": structure_value(),
        "achievements": achievement_value(),
        "format": F.lit(FORMAT_BASELINE),
        "length": length_value(),
        "gates": gates(),
        "covered": F.size(F.filter("matches", lambda m: m["tier"] != "None")),
        "n_requirements": F.size("matches"),
    })
    rows = format_issues(recommend(classify_keywords(overall_v1(rows))))
    return rows.withColumns({"engine_version": F.lit(ENGINE_V1), "lexicon_version": F.lit(lexicon_version)})


# --- C11 ------------------------------------------------------------------------------------------

_LABELS = {
    "band": {"Bajo": "low", "Medio": "medium", "Bueno": "high", "Fuerte": "very-high", "Alto": "high-v2"},
    "category": {"hard": "hardSkill", "tool": "tool", "soft": "softSkill", "generic": "generic"},
    "section": {"must": "requisitos", "nice": "deseables", "resp": "responsabilidades", "title": "titulo"},
    "tier": {"Exact": "exact", "Alias": "alias", "Lemma": "stem", "Related": "related", "Fuzzy": "fuzzy", "None": "none"},
    "placement": {"Prominent": "prominent", "Buried": "buried", "NotFound": "absent"},
    "kind": {"Surface": "resurface", "AddMetric": "addMetric", "FixFormat": "fixFormat", "Learn": "learnAdd"},
}


def report_label(kind: str, col: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _LABELS[kind].items() for x in pair])
    return table[col]


def confidence_label(col: Column) -> Column:
    return F.when(col < 0.5, "low").when(col < 0.8, "medium").otherwise("high")


def report_v1(scores: DataFrame) -> DataFrame:
    """C11: one row per pair and component: sub-score in 0..100 (half away from zero) and labels."""
    confidence = {"match": F.col("match_confidence"), "structure": F.lit(0.8), "achievements": F.lit(0.6),
                  "format": F.lit(0.3), "length": F.lit(0.8)}
    parts = F.array(*[
        F.struct(
            F.lit(name).alias("component"),
            F.round(F.col(name) * 100).cast("int").alias("points"),
            F.lit(weight).alias("weight"),
            F.lit(FORMAT_MEASURABILITY if name == "format" else 1.0).alias("measurability"),
            confidence_label(confidence[name]).alias("confidence"))
        for name, weight in WEIGHTS.items()])
    return scores.select("cv_id", "job_id", "overall", report_label("band", F.col("band")).alias("band_label"), F.inline(parts))


def recommendation_report(scores: DataFrame) -> DataFrame:
    """C11: one row per pair and recommendation, ranked from 1 in the order of C8, with report labels. ``action`` and
    ``honesty_note`` are codes; only what is to be learnt is no part of the text yet and must not be claimed."""
    rows = scores.select("cv_id", "job_id", F.posexplode("recommendations").alias("rank", "r"))
    kind = report_label("kind", F.col("r.kind"))
    return rows.select(
        "cv_id", "job_id", (F.col("rank") + 1).alias("rank"), kind.alias("type"),
        F.when(F.col("r.term") == "", kind).otherwise(F.concat_ws(":", kind, "r.term")).alias("action"),
        F.col("r.component").alias("component"), F.col("r.gain").alias("estimated_gain"), F.lit(False).alias("invents"),
        F.when(F.col("r.kind") == "Learn", "not-held").otherwise("in-text").alias("honesty_note"))


def keyword_report(scores: DataFrame) -> DataFrame:
    """C11: one row per pair and keyword with report labels."""
    def tagged(name: str) -> Column:
        return F.transform(name, lambda k: F.struct(F.lit(name).alias("list"), k.alias("k")))

    rows = scores.select("cv_id", "job_id", F.inline(F.concat(*[tagged(n) for n in ("present", "partial", "missing")])))
    return rows.select(
        "cv_id", "job_id", "list", F.col("k.skill_id").alias("skill_id"),
        report_label("category", F.col("k.category")).alias("category"),
        report_label("section", F.col("k.section")).alias("section"),
        report_label("tier", F.col("k.tier")).alias("match_level"),
        report_label("placement", F.col("k.placement")).alias("location"),
        F.col("k.weight").alias("weight"), F.col("k.credit").alias("credit"), F.col("k.note").alias("note"))
