"""Match cascade (M1-M7).

Tiers by rank: exact, implied, related, stem, fuzzy, none. The batch driver gathers all evidence of a CV
into one row and reads it per pair, so a pair costs one lookup row and no per-requirement shuffle. The
single tiers are also available as joins over open requirements ``(cv_id, job_id, skill_id, display)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import FUZZY_THRESHOLD
from ..sources.scratch import stored
from .similar import similar_terms

TIERS = ["Exact", "Alias", "Related", "Lemma", "Fuzzy", "None"]
_KEY = ["cv_id", "job_id", "skill_id"]


def location_factor(placement: Column) -> Column:
    return F.when(placement == "Prominent", 1.0).when(placement == "Buried", 0.6).otherwise(0.0)


def _credit(tier_credit: Column, placement: Column) -> Column:
    return F.least(F.greatest(tier_credit * location_factor(placement), F.lit(0.0)), F.lit(1.0))


def _tier(df: DataFrame, tier: str, placement: Column, tier_credit: Column) -> DataFrame:
    return df.select(*_KEY, F.lit(tier).alias("tier"), placement.alias("placement"),
                     _credit(tier_credit, placement).alias("credit"))


def match_exact(open_req: DataFrame, placement: DataFrame) -> DataFrame:
    """M1."""
    hit = open_req.join(placement.select("cv_id", "skill_id", "placement"), ["cv_id", "skill_id"])
    return _tier(hit, "Exact", F.col("placement"), F.lit(1.0))


def _witness(open_req: DataFrame, placement: DataFrame, edges: DataFrame, tier: str, credit: float) -> DataFrame:
    reach = placement.join(edges, F.col("skill_id") == F.col("have")).select(
        "cv_id", F.col("want").alias("skill_id"), F.struct("first_ord", "first_pos", "placement").alias("w"))
    first = reach.groupBy("cv_id", "skill_id").agg(F.min("w").alias("w"))
    hit = open_req.join(first, ["cv_id", "skill_id"])
    return _tier(hit, tier, F.col("w.placement"), F.lit(credit))


def match_implied(open_req: DataFrame, placement: DataFrame, implied: DataFrame) -> DataFrame:
    """M2: an owned skill implies the requirement; the first one in document order is the witness."""
    return _witness(open_req, placement, implied, "Alias", 1.0)


def match_related(open_req: DataFrame, placement: DataFrame, related: DataFrame) -> DataFrame:
    """M3."""
    return _witness(open_req, placement, related, "Related", 0.5)


def requirement_terms(requirements: DataFrame) -> DataFrame:
    """Distinct ``(skill_id, term, term_stem)`` of requirement displays."""
    names = requirements.select("skill_id", "display").distinct()
    folded = tx.with_folded(names, "display", "_f")
    return folded.select("skill_id", tx.normalized(F.col("_f")).alias("term")).withColumn("term_stem", tx.stem(F.col("term")))


def lemma_words(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(skill_id, token)``: words whose stem is the stem of the requirement term."""
    stems = vocabulary.select("token", tx.stem(F.col("token")).alias("term_stem"))
    return stems.join(terms.filter("term_stem <> ''"), "term_stem").select("skill_id", "token")


def fuzzy_words(terms: DataFrame, vocabulary: DataFrame, edges: dict[str, DataFrame],
                threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """``(skill_id, token, score)``: similar words, confusable pairs excluded by anti joins."""
    near = similar_terms(terms, vocabulary, "jaro_winkler", threshold, left_col="term")
    named = near.join(terms.select("skill_id", "term"), near["a"] == F.col("term"))
    named = named.select("skill_id", "term", F.col("b").alias("token"), "score")
    by_term = named.select("*", F.least("term", "token").alias("a"), F.greatest("term", "token").alias("b"))
    by_term = by_term.join(edges["confusable_terms"], ["a", "b"], "left_anti").drop("a", "b")
    by_id = by_term.select("*", F.least("skill_id", "token").alias("a"), F.greatest("skill_id", "token").alias("b"))
    return by_id.join(edges["confusable"], ["a", "b"], "left_anti").select("skill_id", "token", "score")


def match_stem(open_req: DataFrame, stems: DataFrame) -> DataFrame:
    """M4: ``stems(cv_id, stem)`` holds the stem of the requirement's normalised display."""
    terms = requirement_terms(open_req).select("skill_id", F.col("term_stem").alias("stem")).filter("stem <> ''")
    keyed = open_req.join(terms, "skill_id")
    hit = keyed.join(stems.select("cv_id", "stem"), ["cv_id", "stem"], "left_semi")
    return _tier(hit, "Lemma", F.lit("Buried"), F.lit(0.85))


def match_fuzzy(open_req: DataFrame, tokens: DataFrame, edges: dict[str, DataFrame],
                threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """M5: best similar word of ``tokens(cv_id, token)``. The words that are near a requirement are stored first, as in
    :func:`evidence`."""
    vocabulary = stored(tokens.select("token").distinct(), "vocabulary")
    near = stored(fuzzy_words(requirement_terms(open_req), vocabulary, edges, threshold), "near-words")
    held = tokens.join(near, "token").groupBy("cv_id", "skill_id").agg(F.max("score").alias("score"))
    hit = open_req.join(held, ["cv_id", "skill_id"])
    return _tier(hit, "Fuzzy", F.lit("Buried"), F.lit(0.85) * F.col("score"))


def resolve_cascade(open_req: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """M6: the first tier in :data:`TIERS` order decides; requirements without evidence get ``None``."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    union = tiers[0]
    for tier in tiers[1:]:
        union = union.unionByName(tier)
    best = union.groupBy(*_KEY).agg(F.min_by(F.struct("tier", "placement", "credit"), rank).alias("m"))
    return open_req.join(best, _KEY, "left").select(
        *open_req.columns,
        F.coalesce("m.tier", F.lit("None")).alias("tier"),
        F.coalesce("m.placement", F.lit("NotFound")).alias("placement"),
        F.coalesce("m.credit", F.lit(0.0)).alias("credit"))


def open_requirements(pairs: DataFrame, requirements: DataFrame) -> DataFrame:
    return pairs.select("cv_id", "job_id").join(requirements, "job_id")


# --- M7 -------------------------------------------------------------------------------------------


def evidence(placement: DataFrame, edges: dict[str, DataFrame], cv_words: DataFrame | None = None,
             requirements: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """All evidence a CV holds, independent of pairs: ``(cv_id, skills map<skill_id, (tier, placement, credit)>)``.

    ``cv_words(cv_id, words array)`` with ``requirements`` adds the stem and fuzzy tiers; similarity is
    computed once per vocabulary word, never per CV. The words that are near a requirement are stored first, so that
    the join with the words of all CVs is planned by their true size: unless they are very many, no CV word is
    shuffled or sorted, and a word that most CVs hold does not gather in one task.
    """
    at = F.struct("first_ord", "first_pos")
    own = placement.select("cv_id", "skill_id", F.lit(0).alias("rank"), at.alias("at"), F.lit(0.0).alias("neg_score"), "placement")

    def through(table: DataFrame, rank: int) -> DataFrame:
        return placement.join(table, placement["skill_id"] == table["have"]).select(
            "cv_id", F.col("want").alias("skill_id"), F.lit(rank).alias("rank"), at.alias("at"),
            F.lit(0.0).alias("neg_score"), "placement")

    rows = own.unionByName(through(edges["implied"], 1)).unionByName(through(edges["related"], 2))
    if cv_words is not None and requirements is not None:
        terms = requirement_terms(requirements)
        vocabulary = cv_words.select(F.explode("words").alias("token")).distinct()
        if fuzzy:  # read twice, and to find it takes all words of all CVs
            vocabulary = stored(vocabulary, "vocabulary")
        near = lemma_words(terms, vocabulary).select("skill_id", "token", F.lit(3).alias("rank"), F.lit(0.0).alias("neg_score"))
        if fuzzy:
            close = fuzzy_words(terms, vocabulary, edges)
            near = near.unionByName(close.select(
                "skill_id", "token", F.lit(4).alias("rank"), (-F.col("score")).alias("neg_score")))
        near = stored(near, "near-words")
        held = cv_words.select("cv_id", F.explode(F.array_distinct("words")).alias("token")).join(
            near, "token")
        rows = rows.unionByName(held.select(
            "cv_id", "skill_id", "rank",
            F.lit(None).cast("struct<first_ord:int,first_pos:int>").alias("at"), "neg_score", F.lit("Buried").alias("placement")))
    best = rows.groupBy("cv_id", "skill_id").agg(F.min(F.struct("rank", "at", "neg_score", "placement")).alias("e"))
    tier_credit = (F.when(F.col("e.rank") <= 1, 1.0).when(F.col("e.rank") == 2, 0.5)
                   .when(F.col("e.rank") == 3, 0.85).otherwise(-0.85 * F.col("e.neg_score")))
    entry = F.struct(
        "skill_id",
        F.struct(
            F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("e.rank") + 1).alias("tier"),
            F.col("e.placement").alias("placement"),
            _credit(tier_credit, F.col("e.placement")).alias("credit")).alias("m"))
    return best.groupBy("cv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("skills"))


def match_pairs(pairs: DataFrame, cv_evidence: DataFrame, requirement_sets: DataFrame) -> DataFrame:
    """M7: one row per pair with ``matches`` (array in requirement order) and ``context_hash``.

    Pairs of one vacancy may be a large part of all pairs: the requirement side is one row per vacancy and is
    broadcast where its size allows, else adaptive execution splits the hot vacancy.
    """
    joined = pairs.select("cv_id", "job_id").join(cv_evidence, "cv_id", "left").join(
        requirement_sets, "job_id", "left")

    def resolve(r: Column) -> Column:
        m = F.try_element_at(F.col("skills"), r["skill_id"])
        return F.struct(
            r["skill_id"].alias("skill_id"), r["display"].alias("display"), r["category"].alias("category"),
            r["section"].alias("section"), r["weight"].alias("weight"),
            F.coalesce(m["tier"], F.lit("None")).alias("tier"),
            F.coalesce(m["placement"], F.lit("NotFound")).alias("placement"),
            F.coalesce(m["credit"], F.lit(0.0)).alias("credit"))

    empty = F.array().cast(
        "array<struct<skill_id:string,display:string,category:string,section:string,weight:double,"
        "tier:string,placement:string,credit:double>>")
    return joined.select(
        "cv_id", "job_id",
        F.coalesce(F.transform("reqs", resolve), empty).alias("matches"),
        F.coalesce("context_hash", F.sha2(F.lit("").cast("binary"), 256)).alias("context_hash"))


def match_rows(matched: DataFrame) -> DataFrame:
    """Long form of :func:`match_pairs`."""
    return matched.select("cv_id", "job_id", F.inline("matches"))


def best_documents(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents per vacancy; ranks are limited before the shuffle."""
    order = Window.partitionBy("job_id").orderBy(F.col("overall").desc(), "cv_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
