"""Vacancy requirements (V1, V2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import CATEGORY_BASE, JOB_HEADERS, SECTION_MULTIPLIER
from ..sources.lexicon import Lexicon
from .lexicon import lexicon_index, scan_occurrences, sections_of


def _lookup(col: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(col == name, F.lit(value)).otherwise(out)
    return out


def requirement_weight(category: Column, section: Column, n: Column) -> Column:
    frequency = F.least(F.lit(1.3), F.lit(1.0) + F.lit(0.1) * (n - 1))
    raw = _lookup(category, CATEGORY_BASE, 0.5) * _lookup(section, SECTION_MULTIPLIER, 0.6) * frequency
    return F.least(F.greatest(raw, F.lit(0.2)), F.lit(2.0))


def extract_requirements(jobs: DataFrame, lexicon: Lexicon, headers: dict[str, str] | None = None,
                         key: str = "job_id", col: str = "text", unicode: str = "exact",
                         index: DataFrame | None = None) -> DataFrame:
    """V1: ``(key, skill_id, display, category, section, n, weight)``, the best section of each skill counting."""
    sections = sections_of(jobs, headers or JOB_HEADERS, "title", key, col, unicode)
    hits = scan_occurrences(sections, lexicon_index(lexicon) if index is None else index, key)
    rank = _lookup(F.col("label"), SECTION_MULTIPLIER, 0.6)
    best = hits.groupBy(key, "skill_id").agg(F.max_by("label", rank).alias("section"), F.count(F.lit(1)).alias("n"))
    names = lexicon.entries.select("skill_id", F.col("canonical").alias("display"), "category")
    return best.join(names, "skill_id").select(
        key, "skill_id", "display", "category", "section", "n",
        requirement_weight(F.col("category"), F.col("section"), F.col("n")).alias("weight"))


# The hash text names sections by these labels (fixed values).
SECTION_NAMES = {"must": "MustHave", "title": "Title", "resp": "Responsibility", "nice": "NiceToHave"}


def requirement_sets(requirements: DataFrame, key: str = "job_id") -> DataFrame:
    """One row per job: requirements ordered by weight (largest first) and id, and the context hash (V2).

    The hash covers ``id:weight:section`` in id order with two decimals and a point as decimal mark.
    """
    names = F.create_map(*[F.lit(x) for pair in SECTION_NAMES.items() for x in pair])
    item = F.struct((-F.col("weight")).alias("neg_weight"), "skill_id", "display", "category", "section", "weight")
    line = F.concat_ws(":", "skill_id", F.format_string("%.2f", "weight"), names[F.col("section")])
    return requirements.groupBy(key).agg(
        F.sort_array(F.collect_list(item)).alias("reqs"),
        F.sort_array(F.collect_list(F.struct("skill_id", line.alias("line")))).alias("_lines"),
    ).select(
        key,
        F.transform("reqs", lambda r: F.struct(
            r["skill_id"].alias("skill_id"), r["display"].alias("display"), r["category"].alias("category"),
            r["section"].alias("section"), r["weight"].alias("weight"))).alias("reqs"),
        F.sha2(F.array_join(F.transform("_lines", lambda x: x["line"]), "|"), 256).alias("context_hash"))


def context_hash(requirements: DataFrame, key: str = "job_id") -> DataFrame:
    """V2: ``(key, context_hash)``; jobs without any requirement are absent, their hash is that of the empty text."""
    return requirement_sets(requirements, key).select(key, "context_hash")
