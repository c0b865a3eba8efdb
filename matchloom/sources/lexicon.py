"""The versioned skill lexicon as a dimension table plus edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = {"hardSkill": "hard", "tool": "tool", "softSkill": "soft"}

SKILL_SCHEMA = (
    "id string, canonical string, category string, aliases array<string>, implies array<string>, "
    "related array<string>, broader array<string>, confusableWith array<string>"
)


@dataclass(frozen=True)
class Lexicon:
    """``entries(entry_ord, skill_id, canonical, category)``, ``aliases(entry_ord, skill_id, alias_ord, alias)``
    and edges ``(src, dst)``."""

    version: str
    entries: DataFrame
    aliases: DataFrame
    implies: DataFrame
    related: DataFrame
    broader: DataFrame
    confusable: DataFrame


def lexicon_from_skills(skills: DataFrame, version: str) -> Lexicon:
    """Build the tables from nested skills ``(entry_ord, id, canonical, category, aliases, implies, ...)``."""
    mapped = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    category = F.coalesce(mapped[F.col("category")], F.lit("generic"))

    def edges(col: str) -> DataFrame:
        return skills.select(F.col("id").alias("src"), F.explode(col).alias("dst")).distinct()

    return Lexicon(
        version=version,
        entries=skills.select("entry_ord", F.col("id").alias("skill_id"), "canonical", category.alias("category")),
        aliases=skills.select("entry_ord", F.col("id").alias("skill_id"), F.posexplode("aliases"))
        .select("entry_ord", "skill_id", F.col("pos").alias("alias_ord"), F.col("col").alias("alias")),
        implies=edges("implies"),
        related=edges("related"),
        broader=edges("broader"),
        confusable=edges("confusableWith"),
    )


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """Read one JSON document ``{version, skills: [...]}``; other keys are ignored, missing lists are empty."""
    doc = spark.read.schema(f"version string, skills array<struct<{SKILL_SCHEMA}>>").json(path, multiLine=True)
    head = doc.select("version").first()
    if head is None or not (head["version"] or "").strip():
        raise ValueError(f"lexicon at {path} has no version")
    skills = doc.select(F.posexplode("skills").alias("entry_ord", "s")).select("entry_ord", "s.*")
    return lexicon_from_skills(skills, head["version"])
