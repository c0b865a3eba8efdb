"""Lexicon index, n-gram scan and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import CONFUSABLE_TERMS, MAX_GRAM, PROMINENT_SECTIONS
from ..sources.lexicon import Lexicon
from .text import with_sections


def lexicon_index(lexicon: Lexicon) -> DataFrame:
    """L1: ``(term, skill_id)``: normalised canonical names and aliases, first entry wins."""
    names = lexicon.entries.select("entry_ord", "skill_id", F.lit(-1).alias("alias_ord"), F.col("canonical").alias("name"))
    names = names.unionByName(lexicon.aliases.withColumnRenamed("alias", "name"))
    norm = tx.with_folded(names, "name", "_folded").withColumn("term", tx.normalized(F.col("_folded")))
    first = F.min_by("skill_id", F.struct("entry_ord", "alias_ord"))
    return norm.filter(F.col("term") != "").groupBy("term").agg(first.alias("skill_id"))


def _grams_of(index: DataFrame) -> DataFrame:
    w = F.split("term", " ")
    return index.filter(F.size(w) <= MAX_GRAM).select(
        w[0].alias("i1"), F.get(w, F.lit(1)).alias("i2"), F.get(w, F.lit(2)).alias("i3"),
        F.size(w).alias("n"), "skill_id")


def scan_occurrences(sections: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Greedy longest n-gram occurrences ``(key, ord, label, pos, skill_id)``.

    ``sections`` has ``(key, ord, label, folded)``. All n-grams are looked up by one join on their first
    word, which is a broadcast for a lexicon of ordinary size; only the hits are shuffled, once, by document, and overlaps are dropped in position order.
    """
    w = tx.tokens(F.col("folded"))
    work = sections.select(key, "ord", "label", w.alias("_w"))
    work = work.withColumns({"_w2": F.slice("_w", 2, F.size("_w")), "_w3": F.slice("_w", 3, F.size("_w"))})
    grams = work.select(key, "ord", "label", F.posexplode(F.arrays_zip("_w", "_w2", "_w3")).alias("pos", "g"))
    grams = grams.select(key, "ord", "label", "pos", "g._w", "g._w2", "g._w3")
    dim = _grams_of(index)
    on = (
        (F.col("_w") == F.col("i1"))
        & ((F.col("n") < 2) | (F.col("_w2") == F.col("i2")))
        & ((F.col("n") < 3) | (F.col("_w3") == F.col("i3")))
    )
    hits = grams.join(dim, on).select(
        key, F.struct("ord", "pos", (-F.col("n")).alias("neg_n"), "label", "skill_id").alias("h"))
    ordered = hits.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    # The fold only marks hits, in a string, so it stays linear for documents with very many of them.
    marks = F.aggregate(
        "hs",
        F.struct(F.lit(-1).alias("ord"), F.lit(0).alias("free"), F.lit("").alias("marks")),
        lambda acc, h: F.when(
            (h["ord"] != acc["ord"]) | (h["pos"] >= acc["free"]),
            F.struct(h["ord"].alias("ord"), (h["pos"] - h["neg_n"]).alias("free"), F.concat(acc["marks"], F.lit("1")).alias("marks")),
        ).otherwise(F.struct(acc["ord"].alias("ord"), acc["free"].alias("free"), F.concat(acc["marks"], F.lit("0")).alias("marks"))),
        lambda acc: acc["marks"],
    )
    rows = F.zip_with("hs", F.split(marks, ""), lambda h, m: F.when(m == "1", F.struct(
        h["ord"].alias("ord"), h["label"].alias("label"), h["pos"].alias("pos"), h["skill_id"].alias("skill_id"))))
    return ordered.select(key, F.inline(F.array_compact(rows)))


def scan_skills(sections: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """L2: ``(key, ord, label, skill_id, n, first_pos)``."""
    return scan_occurrences(sections, index, key).groupBy(key, "ord", "label", "skill_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def skill_placement(scans: DataFrame, key: str = "doc_id", prominent: list[str] | None = None) -> DataFrame:
    """L3: ``(key, skill_id, placement, n, first_ord, first_pos)``. Prominent when any occurrence is."""
    prominent = prominent or PROMINENT_SECTIONS
    where = F.min(F.struct("ord", "first_pos"))
    return scans.groupBy(key, "skill_id").agg(
        F.when(F.bool_or(F.col("label").isin(prominent)), "Prominent").otherwise("Buried").alias("placement"),
        F.sum("n").alias("n"), where.alias("_at"),
    ).select(key, "skill_id", "placement", "n", F.col("_at.ord").alias("first_ord"), F.col("_at.first_pos").alias("first_pos"))


def max_repetition(placement: DataFrame, key: str = "doc_id") -> DataFrame:
    """L3: largest count of one skill per document (documents without skill are absent: 0)."""
    return placement.groupBy(key).agg(F.max("n").alias("max_repetition"))


def lexicon_edges(lexicon: Lexicon, extra_pairs: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """L4: edge tables.

    ``implied(have, want)`` full credit, ``related(have, want)`` partial credit (related either way or the
    wanted skill implies the owned one), ``confusable(a, b)`` symmetric pairs with ``a < b`` of lexicon ids
    and ``confusable_terms(a, b)`` of normalised terms.
    """
    implied = lexicon.implies.select(F.col("src").alias("have"), F.col("dst").alias("want"))
    related = (
        lexicon.related.select(F.col("src").alias("have"), F.col("dst").alias("want"))
        .unionByName(lexicon.related.select(F.col("dst").alias("have"), F.col("src").alias("want")))
        .unionByName(lexicon.implies.select(F.col("dst").alias("have"), F.col("src").alias("want")))
        .distinct()
    )

    def pairs(df: DataFrame) -> DataFrame:
        return df.filter(F.col("src") != F.col("dst")).select(
            F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    spark = lexicon.entries.sparkSession
    terms = spark.createDataFrame(extra_pairs if extra_pairs is not None else CONFUSABLE_TERMS, "src string, dst string")
    clean = terms.select(F.lower(F.trim("src")).alias("src"), F.lower(F.trim("dst")).alias("dst"))
    return {"implied": implied, "related": related, "confusable": pairs(lexicon.confusable),
            "confusable_terms": pairs(clean)}


def sections_present(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sorted distinct section labels per document, without the preamble."""
    real = F.when(~F.col("label").isin("header", "other"), F.col("label"))
    return sections.groupBy(key).agg(F.array_sort(F.collect_set(real)).alias("sections_present"))


def sections_of(docs: DataFrame, headers: dict[str, str], preamble: str, key: str, col: str = "text",
                unicode: str = "exact") -> DataFrame:
    """Sections of a document table in the form the scan reads."""
    folded = tx.with_folded(docs.select(key, col), col, "folded", unicode)
    cut = with_sections(folded, headers, preamble, col)
    return cut.select(key, F.explode("sections").alias("s")).select(key, "s.ord", "s.label", "s.folded")
