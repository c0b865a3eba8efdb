"""Similarity join of vocabularies without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import PACKS, jaro_winkler, packed, pairs_of_packs, segment_udfs


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """Even tasks for the costly functions below: their input is small in bytes, so it would be coalesced. Dealt out by
    a hash of its own, as a shuffle by columns that rows already follow is left out."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols))


def _jaro_winkler_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Words travel in packs of thousands. Every pack of ``left``, the small side, meets every pack of ``right``: lengths
    and signatures rule out nearly all pairs at some nanoseconds each, with no row per word and key. Those left are scored
    once each, in even tasks."""
    few = left.mapInArrow(packed, PACKS)
    many = _spread(right, "b").mapInArrow(packed, PACKS)
    both = many.select(F.col("words").alias("_w"), F.col("bits").alias("_b")).crossJoin(few).select("words", "bits", "_w", "_b")
    pairs = _spread(both.mapInArrow(pairs_of_packs(threshold), "a string, b string"), "a", "b")
    return tx.evaluated(pairs.withColumn("score", jaro_winkler("a", "b")), "a", "b", "score").filter(F.col("score") >= threshold)


def _levenshtein_pairs(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Segment keys: a word cut in ``distance + 1`` parts keeps one part unchanged, shifted by at most
    ``distance``, in every word within that distance. Words too short to cut meet on their length only."""
    cut, probe = segment_udfs(distance)
    lk = left.select("a", F.explode(cut("a")).alias("k"))
    rk = _spread(right, "b").select("b", F.explode(probe("b")).alias("k"))
    pairs = rk.join(lk, "k").select("a", "b").distinct()
    return pairs.withColumn("score", F.levenshtein("a", "b")).filter(F.col("score") <= distance)


def similar_terms(left: DataFrame, right: DataFrame, metric: str, threshold: float,
                  left_col: str = "token", right_col: str = "token") -> DataFrame:
    """``(a, b, score)`` of all word pairs within the threshold.

    ``jaro_winkler``: score >= threshold; candidates are pairs that a bound on signatures lets through. ``levenshtein``:
    distance <= threshold; candidates come from equi-joins on keys that no qualifying pair can miss.
    """
    a = left.select(F.col(left_col).alias("a")).filter("a is not null and a <> ''").distinct()
    b = right.select(F.col(right_col).alias("b")).filter("b is not null and b <> ''").distinct()
    if metric == "jaro_winkler":
        return _jaro_winkler_pairs(a, b, threshold)
    if metric == "levenshtein":
        return _levenshtein_pairs(a, b, int(threshold))
    raise ValueError(f"unknown metric {metric!r}")
