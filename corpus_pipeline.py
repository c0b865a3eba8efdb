"""From raw documents to token ids, in five stages. Each works on all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``. Null
and empty texts, repeated rows, empty tables and further columns are treated as the operator of the stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import byte_bpe, decontamination, language_id, line_dedup, simhash
from matchloom.llm.shared import read, stored

#: Score below which a language is not believed. Scores compare languages and hardly fall below it; texts in none of
#: them are known by the share of their n-grams that no landmark has.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that look like no learnt language, go."""
    scored = language_id.predict(docs, language_id.fit(docs, language_id.learnable()), reject=True)
    sure = (F.col("lang_pred") != language_id.NONE) & (F.col("score") >= LEAST_SCORE)
    return scored.filter(sure).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated and similar lines the first stays; a document that has none left is a copy of others and goes."""
    done = line_dedup.dedup_lines(docs).filter((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, with all rows of that id; rows without
    an id stay."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_documents(decontamination.find_hits(docs, read(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of what is left, and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash", dedup_documents),
    ("decontamination", decontaminate), ("byte_bpe", encode),
]

#: The kernel regression of the first stage is not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
