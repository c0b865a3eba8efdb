"""Inputs the generated tables stand in for, and SQL fragments shared by the checks.

Documents play CVs, benchmark passages play vacancies and also give the skill lexicon (their opening as canonical
name, two-word phrases and single words of the whole passage as aliases), so multi-word hits do occur in the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import PROTECTED_TOKENS, STEM_SUFFIXES
from ..sources.lexicon import Lexicon, lexicon_from_skills


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # The generated corpus is one file of one row group, which is one task. Adaptive execution deals it out by its size,
    # so that tasks become more, not larger, as it grows.
    return df.hint("rebalance", "doc_id") if name == "documents" else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows of a narrow table in even tasks: costly expressions follow, and its few bytes would make one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# Frequent words of the generated prose, used as section headers and verbs.
HEADERS = {
    "the": "experience", "and": "education", "of": "skills", "that": "summary", "it is": "summary",
    "in": "certifications", "with": "contact", "la": "experience", "de": "skills", "que": "education",
    "der": "skills", "die": "experience", "und": "education", "on": "other", "to": "languages",
}
VACANCY_HEADERS = {"the": "must", "that": "nice", "of": "resp", "in": "must", "it": "nice", "with": "resp"}
VERBS = ["with", "that", "for", "was", "have", "para", "pour", "nicht", "avec", "haver", "wases", "thating"]
LEXICON_VERSION = "bench-1"
CONFUSABLE = [("the", "then"), ("and", "hand"), ("thing", "thin")]


def skills_of_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    w = tx.tokens(F.col("folded"))
    items = tx.with_folded(table(spark, sf, "benchmark"), "text", "folded").select("item_id", w.alias("w"))

    def name(i) -> F.Column:
        return F.concat(F.lit("b"), i)

    def picked(i: int) -> F.Column:
        return F.get("w", F.lit(i))

    def each(first: int, last: F.Column, step: int, term) -> F.Column:
        places = F.when(last >= first, F.sequence(F.lit(first), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, term)

    item, n = F.col("item_id"), F.size("w")
    phrases = each(3, n - 2, 3, lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    return items.select(
        item.cast("int").alias("entry_ord"),
        name(item).alias("id"),
        F.when(item % 3 == 0, F.concat(picked(0), F.lit("s"))).otherwise(F.array_join(F.slice("w", 1, 3), " ")).alias("canonical"),
        F.element_at(F.array(F.lit("hardSkill"), F.lit("tool"), F.lit("softSkill"), F.lit("other")),
                     (item % 4 + 1).cast("int")).alias("category"),
        F.concat(phrases, each(8, n - 1, 16, lambda i: F.get("w", i))).alias("aliases"),
        F.array(name(item + 1)).alias("implies"),
        F.array(name(item + 2)).alias("related"),
        F.array(name(item + 5)).alias("broader"),
        F.array(name(item + 3)).alias("confusableWith"),
    )


def lexicon(spark: SparkSession, sf: str) -> Lexicon:
    skills = skills_of_benchmark(spark, sf)
    return lexicon_from_skills(skills, LEXICON_VERSION)


def cvs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("cv_id"), "text")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("job_id"), "text")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two applications per document, spread over all vacancies."""
    n = table(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    doc = F.col("doc_id")
    picks = F.array_distinct(F.array(doc % n, (doc * 7 + 3) % n))
    return table(spark, sf, "documents").select(doc.alias("cv_id"), F.explode(picks).alias("job_id"))


def sql_no_null(sql: str, *cols: str) -> str:
    """Nulls in numeric columns as -1, so both sides return plain integers."""
    return f"SELECT * REPLACE ({', '.join(f'coalesce({x}, -1) AS {x}' for x in cols)}) FROM ({sql})"


# --- SQL fragments --------------------------------------------------------------------------------


_MARKED = {".": 57344, "#": 57345, "+": 57346, "/": 57347, "-": 57348}
_BACK = "concat(" + ", ".join(f"chr({n})" for n in _MARKED.values()) + ")"
TOKEN_PATTERN = "[\\p{L}\\p{Nd}\\x{E000}-\\x{E004}]+"


def sql_fold(x: str) -> str:
    """Protected tokens are marked first, as accents decide what is one; ñ is guarded against accent stripping."""
    out = f"lower(nfc_normalize({x}))"
    for token in PROTECTED_TOKENS:
        parts = [f"chr({_MARKED[ch]})" if ch in _MARKED else f"'{ch}'" for ch in token]
        out = f"replace({out}, '{token}', concat({', '.join(parts)}))"
    return f"replace(strip_accents(replace({out}, 'ñ', chr(57360))), chr(57360), 'ñ')"


def sql_words(x: str) -> str:
    return f"list_transform(regexp_extract_all({sql_fold(x)}, '{TOKEN_PATTERN}'), lambda t0: translate(t0, {_BACK}, '.#+/-'))"


def sql_norm(x: str) -> str:
    return f"array_to_string({sql_words(x)}, ' ')"


def sql_stem(x: str) -> str:
    suffixes = "|".join(sorted(STEM_SUFFIXES, key=len, reverse=True))
    return f"regexp_replace({x}, '^(.{{3,}}?)(?:{suffixes})$', '\\1')"


def sql_quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_header(words: str, norm: str, headers: dict[str, str]) -> str:
    keys = sorted(headers, key=lambda k: (-len(k), k))
    cases = " ".join(
        f"WHEN {norm} = '{k}' OR starts_with({norm}, '{k} ') THEN '{headers[k]}'" for k in keys)
    return f"CASE WHEN len({words}) NOT BETWEEN 1 AND 5 THEN NULL {cases} END"


def sql_sections(source: str, key: str, headers: dict[str, str], preamble: str, tag: str = "") -> str:
    """CTEs ``lines`` and ``sects``: one row per line with label and section number, plus one row 0."""
    return f"""
    lines{tag} AS (
      SELECT {key}, i, l[i] AS line, w, array_to_string(w, ' ') AS norm FROM (
        SELECT *, {sql_words('l[i]')} AS w FROM (
          SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {source})))),
    labelled{tag} AS (SELECT *, {sql_header('w', 'norm', headers)} AS head FROM lines{tag}),
    numbered{tag} AS (
      SELECT *, CAST(sum(CASE WHEN head IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS INTEGER) AS ord
      FROM labelled{tag}
      UNION ALL SELECT {key}, 0, '', [], '', NULL, 0 FROM {source}),
    sects{tag} AS (
      SELECT {key}, ord, coalesce(max(head), '{preamble}') AS label,
        regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE head IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS body,
        coalesce(flatten(list(w ORDER BY i) FILTER (WHERE head IS NULL)), []) AS words
      FROM numbered{tag} GROUP BY {key}, ord)"""


SQL_SKILLS = f"""
    skills AS (
      SELECT item_id AS entry_ord, 'b' || item_id AS skill_id, CASE WHEN item_id % 3 = 0 THEN w[1] || 's' ELSE array_to_string(w[1:3], ' ') END AS canonical,
        ['hard', 'tool', 'soft', 'generic'][item_id % 4 + 1] AS category,
        list_concat(list_transform(range(4, len(w), 3), lambda i: w[i] || ' ' || w[i + 1]),
          list_transform(range(9, len(w) + 1, 16), lambda i: w[i])) AS aliases,
        'b' || (item_id + 1) AS implies, 'b' || (item_id + 2) AS related, 'b' || (item_id + 3) AS confusable
      FROM (SELECT item_id, {sql_words('text')} AS w FROM benchmark)),
    names AS (
      SELECT entry_ord, skill_id, 0 AS alias_ord, canonical AS name FROM skills
      UNION ALL SELECT entry_ord, skill_id, i, aliases[i] FROM (
        SELECT *, unnest(range(1, len(aliases) + 1)) AS i FROM skills)),
    lex AS (
      SELECT term, skill_id FROM (
        SELECT {sql_norm('name')} AS term, skill_id,
          row_number() OVER (PARTITION BY {sql_norm('name')} ORDER BY entry_ord, alias_ord) AS rn FROM names)
      WHERE rn = 1 AND term <> '')"""

SQL_PATTERN = """
    pattern AS (
      SELECT ' (' || string_agg(regexp_escape(replace(term, ' ', '  ')), '|'
        ORDER BY len(string_split(term, ' ')) DESC, term) || ') ' AS p FROM lex WHERE len(string_split(term, ' ')) <= 3)"""


def sql_hits(key: str, sects: str, out: str) -> str:
    """CTE of lexicon hits in reading order; each word is padded by two blanks so neighbours do not share one."""
    return f"""
    {out}_raw AS (
      SELECT {key}, ord, label,
        regexp_extract_all(' ' || array_to_string(words, '  ') || ' ', (SELECT p FROM pattern), 1) AS h FROM {sects}),
    {out} AS (
      SELECT {key}, ord, label, idx, skill_id FROM (
        SELECT {key}, ord, label, i AS idx, replace(h[i], '  ', ' ') AS term FROM (
          SELECT *, unnest(range(1, len(h) + 1)) AS i FROM {out}_raw)) JOIN lex USING (term))"""


SQL_PLACEMENT = """
    placed AS (
      SELECT cv_id, skill_id, CASE WHEN bool_or(label IN ('skills', 'summary', 'certifications', 'header'))
        THEN 'Prominent' ELSE 'Buried' END AS placement, count(*) AS n, min(ord * 1000000 + idx) AS first_at
      FROM cv_hits GROUP BY cv_id, skill_id)"""

SQL_REQUIREMENTS = """
    job_best AS (
      SELECT job_id, skill_id, count(*) AS n,
        arg_max(label, CASE label WHEN 'must' THEN 1.2 WHEN 'title' THEN 1.1 WHEN 'resp' THEN 1.0 ELSE 0.6 END) AS section
      FROM job_hits GROUP BY job_id, skill_id),
    reqs AS (
      SELECT job_id, skill_id, canonical AS display, category, section, n,
        least(greatest(
          (CASE category WHEN 'hard' THEN 1.0::DOUBLE WHEN 'tool' THEN 0.9::DOUBLE WHEN 'soft' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END)
          * (CASE section WHEN 'must' THEN 1.2::DOUBLE WHEN 'title' THEN 1.1::DOUBLE WHEN 'resp' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END)
          * least(1.3::DOUBLE, 1.0::DOUBLE + 0.1::DOUBLE * (n - 1)), 0.2::DOUBLE), 2.0::DOUBLE) AS weight
      FROM job_best JOIN skills USING (skill_id))"""

SQL_CVS = "cvs AS (SELECT doc_id AS cv_id, text FROM documents)"
SQL_JOBS = "jobs AS (SELECT item_id AS job_id, text FROM benchmark)"
SQL_PAIRS = """
    pairs AS (
      SELECT DISTINCT doc_id AS cv_id, unnest([doc_id % n, (doc_id * 7 + 3) % n]) AS job_id
      FROM documents, (SELECT count(*) AS n FROM benchmark))"""


def sql_jaro_winkler(pairs: str, threshold: float) -> str:
    """CTEs ending in ``alike(a, b, score)`` for ``pairs(a, b, s, t)``, where ``s`` and ``t`` are in one byte a character;
    the statement must be RECURSIVE. The built-in function rounds half transpositions down, so it only bounds the score."""
    same = [f"least(length(s), length(t)) >= {k} AND left(s, {k}) = left(t, {k})" for k in range(1, 5)]
    prefix = " + ".join(f"CAST({x} AS INTEGER)" for x in same)
    return f"""
    near AS (SELECT *, greatest(0, greatest(length(s), length(t)) // 2 - 1) AS r FROM {pairs}
      WHERE s <> '' AND t <> '' AND jaro_winkler_similarity(s, t) >= {threshold} - 1e-6),
    walked AS (
      SELECT a, b, s, t, r, CAST(1 AS BIGINT) AS i, t AS u, '' AS l FROM near
      UNION ALL SELECT a, b, s, t, r, i + 1, CASE WHEN k > 0 THEN left(u, lo + k - 2) || chr(1) || substr(u, lo + k) ELSE u END,
        CASE WHEN k > 0 THEN l || substr(s, i, 1) ELSE l END
      FROM (SELECT *, instr(substr(u, lo, i + r - lo + 1), substr(s, i, 1)) AS k FROM (
        SELECT *, greatest(1, i - r) AS lo FROM walked WHERE i <= length(s)))),
    common AS (SELECT a, b, s, t, l, length(l) AS m,
      list_filter(range(1, length(t) + 1), lambda x: substr(u, x, 1) = chr(1)) AS places FROM walked WHERE i = length(s) + 1 AND l <> ''),
    jaro AS (SELECT a, b, {prefix} AS p, (m / length(s)::DOUBLE + m / length(t)::DOUBLE
      + (m - 0.5::DOUBLE * len(list_filter(range(1, m + 1), lambda x: substr(l, x, 1) <> substr(t, places[x], 1)))) / m::DOUBLE) / 3::DOUBLE AS j FROM common),
    alike AS (SELECT * FROM (SELECT a, b, j + p * 0.1::DOUBLE * (1 - j) AS score FROM jaro) WHERE score >= {threshold})"""
