"""Corpus operators over a document table.

Everything that belongs to one document is computed inside its row with array expressions, so splitting,
signals, redaction and validation add no shuffle to a corpus scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import (
    ACTION_VERBS,
    CV_HEADERS,
    IMPORT_HEADERS,
    INJECTION_PATTERNS,
    MAX_HEADER_WORDS,
    STEM_SUFFIXES,
)

# --- T1-T3: words ---------------------------------------------------------------------------------


def normalize_corpus(df: DataFrame, col: str = "text", out: str = "norm", unicode: str = "exact") -> DataFrame:
    """Add the normal form of a text column."""
    folded = tx.with_folded(df, col, "_folded", unicode)
    return folded.withColumn(out, tx.normalized(F.col("_folded"))).drop("_folded")


def tokenize_corpus(df: DataFrame, key: str = "doc_id", col: str = "text", unicode: str = "exact") -> DataFrame:
    """One row per word occurrence, ``(key, pos, token)`` with positions from 0."""
    folded = tx.with_folded(df.select(key, col), col, "_folded", unicode)
    return folded.select(key, F.posexplode(tx.tokens(F.col("_folded"))).alias("pos", "token"))


def vocabulary(df: DataFrame, key: str = "doc_id", col: str = "text", unicode: str = "exact") -> DataFrame:
    """``(token, tf, df)``. Distinct words are found inside the row, so both counts are plain sums that
    combine before the one shuffle, and a word in every document is no hot key."""
    folded = tx.with_folded(df.select(key, col), col, "_folded", unicode)
    seen = folded.select(tx.tokens(F.col("_folded")).alias("_w"))
    one, zero = F.lit(1), F.lit(0)
    entries = F.concat(
        F.transform("_w", lambda w: F.struct(w.alias("token"), one.alias("tf"), zero.alias("df"))),
        F.transform(F.array_distinct("_w"), lambda w: F.struct(w.alias("token"), zero.alias("tf"), one.alias("df"))),
    )
    counted = seen.select(F.inline(entries))
    return counted.groupBy("token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def stem_vocabulary(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Distinct words with their stem."""
    return tokens.select(col).distinct().withColumn("stem", tx.stem(F.col(col)))


# --- T4, T5: sections -----------------------------------------------------------------------------


def header_label(norm: Column, headers: dict[str, str]) -> Column:
    """Label of a normalised line when it is a header, else null; longest keyword first."""
    keys = sorted(headers, key=lambda k: (-len(k), k))
    pattern = "^(" + tx.any_of(keys) + r")(?: |\z)"
    labels = F.create_map(*[F.lit(x) for key in keys for x in (key, headers[key])])
    long = "^(?:[^ ]+ ){" + str(MAX_HEADER_WORDS) + "}"
    return tx.let(norm, lambda n: F.when(~n.rlike(long), F.try_element_at(labels, F.regexp_extract(n, pattern, 1))))


def with_sections(df: DataFrame, headers: dict[str, str], preamble: str, col: str = "text",
                  folded: str = "folded") -> DataFrame:
    """Add ``sections``: array of ``(ord, label, body, folded)`` of each row, in order."""
    cells = F.zip_with(
        F.split(F.col(col), "\n", -1), F.split(F.col(folded), "\n", -1),
        lambda raw, low: F.struct(raw.alias("raw"), low.alias("low"),
                                  header_label(tx.normalized(low), headers).alias("label")))

    def cut(c: Column) -> Column:
        at = F.filter(F.transform(c, lambda x, i: F.when(x["label"].isNotNull(), i + 1)), lambda i: i.isNotNull())
        return tx.let(F.concat(F.array(F.lit(0)), at, F.array(F.size(c) + 1)), lambda h: F.transform(
            F.sequence(F.lit(1), F.size(h) - 1), lambda k: section(c, h, k)))

    def section(c: Column, h: Column, k: Column) -> Column:
        start = F.element_at(h, k)
        body = F.slice(c, start + 1, F.element_at(h, k + 1) - start - 1)
        return F.struct(
            (k - 1).alias("ord"),
            F.when(k == 1, F.lit(preamble)).otherwise(F.element_at(c, F.greatest(start, F.lit(1)))["label"]).alias("label"),
            tx.trim_space(F.array_join(F.transform(body, lambda x: x["raw"]), "\n")).alias("body"),
            F.array_join(F.transform(body, lambda x: x["low"]), "\n").alias("folded"),
        )

    return df.withColumn("sections", tx.let(cells, cut))


def split_sections(df: DataFrame, headers: dict[str, str] | None = None, preamble: str = "header",
                   key: str = "doc_id", col: str = "text", unicode: str = "exact") -> DataFrame:
    """T4: ``(key, ord, label, body)``. A header line is dropped with everything on it."""
    folded = tx.with_folded(df.select(key, col), col, "folded", unicode)
    cut = with_sections(folded, headers or CV_HEADERS, preamble, col)
    return cut.select(key, F.explode("sections").alias("s")).select(key, "s.ord", "s.label", "s.body")


_HEADING = "(?:" + "|".join(IMPORT_HEADERS) + ")"
_HEADER_LINE = r"(?Umd)^\s*" + _HEADING + r"\s*[.:]*\s*$"


def detect_headers(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """T5: upper-case section headers ``(key, heading, start, end, confidence)``.

    ``start`` is the offset behind the header, ``end`` the offset of the next header or of the text end.
    A text without header is retried with line breaks put around headers glued to other text; its offsets
    then refer to the repaired text. Texts without any header yield no row.
    """
    text = F.col(col)
    repaired = F.regexp_replace(text, r"(?<=[^\n])(?=" + _HEADING + ")", "\n")
    repaired = F.regexp_replace(repaired, _HEADING + r"(?=[^\n.:])", "$0\n")
    work = tx.evaluated(df.select(key, F.when(text.rlike(_HEADER_LINE), text).otherwise(repaired).alias("_t")), key, "_t")
    # Cutting at every match gives the gaps; with the matched texts they give all offsets.
    work = work.filter(F.col("_t").rlike(_HEADER_LINE)).withColumns({
        "_hits": F.regexp_extract_all("_t", F.lit("(" + _HEADER_LINE + ")"), F.lit(1)),
        "_gaps": F.split("_t", _HEADER_LINE, -1),
    })
    lengths = F.zip_with("_gaps", "_hits", lambda g, h: F.struct(
        F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit"), h.alias("text")))
    run = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,next:int,text:string>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.concat(acc["found"], F.when(x["text"].isNull(), F.array().cast(
                "array<struct<first:int,next:int,text:string>>")).otherwise(F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("first"),
                    (acc["at"] + x["gap"] + x["hit"]).alias("next"),
                    x["text"].alias("text"))))).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    found = work.withColumn("_found", run).select(key, "_t", "_found", F.posexplode("_found").alias("_i", "_h"))
    heading = F.regexp_extract(F.col("_h.text"), "(" + "|".join(IMPORT_HEADERS) + ")", 1)
    bare = F.regexp_replace(tx.trim_space(F.col("_h.text")), r"[.: ]+\z", "")
    following = F.try_element_at("_found", F.col("_i") + 2)
    return found.select(
        key,
        heading.alias("heading"),
        F.col("_h.next").alias("start"),
        F.coalesce(following["first"], F.length("_t")).alias("end"),
        F.when(bare == heading, "High").otherwise("Low").alias("confidence"),
    )


def section_warnings(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """T5: ``NO_SECTIONS_DETECTED`` for each text in which no header can be found or repaired."""
    repaired = F.regexp_replace(F.col(col), r"(?<=[^\n])(?=" + _HEADING + ")", "\n")
    repaired = F.regexp_replace(repaired, _HEADING + r"(?=[^\n.:])", "$0\n")
    none = tx.is_blank(F.col(col)) | ~(F.col(col).rlike(_HEADER_LINE) | repaired.rlike(_HEADER_LINE))
    return df.filter(none).select(key, F.lit("NO_SECTIONS_DETECTED").alias("code"), F.lit("Info").alias("severity"))


# --- T6: signals ----------------------------------------------------------------------------------

# Whether there is one: a run of characters is there when one of them is.
_EMAIL = r"(?U)[\w.\-+]@[\w\-]+\.[\w.\-]"
_PHONE = r"(?U)\+?\d[\d \-().]{6,}\d"
_YEAR = r"(?U)(?=[12])\b(?:19|20)\d{2}\b"
_MAX_SUFFIX = max(map(len, STEM_SUFFIXES))


class VerbMatcher:
    """Counts words whose stem is one of the verb stems. A cheap prefix pattern picks the candidate words;
    only those are stemmed."""

    def __init__(self, verbs: list[str]):
        self.stems = sorted({tx.stem_python(v) for v in verbs})
        # The first character is looked at before what comes before it.
        heads = "(?=" + tx.any_of(sorted({s[:1] for s in self.stems})) + ")"
        self._pattern = heads + "(?<![^ ])((?:" + tx.any_of(self.stems) + ")[^ ]{0," + str(_MAX_SUFFIX) + "})(?![^ ])"

    def hits(self, norm: Column) -> Column:
        candidates = F.regexp_extract_all(norm, F.lit(self._pattern), F.lit(1))
        return F.filter(candidates, lambda w: tx.stem(w).isin(self.stems))


def with_signals(df: DataFrame, verbs: list[str] | None = None, col: str = "text", folded: str = "folded",
                 labels: Column | None = None, norm: str | None = None) -> DataFrame:
    """Add the document signals to rows that carry folded text, ``sections`` and, where ``norm`` names it, the normal form."""
    verbs = VerbMatcher(verbs or ACTION_VERBS)
    text, fold = F.col(col), F.col(folded)
    found = labels if labels is not None else F.transform("sections", lambda s: s["label"])
    present = F.array_sort(F.filter(F.array_distinct(found), lambda x: ~x.isin("header", "other")))
    pairs = F.arrays_zip(
        F.split(text, "\n", -1).alias("raw"),
        F.split(fold, "\n", -1).alias("low"),
    )
    with_digit = F.filter(pairs, lambda p: p["raw"].rlike(r"(?U)\d"))
    quantified = F.filter(with_digit, lambda p: F.size(verbs.hits(tx.normalized(p["low"]))) > 0)
    return (
        df.withColumn("sections_present", present)
        .withColumn("_norm", tx.normalized(fold) if norm is None else F.col(norm))
        .withColumns({
            "has_contact": (text.contains("@") & text.rlike(_EMAIL)) | text.rlike(_PHONE) | F.array_contains("sections_present", "contact"),
            "has_experience": F.array_contains("sections_present", "experience") | text.rlike(_YEAR),
            "action_verbs": F.size(verbs.hits(F.col("_norm"))),
            "quantified": F.size(quantified),
            "word_count": F.when(F.col("_norm") == "", 0).otherwise(
                F.length("_norm") - F.length(F.replace(F.col("_norm"), F.lit(" "), F.lit(""))) + 1),
        })
        .drop("_norm")
    )


def document_signals(df: DataFrame, verbs: list[str] | None = None, headers: dict[str, str] | None = None,
                     key: str = "doc_id", col: str = "text", unicode: str = "exact") -> DataFrame:
    """One row of signals per document."""
    folded = tx.with_folded(df.select(key, col), col, "folded", unicode)
    cut = with_sections(folded, headers or CV_HEADERS, "header", col)
    return with_signals(cut, verbs, col).select(
        key, "has_contact", "has_experience", "action_verbs", "quantified", "word_count", "sections_present")


# --- T7, T8: privacy and screening ----------------------------------------------------------------

MAX_REDACT_CHARS = 100_000
_R_EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_R_PHONE = (r"(?U)(?=[+(\d])(?<!\d)(?:\+?(?:57|1|34)[\s.-]?)?"
            r"(?:\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}[\s.-]?\d{3}[\s.-]?\d{3})(?!\d)")
_R_ALLOWED = (r"(?:[^/?#\s)@]*@)?(?:www\.)?(?:linkedin|github)\.com(?::\d*)?(?=[/?#\s)]|\z)")
_R_URL = r"(?iU)https?://(?!" + _R_ALLOWED + r")[^\s)]+"
_R_STREET = r"(?iU)(?=[cad])\b(?:calle|carrera|avenida|direcci[oó]n)\b"
_R_ADDRESS = _R_STREET + r"[^\n\r,.;}\]]*"
_R_ADDRESS_LINE = r"(?imdU)^.*\b(?:calle|carrera|avenida|direcci[oó]n)\b.*$"


def redacted(col: Column) -> Column:
    """Each step binds the text it starts from, and looks for what every match holds before it searches for matches."""
    def replaced(text: Column, may: Callable[[Column], Column], pattern: str, mark: str) -> Column:
        return tx.let(text, lambda t: F.when(may(t), F.regexp_replace(t, pattern, f"[{mark}_REDACTED]")).otherwise(t))

    out = replaced(col, lambda t: t.contains("@"), _R_EMAIL, "EMAIL")
    out = F.regexp_replace(out, _R_PHONE, "[PHONE_REDACTED]")
    out = replaced(out, lambda t: t.contains("://"), _R_URL, "URL")
    return tx.let(out, lambda t: F.when(~t.rlike(_R_STREET), t).otherwise(
        F.when(t.contains("{"), F.regexp_replace(t, _R_ADDRESS, "[ADDRESS_REDACTED]"))
        .otherwise(F.regexp_replace(t, _R_ADDRESS_LINE, "[ADDRESS_REDACTED]"))))


def _count_of(clean: Column, raw: Column, mark: str) -> Column:
    literal = F.lit("\\[" + mark + "_REDACTED\\]")
    return F.regexp_count(clean, literal) - F.regexp_count(raw, literal)


def redact(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(clean, rejects)``. Texts over 100,000 characters are rejected whole with a code."""
    too_long = F.lit(False)
    for c in cols:
        too_long = too_long | (F.coalesce(F.length(c), F.lit(0)) > MAX_REDACT_CHARS)
    clean = df.filter(~too_long).withColumns({c: redacted(F.col(c)) for c in cols})
    rejects = df.filter(too_long).withColumn("error_code", F.lit("redaction_failure"))
    return clean, rejects


def redaction_audit(df: DataFrame, key: str, col: str) -> DataFrame:
    """Placeholders added per kind and text; over-long texts have no counts but the code of their rejection."""
    clean, rejects = redact(df.select(key, col, F.col(col).alias("_raw")), [col])
    work = clean.select(key, "_raw", F.col(col).alias("_clean"), F.lit(None).cast("string").alias("error_code")).unionByName(
        rejects.select(key, F.lit(None).cast("string").alias("_raw"), F.lit(None).cast("string").alias("_clean"), "error_code"))
    return work.select(key, "error_code", *[
        _count_of(F.col("_clean"), F.col("_raw"), mark).alias("n_" + mark.lower())
        for mark in ("EMAIL", "PHONE", "URL", "ADDRESS")
    ])


def hostile(col: Column, patterns: list[str]) -> Column:
    """True for control characters, zero-width characters or a listed pattern, ignoring case."""
    def listed(low: Column) -> Column:
        return reduce(Column.__or__, [low.contains(p.lower()) for p in patterns], F.lit(False))

    found = col.rlike(r"[\x00-\x1F\x7F]") | col.rlike(r"[\x{200b}-\x{200d}\x{feff}]") | tx.let(F.lower(col), listed)
    return F.coalesce(found, F.lit(False))


def quarantine(df: DataFrame, cols: list[str], patterns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantined)``."""
    patterns = patterns if patterns is not None else INJECTION_PATTERNS
    bad = F.lit(False)
    for c in cols:
        bad = bad | hostile(F.col(c), patterns)
    return df.filter(~bad), df.filter(bad).withColumn("error_code", F.lit("JOB_SPEC_PROMPT_INJECTION"))


# --- T9: validation -------------------------------------------------------------------------------


def validate(df: DataFrame, rules: list[tuple[Column, str]], out: str = "errors") -> DataFrame:
    """Add the codes of the violated rules; a rule is ``(violation, code)``, codes kept once."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in rules]))
    return df.withColumn(out, F.array_distinct(codes))


def _len(col: Column) -> Column:
    return F.coalesce(F.length(col), F.lit(0))


def score_text_rules(cv: str = "cv_text", job: str = "job_text") -> list[tuple[Column, str]]:
    """Bounds of a text scoring request: CV 200..20,000 and vacancy 100..20,000 characters."""
    return [
        (~_len(F.col(cv)).between(200, 20_000), "CV_LENGTH"),
        (~_len(F.col(job)).between(100, 20_000), "JOB_LENGTH"),
    ]


def adapt_rules(cv: str = "cv_text", job: str = "job_text") -> list[tuple[Column, str]]:
    return [
        (tx.is_blank(F.col(cv)), "CV_EMPTY"),
        (_len(F.col(cv)) > 50_000, "CV_TOO_LONG"),
        (tx.is_blank(F.col(job)), "JOB_EMPTY"),
        (_len(F.col(job)) > 20_000, "JOB_TOO_LONG"),
        (tx.trim_space(F.col(cv)) == tx.trim_space(F.col(job)), "IDENTICAL"),
    ]


JOB_SPEC_LIMITS = {"title": 200, "company": 200, "description": 5000, "location": 200}
EMPLOYMENT_TYPES = ["FullTime", "PartTime", "Contract", "Internship", "Temporary"]


def job_spec_rules(employment_types: list[str] | None = None,
                   patterns: list[str] | None = None) -> list[tuple[Column, str]]:
    patterns = patterns if patterns is not None else INJECTION_PATTERNS
    rules = []
    for field, limit in JOB_SPEC_LIMITS.items():
        col = F.col(field)
        rules += [
            (tx.is_blank(col), "JOB_SPEC_FIELD_EMPTY"),
            (_len(col) > limit, "JOB_SPEC_FIELD_TOO_LONG"),
            (hostile(col, patterns), "JOB_SPEC_PROMPT_INJECTION"),
        ]
    items = F.coalesce(F.col("requirements"), F.array().cast("array<string>"))
    if employment_types:
        rules.append((~F.coalesce(F.col("employment_type").isin(employment_types), F.lit(False)),
                      "JOB_SPEC_INVALID_ENUM"))
    return rules + [
        (F.size(items) < 1, "JOB_SPEC_MISSING_REQUIREMENTS"),
        (F.size(items) > 50, "JOB_SPEC_FIELD_TOO_LONG"),
        (F.exists(items, lambda r: tx.is_blank(r)), "JOB_SPEC_FIELD_EMPTY"),
        (F.exists(items, lambda r: _len(r) > 500), "JOB_SPEC_FIELD_TOO_LONG"),
        (F.exists(items, lambda r: hostile(r, patterns)), "JOB_SPEC_PROMPT_INJECTION"),
    ]


def feedback_rules(cv: str = "cv_text", job: str = "job_text", limit: int = 32_000) -> list[tuple[Column, str]]:
    """The *redacted* texts together may hold at most ``limit`` characters."""
    fits = (_len(F.col(cv)) <= MAX_REDACT_CHARS) & (_len(F.col(job)) <= MAX_REDACT_CHARS)
    total = _len(redacted(F.col(cv))) + _len(redacted(F.col(job)))
    return [(~fits, "redaction_failure"), (fits & (total > limit), "validation_error")]


# --- T10, T11 -------------------------------------------------------------------------------------


def truncate_corpus(df: DataFrame, n: int = 50_000, col: str = "text") -> DataFrame:
    """Texts over ``n`` characters are cut and marked ``TEXT_TRUNCATED``."""
    long = F.length(col) > n
    return df.withColumns({
        "warning": F.when(long, F.lit("TEXT_TRUNCATED")),
        col: F.when(long, F.left(F.col(col), F.lit(n))).otherwise(F.col(col)),
    })


def truncate_lines(df: DataFrame, n: int = 50_000, lines: str = "lines") -> DataFrame:
    """Keep the leading lines of an array while each line plus one break still fits in ``n``."""
    kept = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, line: F.struct(
            F.when(acc["open"] & (acc["used"] + F.length(line) + 1 <= n), acc["used"] + F.length(line) + 1)
            .otherwise(acc["used"]).alias("used"),
            F.when(acc["open"] & (acc["used"] + F.length(line) + 1 <= n), acc["n"] + 1)
            .otherwise(acc["n"]).alias("n"),
            (acc["open"] & (acc["used"] + F.length(line) + 1 <= n)).alias("open"),
        ),
        lambda acc: acc["n"],
    )
    return df.withColumn("_keep", kept).withColumns({
        "warning": F.when(F.col("_keep") < F.size(lines), F.lit("TEXT_TRUNCATED")),
        lines: F.slice(lines, F.lit(1), F.col("_keep")),
    }).drop("_keep")


BLOCKED_MARK = "[BLOCKED]"


def strip_delimiters(df: DataFrame, col: str = "text", nonce: str | None = None, mark: str = BLOCKED_MARK) -> DataFrame:
    """Neutralise the data-block delimiters of a later consumer."""
    parts = ([f'</DATA nonce="{nonce}">'] if nonce else []) + ['</DATA nonce="fake">', "</DATA>", "<DATA"]
    out = F.col(col)
    for part in parts:
        out = F.replace(out, F.lit(part), F.lit(mark))
    return df.withColumn(col, out)
