"""Text, lexicon and vacancy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import IMPORT_HEADERS, INJECTION_PATTERNS
from ..operators import lexicon as lx
from ..operators import similar, text, vacancy
from . import common as c


def t1(spark, sf):
    return text.normalize_corpus(c.table(spark, sf, "documents")).select("doc_id", "norm")


def t2_tokens(spark, sf):
    return text.tokenize_corpus(c.table(spark, sf, "documents"))


def t2_vocabulary(spark, sf):
    return text.vocabulary(c.table(spark, sf, "documents"))


def t3(spark, sf):
    return text.stem_vocabulary(text.tokenize_corpus(c.table(spark, sf, "documents")))


def t4(spark, sf):
    return text.split_sections(c.table(spark, sf, "documents"), c.HEADERS)


def upper_documents(spark, sf):
    """The corpus with its frequent header words turned into upper-case import headers."""
    docs = c.table(spark, sf, "documents")
    out = F.col("text")
    for word, heading in (("The", "EXPERIENCE"), ("And", "SKILLS"), ("La", "EDUCACIÓN"), ("De", "PERFIL:")):
        out = F.regexp_replace(out, f"(^|\\n){word} ", f"$1{heading}\n")
    return docs.select("doc_id", out.alias("text"))


def t5(spark, sf):
    return text.detect_headers(upper_documents(spark, sf))


def t5_warnings(spark, sf):
    return text.section_warnings(upper_documents(spark, sf))


def t6(spark, sf):
    out = text.document_signals(c.table(spark, sf, "documents"), c.VERBS, c.HEADERS)
    return out.withColumn("sections_present", F.array_join("sections_present", ","))


def t7(spark, sf):
    clean, rejects = text.redact(c.table(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return clean.withColumn("error_code", F.lit("")).unionByName(rejects.withColumn("text", F.lit("")))


def t7_audit(spark, sf):
    turns = c.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"), "text")
    docs = c.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return text.redaction_audit(turns.unionByName(docs), "id", "text").na.fill("", ["error_code"]).na.fill(-1)


SCREEN = ["the the", "que la", "de la"]


def t8(spark, sf):
    turns = c.table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    clean, bad = text.quarantine(turns, ["text"], INJECTION_PATTERNS + SCREEN)
    return clean.select("conv_id", "turn", F.lit("clean").alias("verdict")).unionByName(
        bad.select("conv_id", "turn", F.lit("quarantined").alias("verdict")))


def _requests(spark, sf):
    docs = c.table(spark, sf, "documents").select(F.col("doc_id").alias("cv_id"), F.col("text").alias("cv_text"))
    bench = c.jobs(spark, sf).select("job_id", F.col("text").alias("job_text"))
    return c.pairs(spark, sf).join(docs, "cv_id").join(bench, "job_id")


def t9(spark, sf):
    rules = text.score_text_rules() + text.adapt_rules() + text.feedback_rules(limit=8_000)
    out = text.validate(_requests(spark, sf), rules)
    return out.select("cv_id", "job_id", F.array_join("errors", ",").alias("errors"))


def t9_job_spec(spark, sf):
    part = c.dealt(c.table(spark, sf, "part"), "p_partkey")
    spec = part.select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.repeat(F.col("p_type"), F.col("p_size") * 20).alias("description"), F.lit(" ").alias("location"),
        F.when(F.col("p_size") % 2 == 0, "Contract").otherwise("Gig").alias("employment_type"),
        F.when(F.col("p_size") < 5, F.array().cast("array<string>")).otherwise(
            F.array_repeat(F.concat_ws(" ", "p_type", F.lit("system:")), F.col("p_size") + 5)).alias("requirements"))
    out = text.validate(spec, text.job_spec_rules(text.EMPLOYMENT_TYPES))
    return out.select("p_partkey", F.array_join("errors", ",").alias("errors"))


def t10(spark, sf):
    out = text.truncate_corpus(c.table(spark, sf, "documents").select("doc_id", "text"), 2_000)
    return out.select("doc_id", "text", "warning")


def t10_lines(spark, sf):
    docs = c.table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    out = text.truncate_lines(docs, 1_000)
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"), "warning")


def t11(spark, sf):
    docs = c.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit('<DATA nonce="x1">'), "text", F.lit('</DATA nonce="x1"></DATA>')).alias("text"))
    return text.strip_delimiters(docs, nonce="x1")


def part_words(spark, sf):
    names = c.table(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("token"))
    return names.distinct()


def t12_levenshtein(spark, sf):
    vocabulary = text.tokenize_corpus(c.table(spark, sf, "documents")).select("token").distinct()
    return similar.similar_terms(part_words(spark, sf), vocabulary, "levenshtein", 2)


def t12_jaro_winkler(spark, sf):
    docs = text.tokenize_corpus(c.table(spark, sf, "documents")).select("token").distinct()
    bench = text.tokenize_corpus(c.table(spark, sf, "benchmark"), "item_id").select("token").distinct()
    return similar.similar_terms(bench, docs, "jaro_winkler", 0.92)


def s2(spark, sf):
    lex = c.lexicon(spark, sf)
    return lex.entries.select(F.lit("entry").alias("kind"), "skill_id", F.concat_ws("/", "canonical", "category").alias("value")).unionByName(
        lex.aliases.select(F.lit("alias").alias("kind"), "skill_id", F.col("alias").alias("value"))).unionByName(
        lex.implies.select(F.lit("implies").alias("kind"), F.col("src").alias("skill_id"), F.col("dst").alias("value")))


def l1(spark, sf):
    return lx.lexicon_index(c.lexicon(spark, sf))


def _scans(spark, sf):
    sections = lx.sections_of(c.table(spark, sf, "documents"), c.HEADERS, "header", "doc_id")
    return lx.scan_skills(sections, lx.lexicon_index(c.lexicon(spark, sf)))


def l2(spark, sf):
    return _scans(spark, sf).select("doc_id", "ord", "label", "skill_id", "n")


def l3(spark, sf):
    return lx.skill_placement(_scans(spark, sf)).select("doc_id", "skill_id", "placement", "n")


def l4(spark, sf):
    edges = lx.lexicon_edges(c.lexicon(spark, sf), c.CONFUSABLE)
    out = None
    for kind, df in edges.items():
        a, b = df.columns
        rows = df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out


def l5(spark, sf):
    sections = lx.sections_of(c.table(spark, sf, "documents"), c.HEADERS, "header", "doc_id")
    out = lx.sections_present(sections)
    return out.select("doc_id", F.array_join("sections_present", ",").alias("sections_present"))


def v1(spark, sf):
    out = vacancy.extract_requirements(c.jobs(spark, sf), c.lexicon(spark, sf), c.VACANCY_HEADERS)
    return out.withColumn("weight", F.round("weight", 6))


def v2(spark, sf):
    return vacancy.context_hash(vacancy.extract_requirements(c.jobs(spark, sf), c.lexicon(spark, sf), c.VACANCY_HEADERS))


QUERIES = {
    "s2_load_lexicon": s2,
    "t1_normalize_corpus": t1, "t2_tokenize_corpus": t2_tokens, "t2_vocabulary": t2_vocabulary,
    "t3_stem_vocabulary": t3, "t4_split_sections": t4, "t5_detect_headers": t5, "t5_section_warnings": t5_warnings,
    "t6_document_signals": t6, "t7_redact": t7, "t7_redaction_audit": t7_audit, "t8_quarantine": t8,
    "t9_validate_requests": t9, "t9_validate_job_specs": t9_job_spec, "t10_truncate_corpus": t10,
    "t10_truncate_lines": t10_lines, "t11_strip_delimiters": t11, "t12_levenshtein": t12_levenshtein,
    "t12_jaro_winkler": t12_jaro_winkler,
    "l1_lexicon_index": l1, "l2_scan_skills": l2, "l3_skill_placement": l3, "l4_lexicon_edges": l4,
    "l5_sections_present": l5, "v1_extract_requirements": v1, "v2_context_hash": v2,
}

_W = c.sql_words("text")
_SECT = c.sql_sections("documents", "doc_id", c.HEADERS, "header")
_JSECT = c.sql_sections("jobs", "job_id", c.VACANCY_HEADERS, "title", "_j")
_VERB_STEMS = "[" + ", ".join(f"'{s}'" for s in sorted({tx.stem_python(v) for v in c.VERBS})) + "]"
_HEADING = "(?:" + "|".join(IMPORT_HEADERS) + ")"

_UPPER = "text"
for _word, _heading in (("The", "EXPERIENCE"), ("And", "SKILLS"), ("La", "EDUCACIÓN"), ("De", "PERFIL:")):
    _UPPER = f"regexp_replace({_UPPER}, '(^|\\n){_word} ', '\\1{_heading}' || chr(10), 'g')"

_LINE = "(?m)^\\s*" + _HEADING + "\\s*[.:]*\\s*$"

_R = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": (r"(^|[^0-9])(?:\+?(?:57|1|34)[\s.-]?)?"
              r"(?:\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}[\s.-]?\d{3}[\s.-]?\d{3})($|[^0-9])"),
}


def _sql_redact(x: str) -> str:
    """RE2 has no look-around: allowed hosts are guarded by a mark first, digits around phones are captured,
    and the phone pass runs twice for neighbours sharing one separator."""
    out = f"regexp_replace({x}, '{_R['email']}', '[EMAIL_REDACTED]', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{_R['phone']}', '\\1[PHONE_REDACTED]\\2', 'g')"
    out = f"regexp_replace({out}, '(?i)(https?)://((?:www\\.)?(?:linkedin|github)\\.com(?:[/?#\\s)]|$))', '\\1' || chr(57361) || '\\2', 'g')"
    out = f"regexp_replace({out}, '(?i)https?://[^\\s)]+', '[URL_REDACTED]', 'g')"
    out = f"replace({out}, chr(57361), '://')"
    address = "(?i)\\b(?:calle|carrera|avenida|direcci[oó]n)\\b[^\\n\\r,.;}}\\]]*".replace("}}", "}")
    line = "(?im)^.*\\b(?:calle|carrera|avenida|direcci[oó]n)\\b.*$"
    return (f"CASE WHEN contains({out}, '{{') THEN regexp_replace({out}, '{address}', '[ADDRESS_REDACTED]', 'g') "
            f"ELSE regexp_replace({out}, '{line}', '[ADDRESS_REDACTED]', 'g') END")


def _added(kind: str) -> str:
    return (f"CAST((length(cleaned) - length(replace(cleaned, '[{kind}_REDACTED]', ''))) / {len(kind) + 11} AS INTEGER) - "
            f"CAST((length(text) - length(replace(text, '[{kind}_REDACTED]', ''))) / {len(kind) + 11} AS INTEGER)")


def _bad(x: str, extra: list[str]) -> str:
    listed = " OR ".join(f"contains(lower({x}), {c.sql_quote(p.lower())})" for p in INJECTION_PATTERNS + extra)
    return f"(regexp_matches({x}, '[\\x00-\\x1F\\x7F]') OR regexp_matches({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]') OR {listed})"


_LEX = f"WITH {c.SQL_SKILLS}, {c.SQL_PATTERN}"
_DOC_HITS = f"{_LEX}, {_SECT}, {c.sql_hits('doc_id', 'sects', 'hits')}"
_JOB = f"{_LEX}, {c.SQL_JOBS}, {_JSECT}, {c.sql_hits('job_id', 'sects_j', 'job_hits')}, {c.SQL_REQUIREMENTS}"
_BLANK = "NOT regexp_matches({0}, '\\S')"

ORACLES = {
    "s2_load_lexicon": f"""WITH {c.SQL_SKILLS}
        SELECT 'entry' AS kind, skill_id, canonical || '/' || category AS value FROM skills
        UNION ALL SELECT 'alias', skill_id, unnest(aliases) FROM skills
        UNION ALL SELECT 'implies', skill_id, implies FROM skills""",
    "t1_normalize_corpus": f"SELECT doc_id, {c.sql_norm('text')} AS norm FROM documents",
    "t2_tokenize_corpus": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token FROM (
        SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents))""",
    "t2_vocabulary": f"""SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df
        FROM (SELECT doc_id, unnest({_W}) AS token FROM documents) GROUP BY token""",
    "t3_stem_vocabulary": f"""SELECT token, {c.sql_stem('token')} AS stem
        FROM (SELECT DISTINCT unnest({_W}) AS token FROM documents)""",
    "t4_split_sections": f"WITH {_SECT} SELECT doc_id, ord, label, body FROM sects",
    "t5_section_warnings": f"""WITH u AS (SELECT doc_id, {_UPPER} AS text FROM documents),
        r AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([^\\n])({_HEADING})', '\\1' || chr(10) || '\\2', 'g'),
          '({_HEADING})([^\\n.:])', '\\1' || chr(10) || '\\2', 'g') AS fixed FROM u)
        SELECT doc_id, 'NO_SECTIONS_DETECTED' AS code, 'Info' AS severity FROM r
        WHERE NOT regexp_matches(text, '{_LINE}') AND NOT regexp_matches(fixed, '{_LINE}')""",
    "t6_document_signals": f"""WITH {_SECT},
        labels AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label NOT IN ('header', 'other'))), ',') AS sections_present
          FROM sects GROUP BY doc_id),
        verbs AS (SELECT doc_id, i, line, len(w) AS n_words,
          len(list_filter(w, lambda x: list_contains({_VERB_STEMS}, {c.sql_stem('x')}))) AS n_verbs FROM lines),
        agg AS (SELECT doc_id, CAST(sum(n_verbs) AS INTEGER) AS action_verbs, CAST(sum(n_words) AS INTEGER) AS word_count,
          CAST(count(*) FILTER (WHERE n_verbs > 0 AND regexp_matches(line, '\\pN')) AS INTEGER) AS quantified FROM verbs GROUP BY doc_id)
        SELECT d.doc_id,
          regexp_matches(text, '[\\pL\\pN_.\\-+]+@[\\pL\\pN_\\-]+\\.[\\pL\\pN_.\\-]+') OR regexp_matches(text, '\\+?\\d[\\d \\-().]{{6,}}\\d')
            OR list_contains(string_split(coalesce(sections_present, ''), ','), 'contact') AS has_contact,
          list_contains(string_split(coalesce(sections_present, ''), ','), 'experience')
            OR regexp_matches(text, '(^|[^\\pL\\pN_])(19|20)\\d{{2}}([^\\pL\\pN_]|$)') AS has_experience,
          action_verbs, quantified, word_count, coalesce(sections_present, '') AS sections_present
        FROM documents d JOIN labels USING (doc_id) JOIN agg USING (doc_id)""",
    "t7_redact": f"""SELECT doc_id, CASE WHEN length(text) > 100000 THEN '' ELSE {_sql_redact('text')} END AS text,
        CASE WHEN length(text) > 100000 THEN 'redaction_failure' ELSE '' END AS error_code FROM documents""",
    "t7_redaction_audit": f"""WITH src AS (
          SELECT conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'd' || doc_id, text FROM documents),
        r AS (SELECT id, text, {_sql_redact('text')} AS cleaned FROM src WHERE length(text) <= 100000)
        SELECT id, '' AS error_code, {_added('EMAIL')} AS n_email, {_added('PHONE')} AS n_phone, {_added('URL')} AS n_url,
          {_added('ADDRESS')} AS n_address FROM r
        UNION ALL SELECT id, 'redaction_failure', -1, -1, -1, -1 FROM src WHERE length(text) > 100000""",
    "t8_quarantine": f"""SELECT conv_id, turn, CASE WHEN {_bad('t', SCREEN)} THEN 'quarantined' ELSE 'clean' END AS verdict
        FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations)""",
    "t9_validate_requests": f"""WITH {c.SQL_PAIRS}, r AS (
          SELECT cv_id, job_id, d.text AS cv, b.text AS job FROM pairs
          JOIN documents d ON d.doc_id = cv_id JOIN benchmark b ON b.item_id = job_id)
        SELECT cv_id, job_id, array_to_string(list_filter([
          CASE WHEN length(cv) NOT BETWEEN 200 AND 20000 THEN 'CV_LENGTH' END,
          CASE WHEN length(job) NOT BETWEEN 100 AND 20000 THEN 'JOB_LENGTH' END,
          CASE WHEN {_BLANK.format('cv')} THEN 'CV_EMPTY' END,
          CASE WHEN length(cv) > 50000 THEN 'CV_TOO_LONG' END,
          CASE WHEN {_BLANK.format('job')} THEN 'JOB_EMPTY' END,
          CASE WHEN length(job) > 20000 THEN 'JOB_TOO_LONG' END,
          CASE WHEN trim(cv) = trim(job) THEN 'IDENTICAL' END,
          CASE WHEN length({_sql_redact('cv')}) + length({_sql_redact('job')}) > 8000 THEN 'validation_error' END
        ], lambda x: x IS NOT NULL), ',') AS errors FROM r""",
    "t9_validate_job_specs": """SELECT p_partkey, array_to_string(list_filter([
          CASE WHEN length(p_type) * p_size * 20 > 5000 THEN 'JOB_SPEC_FIELD_TOO_LONG' END,
          'JOB_SPEC_FIELD_EMPTY',
          CASE WHEN p_size % 2 = 1 THEN 'JOB_SPEC_INVALID_ENUM' END,
          CASE WHEN p_size < 5 THEN 'JOB_SPEC_MISSING_REQUIREMENTS' END,
          CASE WHEN p_size > 45 AND length(p_type) * p_size * 20 <= 5000 THEN 'JOB_SPEC_FIELD_TOO_LONG' END,
          CASE WHEN p_size >= 5 THEN 'JOB_SPEC_PROMPT_INJECTION' END
        ], lambda x: x IS NOT NULL), ',') AS errors FROM part""",
    "t10_truncate_corpus": """SELECT doc_id, left(text, 2000) AS text,
        CASE WHEN length(text) > 2000 THEN 'TEXT_TRUNCATED' END AS warning FROM documents""",
    "t10_truncate_lines": """WITH l AS (SELECT doc_id, i, len(a) AS total, a[i] AS line FROM (
          SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
        r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l)
        SELECT doc_id, CAST(count(*) FILTER (WHERE used <= 1000) AS INTEGER) AS n_lines,
          coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= 1000), '') AS text,
          CASE WHEN count(*) FILTER (WHERE used <= 1000) < max(total) THEN 'TEXT_TRUNCATED' END AS warning
        FROM r GROUP BY doc_id""",
    "t11_strip_delimiters": """SELECT doc_id, replace(replace(replace(replace('<DATA nonce="x1">' || text || '</DATA nonce="x1"></DATA>',
          '</DATA nonce="x1">', '[BLOCKED]'), '</DATA nonce="fake">', '[BLOCKED]'), '</DATA>', '[BLOCKED]'), '<DATA', '[BLOCKED]') AS text
        FROM documents""",
    "t12_levenshtein": f"""WITH a AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS a FROM part),
        b AS (SELECT b, translate(b, 'ñßœæªº', '!$%&*^') AS t FROM (SELECT DISTINCT unnest({_W}) AS b FROM documents))
        SELECT a, b, CAST(levenshtein(a, t) AS INTEGER) AS score FROM a, b
        WHERE abs(length(a) - length(t)) <= 2 AND levenshtein(a, t) <= 2""",
    "t12_jaro_winkler": f"""WITH RECURSIVE words_a AS (SELECT DISTINCT unnest({_W}) AS a FROM benchmark),
        words_b AS (SELECT DISTINCT unnest({_W}) AS b FROM documents),
        pairs AS (SELECT a, b, translate(a, 'ñßœæªº', '!$%&*^') AS s, translate(b, 'ñßœæªº', '!$%&*^') AS t FROM words_a, words_b),
        {c.sql_jaro_winkler('pairs', 0.92)} SELECT a, b, score FROM alike""",
    "l1_lexicon_index": f"WITH {c.SQL_SKILLS} SELECT term, skill_id FROM lex",
    "l2_scan_skills": f"{_DOC_HITS} SELECT doc_id, ord, label, skill_id, count(*) AS n FROM hits GROUP BY ALL",
    "l3_skill_placement": f"""{_DOC_HITS} SELECT doc_id, skill_id,
        CASE WHEN bool_or(label IN ('skills', 'summary', 'certifications', 'header')) THEN 'Prominent' ELSE 'Buried' END AS placement,
        count(*) AS n FROM hits GROUP BY doc_id, skill_id""",
    "l4_lexicon_edges": f"""WITH {c.SQL_SKILLS}
        SELECT 'implied' AS kind, skill_id AS a, implies AS b FROM skills
        UNION ALL SELECT * FROM (SELECT 'related', skill_id, related FROM skills UNION SELECT 'related', related, skill_id FROM skills
          UNION SELECT 'related', implies, skill_id FROM skills)
        UNION ALL SELECT DISTINCT 'confusable', least(skill_id, confusable), greatest(skill_id, confusable) FROM skills
        UNION ALL VALUES ('confusable_terms', 'the', 'then'), ('confusable_terms', 'and', 'hand'), ('confusable_terms', 'thin', 'thing')""",
    "l5_sections_present": f"""WITH {_SECT} SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT label)
        FILTER (WHERE label NOT IN ('header', 'other'))), ','), '') AS sections_present FROM sects GROUP BY doc_id""",
    "v1_extract_requirements": f"""{_JOB} SELECT job_id, skill_id, display, category, section, n, round(weight, 6) AS weight FROM reqs""",
    "v2_context_hash": f"""{_JOB} SELECT job_id, sha256(string_agg(skill_id || ':' || printf('%.2f', weight) || ':' ||
        CASE section WHEN 'must' THEN 'MustHave' WHEN 'title' THEN 'Title' WHEN 'resp' THEN 'Responsibility' ELSE 'NiceToHave' END,
        '|' ORDER BY skill_id)) AS context_hash FROM reqs GROUP BY job_id""",
}
