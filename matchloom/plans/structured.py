"""Structured scoring, extraction and intake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import score_v2 as v2
from ..sources import intake
from . import common as c

# --- structured CVs: customers with their orders as jobs --------------------------------------------


def cvs(spark, sf):
    o = c.table(spark, sf, "orders")
    job = F.struct(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("co"), F.col("o_orderkey") % 5).alias("name"), F.col("o_orderpriority").alias("position"),
        F.when(F.col("o_orderkey") % 13 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("start"),
        F.when(F.col("o_orderkey") % 6 != 0, F.date_format(F.col("o_orderdate") + F.expr("interval 120 days"), "yyyy-MM")).alias("end"))
    work = o.groupBy(F.col("o_custkey").alias("cv_id")).agg(F.array_sort(F.collect_list(job)).alias("work"))
    k = F.col("c_custkey")
    cu = c.table(spark, sf, "customer").select(
        k.alias("cv_id"),
        F.struct(
            F.when(k % 10 == 0, "none").otherwise(F.concat(F.lit("c"), k, F.lit("@mail.org"))).alias("email"),
            F.when(k % 3 != 0, F.concat(F.lit("+57 300 "), F.lpad(k.cast("string"), 7, "0"))).alias("phone"),
            F.when(k % 4 == 0, "https://x.org").alias("url")).alias("basics"),
        F.when(k % 5 == 0, F.array().cast("array<struct<institution:string,area:string,study_type:string>>")).otherwise(F.array(F.struct(
            F.col("c_mktsegment").alias("institution"), F.when(k % 7 == 0, "Economy").otherwise("ley").alias("area"), F.lit("BSc").alias("study_type")))).alias("education"),
        F.array_compact(F.array(
            F.struct(F.col("c_mktsegment").alias("name")), F.when(k % 2 == 0, F.struct(F.lit("small ring").alias("name"))),
            F.when(k % 3 == 0, F.struct(F.lit("Brand Economy").alias("name"))))).alias("skills"),
        F.array_repeat(F.struct(F.lit("cert").alias("name")), (k % 6).cast("int")).alias("certificates"))
    none = F.array().cast("array<struct<k:bigint,name:string,position:string,start:string,end:string>>")
    return cu.join(work, "cv_id", "left").withColumn("work", F.coalesce("work", none))


def pairs(spark, sf):
    part = c.table(spark, sf, "part")
    n = part.agg(F.count(F.lit(1))).scalar()
    k = F.col("p_partkey")
    jobs = part.select(
        k.alias("job_id"), F.concat_ws(" ", "p_brand", F.element_at(F.array(F.lit("Urgent"), F.lit("high"), F.lit("LOW"), F.lit("¿?")), (k % 4 + 1).cast("int"))).alias("title"),
        F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_type", "p_brand")).alias("requirements"))
    return cvs(spark, sf).withColumn("job_id", F.col("cv_id") % n).join(jobs, "job_id")


def r1(spark, sf):
    docs = c.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(v2.v2_tokens(F.col("text")), " ").alias("tokens"))


def r2(spark, sf):
    return v2.experience_score(pairs(spark, sf)).select("cv_id", "job_id", "experience")


def r3(spark, sf):
    return v2.education_score(pairs(spark, sf)).select("cv_id", "job_id", "education_score")


def r4(spark, sf):
    return v2.skill_coverage(pairs(spark, sf)).select("cv_id", "job_id", F.round("coverage", 6).alias("coverage"), "skills_score")


def r5(spark, sf):
    return v2.certification_score(cvs(spark, sf)).select("cv_id", "certification_score")


def r6(spark, sf):
    return v2.contact_score(cvs(spark, sf)).select("cv_id", "contact_score")


def r7(spark, sf):
    return v2.employment_gap(cvs(spark, sf)).select("cv_id", F.coalesce("gap_months", F.lit(-1)).alias("gap_months"))


def r8(spark, sf):
    return v2.job_hopping(cvs(spark, sf)).select("cv_id", "hopping")


def r9(spark, sf):
    return v2.red_flags(pairs(spark, sf))


def r9_prevalence(spark, sf):
    return v2.red_flags(pairs(spark, sf)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def r10(spark, sf):
    return v2.score_v2(pairs(spark, sf)).select(
        "cv_id", "job_id", "experience", "education_score", "skills_score", "certification_score", "contact_score", "overall", "band")


def r11(spark, sf):
    return v2.context_hash_v2(pairs(spark, sf)).select("cv_id", "job_id", "context_hash")


# --- CV lines built from customers (expressions valid in both SQL dialects) --------------------------

LINES = [
    "CASE WHEN c_custkey % 3 = 0 THEN 'Ana María Pérez' WHEN c_custkey % 3 = 1 THEN c_name ELSE '  Luis Gil  ' END",
    "CASE WHEN c_custkey % 5 = 0 THEN 'Mail' ELSE 'Mail: c' || c_custkey || '@mail.org +57 300 555 0101' END",
    "CASE WHEN c_custkey % 4 = 0 THEN 'x@y.io, z@w.io' ELSE 'Tel +1 (305) 555 0' || (c_custkey % 90 + 10) END",
    "''",
    "CASE WHEN c_custkey % 2 = 0 THEN 'Web https://site.org/u' || c_custkey || '. y' ELSE 'Web github.com/u' || c_custkey END",
    "'See www.linkedin.com/in/u' || c_custkey || ', GitHub.com/u' || c_custkey || ' and other.com'",
    "CASE WHEN c_custkey % 6 = 0 THEN 'Jobs' ELSE 'Experiencia:' END",
    "'Acme' || c_custkey || ' · Engineer · 2015 - ' || (2016 + c_custkey % 5)",
    "'Built things'",
    "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Second ' || c_mktsegment END",
    "'Globex · ' || c_mktsegment || ' · 2010 - present'",
    "CASE WHEN c_custkey % 7 = 0 THEN 'EDUCATION' ELSE 'FORMACIÓN' END",
    "'Uni · Law · Hons'",
    "'2001 – 2005'",
    "'SKILLS'",
    "'C#, SQL; ' || c_mktsegment || ' · Git'",
    "' Docker ,, '",
    "CASE WHEN c_custkey % 8 = 0 THEN 'IDIOMAS' ELSE 'PROYECTOS' END",
    "'Alpha'",
    "'did it'",
    "''",
    "'Beta ' || c_custkey",
]


def cv_lines(spark, sf):
    return c.dealt(c.table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.array(*[F.expr(e) for e in LINES]).alias("lines"))


def x1(spark, sf):
    out = ex.extract_basics(cv_lines(spark, sf))
    return out.select("doc_id", "name", "email", F.coalesce("phone", F.lit("")).alias("phone"), F.coalesce("url", F.lit("")).alias("url"))


def x2(spark, sf):
    return ex.extract_profiles(cv_lines(spark, sf))


def x3(spark, sf):
    return ex.section_bounds(cv_lines(spark, sf))


def _work(spark, sf, layout):
    return ex.extract_work(cv_lines(spark, sf), layout=layout).withColumn("highlights", F.array_join("highlights", "|"))


def x4(spark, sf):
    return _work(spark, sf, "pdf")


def x4_docx(spark, sf):
    return _work(spark, sf, "docx")


def x5(spark, sf):
    return ex.extract_education(cv_lines(spark, sf))


def x6(spark, sf):
    return ex.extract_skills(cv_lines(spark, sf))


def x7(spark, sf):
    return ex.extract_projects(cv_lines(spark, sf)).withColumn("highlights", F.array_join("highlights", "|"))


def x8(spark, sf):
    return ex.mark_confidence(cv_lines(spark, sf)).withColumn("warning", F.coalesce("warning", F.lit("")))


def x9(spark, sf):
    li = c.table(spark, sf, "lineitem")
    words = li.select(
        F.expr("l_orderkey div 100").alias("doc_id"), (F.col("l_suppkey") % 3).alias("page"), (F.col("l_extendedprice") % 600).alias("x"),
        (F.col("l_partkey") % 700).cast("double").alias("y"), F.concat(F.lit("w"), "l_orderkey", F.lit("_"), "l_linenumber").alias("text"))
    return ex.words_to_lines(words)


# --- intake ---------------------------------------------------------------------------------------

_VERSION = """CASE p_partkey % 5 WHEN 0 THEN '"engineVersion":"1.0.0",' WHEN 1 THEN '"engineVersion": "2.0.0",' WHEN 2 THEN '"engineVersion":"3.0.0",' WHEN 3 THEN '"engineVersion":2,' ELSE '' END"""
_BODY = """'{' || (""" + _VERSION + """) || '"cvText":"' || p_name || '","jobText":"' || p_type || '","cv":{"basics":{"email":"' || p_name || '"},"skills":[{"name":"' || p_type || '"}]},"job":{"title":"' || p_brand || '","requirements":["' || p_type || '"]}}'"""


def s3(spark, sf):
    rows = c.table(spark, sf, "part").select("p_partkey", F.expr(_BODY).alias("body"))
    text, structured, bad = intake.parse_requests(rows, "body")
    return text.select("p_partkey", F.lit("text").alias("kind"), F.concat_ws("/", "cvText", "jobText").alias("value")).unionByName(
        structured.select("p_partkey", F.lit("structured").alias("kind"), F.concat_ws("/", "cv.basics.email", F.col("cv.skills")[0]["name"], "job.title", F.col("job.requirements")[0]).alias("value"))).unionByName(
        bad.select("p_partkey", F.lit("rejected").alias("kind"), F.col("error_code").alias("value")))


def s4(spark, sf):
    d = F.col("doc_id")
    magic = F.when(d % 3 == 0, "%PDF").when(d % 3 == 1, "PK\u0003\u0004").otherwise("")
    files = c.table(spark, sf, "documents").select(
        F.concat(F.lit("/landing/"), d, F.when(d % 2 == 0, ".pdf").when(d % 5 == 0, ".txt").otherwise(".docx")).alias("path"),
        F.encode(F.when(d % 11 == 0, "").otherwise(F.concat(magic, "text")), "UTF-8").alias("content"))
    return intake.audit_uploads(files.withColumn("length", F.length("content"))).withColumn("error_code", F.coalesce("error_code", F.lit("")))


QUERIES = {
    "r1_tokens": r1, "r2_experience_score": r2, "r3_education_score": r3, "r4_skill_coverage": r4, "r5_certification_score": r5,
    "r6_contact_score": r6, "r7_employment_gap": r7, "r8_job_hopping": r8, "r9_red_flags": r9, "r9_prevalence": r9_prevalence,
    "r10_score_v2": r10, "r11_context_hash": r11,
    "x1_basics": x1, "x2_profiles": x2, "x3_section_bounds": x3, "x4_work": x4, "x4_work_docx": x4_docx, "x5_education": x5,
    "x6_skills": x6, "x7_projects": x7, "x8_confidence": x8, "x9_words_to_lines": x9,
    "s3_parse_requests": s3, "s4_audit_uploads": s4,
}


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda q: q <> '')"


_V2 = f"""WITH job_rows AS (SELECT o_custkey AS cv_id, o_orderkey AS k, 'co' || (o_orderkey % 5) AS name, o_orderpriority AS position,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS st, year(o_orderdate) * 12 + month(o_orderdate) AS sm, o_orderdate + INTERVAL 120 DAY AS e FROM orders),
  cv AS (SELECT c_custkey AS cv_id, c_custkey AS k, c_mktsegment AS seg, c_custkey % 10 <> 0 AS mail, c_custkey % 3 <> 0 AS phone, c_custkey % 4 = 0 AS web FROM customer),
  job AS (SELECT p_partkey AS job_id, p_brand || ' ' || ['Urgent', 'high', 'LOW', '¿?'][p_partkey % 4 + 1] AS title,
    CASE WHEN p_partkey % 9 = 0 THEN [] ELSE [p_name, p_type, p_brand] END AS req FROM part),
  pr AS (SELECT cv.*, job.* FROM cv JOIN job ON job_id = k % (SELECT count(*) FROM part)),
  hits AS (SELECT cv_id, count(*) AS n FROM pr JOIN job_rows USING (cv_id) WHERE list_has_any({_tok('title')}, {_tok("position || ' ' || job_rows.name")}) GROUP BY cv_id),
  need AS (SELECT *, list_distinct({_tok("array_to_string(req, ' ')")}) AS nt,
    list_distinct({_tok("seg || CASE WHEN k % 2 = 0 THEN ' small ring' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' Brand Economy' ELSE '' END")}) AS sk,
    {_tok("seg || CASE WHEN k % 7 = 0 THEN ' Economy' ELSE ' ley' END || ' BSc'")} AS edu FROM pr),
  dated AS (SELECT cv_id, k, st, sm, CASE WHEN k % 6 <> 0 THEN year(e) * 12 + month(e) END AS em FROM job_rows WHERE st IS NOT NULL),
  gaps AS (SELECT cv_id, max(g) FILTER (WHERE g > 6) AS gap FROM (SELECT cv_id, sm - lag(em) OVER (PARTITION BY cv_id ORDER BY st, k) AS g FROM dated) GROUP BY cv_id),
  hop AS (SELECT cv_id, count(*) FILTER (WHERE sm >= m - 24) > 3 AS hopping FROM (SELECT *, max(sm) OVER (PARTITION BY cv_id) AS m FROM dated) GROUP BY cv_id),
  parts AS (SELECT need.*, coalesce(n, 0) AS n, coalesce(hopping, false) AS hopping, gap,
    CASE WHEN coalesce(n, 0) >= 3 THEN 95 WHEN n = 2 THEN 80 WHEN n = 1 THEN 60 ELSE 30 END AS exp,
    CASE WHEN k % 5 = 0 THEN 0 WHEN list_has_any(nt, edu) THEN 90 ELSE 60 END AS ed,
    CASE WHEN len(req) = 0 OR len(nt) = 0 THEN 0.0 ELSE 100.0::DOUBLE * len(list_intersect(nt, sk)) / len(nt) END::DOUBLE AS cov,
    CAST(CASE WHEN mail AND phone AND web THEN 100 WHEN mail AND phone THEN 70 WHEN mail THEN 40 ELSE 0 END AS INTEGER) AS contact,
    CAST(least(100, k % 6 * 50) AS INTEGER) AS cert FROM need LEFT JOIN hits USING (cv_id) LEFT JOIN gaps USING (cv_id) LEFT JOIN hop USING (cv_id)),
  sc AS (SELECT *, CAST(CASE WHEN len(req) = 0 THEN greatest(k % 6 * 25, 50) ELSE round_even(cov, 0) END AS INTEGER) AS skills FROM parts),
  fin AS (SELECT *, CASE WHEN mail THEN CAST(least(100, greatest(0, round_even(exp * 0.4::DOUBLE + ed * 0.2::DOUBLE + skills * 0.3::DOUBLE + contact * 0.1::DOUBLE, 0))) AS INTEGER) ELSE 0 END AS overall FROM sc),
  flags AS (SELECT cv_id, job_id, unnest(list_filter([
    CASE WHEN NOT mail THEN 'MISSING_EMAIL/High' END, CASE WHEN mail AND NOT phone THEN 'MISSING_PHONE/Low' END, CASE WHEN mail AND len(req) > 0 AND cov < 50 THEN 'SKILL_MISMATCH/Medium' END,
    CASE WHEN mail AND gap IS NOT NULL THEN 'EMPLOYMENT_GAP/Medium' END, CASE WHEN mail AND hopping THEN 'JOB_HOPPING/Low' END], lambda q: q IS NOT NULL)) AS f FROM fin)"""

_LINES = "WITH l AS (SELECT c_custkey AS doc_id, c_mktsegment, [" + ", ".join(LINES) + """] AS a FROM customer),
  nb AS (SELECT doc_id, list_filter(a, lambda q: trim(q) <> '') AS b FROM l),
  ln AS (SELECT doc_id, i - 1 AS i, b[i] AS x FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM nb)),
  hd AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)^\\s*(EXPERIENCIA|EXPERIENCE)\\s*[.:]*\\s*$') THEN 'work' WHEN regexp_matches(x, '(?i)^\\s*(EDUCATION|FORMACIÓN)\\s*[.:]*\\s*$') THEN 'education'
    WHEN regexp_matches(x, '(?i)^\\s*SKILLS\\s*[.:]*\\s*$') THEN 'skills' WHEN regexp_matches(x, '(?i)^\\s*(IDIOMAS|PROYECTOS)\\s*[.:]*\\s*$') THEN 'generic' END AS kind FROM ln),
  bounds AS (SELECT doc_id, kind, i AS s, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), total) AS e FROM hd JOIN (SELECT doc_id, len(b) AS total FROM nb) USING (doc_id) WHERE kind IS NOT NULL)"""
_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_TEL = r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{2,4}(?:[\s\-]?\d{2,4}){1,2}"

ORACLES = {
    "x9_words_to_lines": """WITH RECURSIVE w AS (SELECT l_orderkey // 100 AS doc_id, l_suppkey % 3 AS page, l_extendedprice % 600 AS x, -CAST(l_partkey % 700 AS DOUBLE) AS ny,
          'w' || l_orderkey || '_' || l_linenumber AS text FROM lineitem),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ny) AS rn FROM (SELECT DISTINCT doc_id, page, ny FROM w)),
        walk AS (SELECT doc_id, page, rn, ny, ny AS anchor, 0 AS line FROM s WHERE rn = 1
          UNION ALL SELECT s.doc_id, s.page, s.rn, s.ny, CASE WHEN s.ny - anchor > 2 THEN s.ny ELSE anchor END, CASE WHEN s.ny - anchor > 2 THEN line + 1 ELSE line END
          FROM walk k JOIN s ON s.doc_id = k.doc_id AND s.page = k.page AND s.rn = k.rn + 1)
        SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY x, text) AS text FROM w JOIN walk USING (doc_id, page, ny) GROUP BY doc_id, page, line""",
    "r1_tokens": f"SELECT doc_id, array_to_string({_tok('text')}, ' ') AS tokens FROM documents",
    "r2_experience_score": f"{_V2} SELECT cv_id, job_id, CAST(exp AS INTEGER) AS experience FROM parts",
    "r3_education_score": f"{_V2} SELECT cv_id, job_id, CAST(ed AS INTEGER) AS education_score FROM parts",
    "r4_skill_coverage": f"{_V2} SELECT cv_id, job_id, round(cov, 6) AS coverage, skills AS skills_score FROM sc",
    "r5_certification_score": "SELECT c_custkey AS cv_id, CAST(least(100, c_custkey % 6 * 50) AS INTEGER) AS certification_score FROM customer",
    "r6_contact_score": f"{_V2} SELECT cv_id, CAST(CASE WHEN mail AND phone AND web THEN 100 WHEN mail AND phone THEN 70 WHEN mail THEN 40 ELSE 0 END AS INTEGER) AS contact_score FROM cv",
    "r7_employment_gap": f"{_V2} SELECT cv_id, CAST(coalesce(gap, -1) AS INTEGER) AS gap_months FROM cv LEFT JOIN gaps USING (cv_id)",
    "r8_job_hopping": f"{_V2} SELECT cv_id, coalesce(hopping, false) AS hopping FROM cv LEFT JOIN hop USING (cv_id)",
    "r9_red_flags": f"{_V2} SELECT cv_id, job_id, split_part(f, '/', 1) AS code, split_part(f, '/', 2) AS severity FROM flags",
    "r9_prevalence": f"{_V2} SELECT split_part(f, '/', 1) AS code, split_part(f, '/', 2) AS severity, count(*) AS n FROM flags GROUP BY ALL",
    "r10_score_v2": f"""{_V2} SELECT cv_id, job_id, CASE WHEN mail THEN CAST(exp AS INTEGER) ELSE 0 END AS experience, CASE WHEN mail THEN CAST(ed AS INTEGER) ELSE 0 END AS education_score,
        CASE WHEN mail THEN least(skills, 100) ELSE 0 END AS skills_score, CASE WHEN mail THEN cert ELSE 0 END AS certification_score, contact AS contact_score, overall,
        CASE WHEN overall < 40 THEN 'Bajo' WHEN overall < 70 THEN 'Medio' ELSE 'Alto' END AS band FROM fin""",
    "r11_context_hash": f"""{_V2} SELECT cv_id, job_id, sha256(concat_ws('|', 'v2', CASE WHEN mail THEN 'c' || k || '@mail.org' ELSE 'none' END, coalesce(w, 0), CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END,
        1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, k % 6, title, array_to_string(list_sort(req), ','))) AS context_hash
        FROM pr LEFT JOIN (SELECT cv_id, count(*) AS w FROM job_rows GROUP BY cv_id) USING (cv_id)""",
    "x1_basics": f"""{_LINES}, e AS (SELECT doc_id, min(i) AS ei, arg_min(regexp_extract(x, '{_MAIL}'), i) AS email FROM ln WHERE regexp_matches(x, '{_MAIL}') GROUP BY doc_id),
        p AS (SELECT doc_id, min(i) AS pi, arg_min(regexp_extract(x, '{_TEL}'), i) AS phone FROM ln LEFT JOIN e USING (doc_id) WHERE regexp_matches(x, '{_TEL}') AND i IS DISTINCT FROM ei GROUP BY doc_id),
        u AS (SELECT doc_id, arg_min(rtrim(regexp_extract(x, 'https?://[^\\s,;]+'), '.,;'), i) AS url FROM ln WHERE regexp_matches(x, 'https?://') GROUP BY doc_id),
        n AS (SELECT doc_id, arg_min(trim(x), i) AS name FROM ln WHERE regexp_matches(trim(x), '^[A-ZÁÉÍÓÚÑ][a-záéíóúñ'']+(\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ'']+){{1,3}}$') GROUP BY doc_id)
        SELECT doc_id, coalesce(name, 'Unknown Candidate') AS name, coalesce(email, 'unknown@example.com') AS email, coalesce(phone, '') AS phone, coalesce(url, '') AS url
        FROM l LEFT JOIN e USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "x2_profiles": """SELECT c_custkey AS doc_id, CAST(o AS INTEGER) AS ord, network, url FROM (
        SELECT c_custkey, 0 AS o, 'GitHub' AS network, 'https://github.com/u' || c_custkey AS url FROM customer WHERE c_custkey % 2 = 1
        UNION ALL SELECT c_custkey, c_custkey % 2, 'LinkedIn', 'https://www.linkedin.com/in/u' || c_custkey FROM customer
        UNION ALL SELECT c_custkey, 1, 'GitHub', 'https://GitHub.com/u' || c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
    "x3_section_bounds": f'{_LINES} SELECT doc_id, kind, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM bounds',
    "x6_skills": f"""{_LINES}, body AS (SELECT b.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM bounds b JOIN ln ON ln.doc_id = b.doc_id AND i > s AND i < e WHERE kind = 'skills' GROUP BY b.doc_id),
        k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[,;•·]'), lambda q: trim(q)), lambda q: q <> '') AS ks FROM body)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, ks[i] AS name FROM (SELECT doc_id, ks, unnest(range(1, len(ks) + 1)) AS i FROM k)""",
    "x7_projects": """SELECT c_custkey AS doc_id, CAST(0 AS INTEGER) AS ord, 'Alpha' AS name, 'did it' AS highlights FROM customer WHERE c_custkey % 8 <> 0
        UNION ALL SELECT c_custkey, 1, 'Beta ' || c_custkey, '' FROM customer WHERE c_custkey % 8 <> 0""",
    "x8_confidence": f"""{_LINES}, e AS (SELECT doc_id, min(i) AS ei FROM ln WHERE regexp_matches(x, '{_MAIL}') GROUP BY doc_id),
        p AS (SELECT DISTINCT doc_id FROM ln LEFT JOIN e USING (doc_id) WHERE regexp_matches(x, '{_TEL}') AND i IS DISTINCT FROM ei),
        u AS (SELECT DISTINCT doc_id FROM ln WHERE regexp_matches(x, 'https?://'))
        SELECT doc_id, 'Inferred' AS name, 'Explicit' AS email, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 'Explicit' ELSE 'Inferred' END AS phone,
          CASE WHEN doc_id IN (SELECT doc_id FROM u) THEN 'Explicit' ELSE 'Inferred' END AS url, 'Explicit' AS profiles, '' AS warning FROM l""",
    "s3_parse_requests": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'structured' ELSE 'rejected' END AS kind,
        CASE p_partkey % 5 WHEN 0 THEN p_name || '/' || p_type WHEN 1 THEN p_name || '/' || p_type || '/' || p_brand || '/' || p_type WHEN 2 THEN 'ENGINE_VERSION_UNKNOWN' ELSE 'ENGINE_VERSION_MISSING' END AS value FROM part""",
    "s4_audit_uploads": """WITH f AS (SELECT '/landing/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.docx' END AS path, doc_id % 11 = 0 AS gone,
          CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE '' END AS magic, text FROM documents),
        k AS (SELECT path, CASE WHEN gone THEN 'VALIDATION_EMPTY' WHEN ends_with(path, '.txt') THEN 'UNSUPPORTED_MEDIA' WHEN magic = '' OR NOT ends_with(path, '.' || magic) THEN 'UNSUPPORTED_MIME' ELSE '' END AS error_code FROM f)
        SELECT path, error_code = '' AS ok, error_code FROM k""",
}
