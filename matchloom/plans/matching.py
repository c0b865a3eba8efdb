"""Match cascade and text scoring queries (M1-M7, C1-C11, flagship)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import FUZZY_THRESHOLD
from ..operators import lexicon as lx
from ..operators import match, score_v1, text, vacancy
from . import common as c


SIGNALS = ["has_contact", "has_experience", "action_verbs", "quantified", "word_count", "sections_present"]


def worked_out(cvs, signals: bool = True):
    """All of a document, worked out in one pass and kept without its text: ``(cv_id, signals, words, sections)``."""
    folded = tx.with_folded(cvs, "text", "folded").withColumn("norm", tx.normalized(F.col("folded")))
    cut = text.with_sections(folded, c.HEADERS, "header")
    rows = text.with_signals(cut, c.VERBS, norm="norm") if signals else cut
    parts = F.transform("sections", lambda s: F.struct(s["ord"].alias("ord"), s["label"].alias("label"), s["folded"].alias("folded")))
    return rows.select("cv_id", *(SIGNALS if signals else []), F.array_distinct(tx.words(F.col("norm"))).alias("words"), parts.alias("sections"))


class Inputs:
    """Tables of the flagship, each derived once per query from the generated data. ``docs`` are documents that were worked
    out and stored before, in place of all; only their pairs are scored then."""

    def __init__(self, spark, sf: str, signals: bool = True, docs=None):
        self.lexicon = c.lexicon(spark, sf)
        index = lx.lexicon_index(self.lexicon)
        self.edges = lx.lexicon_edges(self.lexicon, c.CONFUSABLE)
        # Documents and placement, from which most steps start, are kept on disk, so that memory is left to joins and
        # sorts; nothing runs here.
        self.docs = docs if docs is not None else worked_out(c.cvs(spark, sf), signals).persist(StorageLevel.DISK_ONLY)
        sections = self.docs.select("cv_id", F.explode("sections").alias("s")).select("cv_id", "s.ord", "s.label", "s.folded")
        self.placement = lx.skill_placement(lx.scan_skills(sections, index, "cv_id"), "cv_id").persist(StorageLevel.DISK_ONLY)
        self.requirements = vacancy.extract_requirements(c.jobs(spark, sf), self.lexicon, c.VACANCY_HEADERS, index=index)
        self.pairs = c.pairs(spark, sf) if docs is None else c.pairs(spark, sf).join(docs.select("cv_id"), "cv_id", "left_semi")

    @property
    def words(self):
        return self.docs.select("cv_id", "words")

    @property
    def open(self):
        return match.open_requirements(self.pairs, self.requirements)

    def cv_rows(self):
        repetition = lx.max_repetition(self.placement, "cv_id")
        return self.docs.select("cv_id", *SIGNALS).join(repetition, "cv_id", "left").withColumn("max_repetition", F.coalesce("max_repetition", F.lit(0)))

    def matched(self, fuzzy: bool):
        proof = match.evidence(self.placement, self.edges, self.words, self.requirements, fuzzy)
        return match.match_pairs(self.pairs, proof, vacancy.requirement_sets(self.requirements))

    def scores(self, fuzzy: bool):
        return score_v1.score_pairs(self.matched(fuzzy), self.cv_rows(), c.LEXICON_VERSION)


def _r(name: str):
    return F.round(name, 6).alias(name)


def m1(spark, sf):
    i = Inputs(spark, sf, signals=False)
    return match.match_exact(i.open, i.placement)


def m2(spark, sf):
    i = Inputs(spark, sf, signals=False)
    return match.match_implied(i.open, i.placement, i.edges["implied"])


def m3(spark, sf):
    i = Inputs(spark, sf, signals=False)
    return match.match_related(i.open, i.placement, i.edges["related"])


def _stems(i):
    return i.words.select("cv_id", F.explode("words").alias("w")).select("cv_id", tx.stem(F.col("w")).alias("stem")).distinct()


def m4(spark, sf):
    i = Inputs(spark, sf, signals=False)
    return match.match_stem(i.open, _stems(i)).withColumn("credit", F.round("credit", 6))


def m5(spark, sf):
    i = Inputs(spark, sf, signals=False)
    held = i.words.select("cv_id", F.explode("words").alias("token"))
    return match.match_fuzzy(i.open, held, i.edges).withColumn("credit", F.round("credit", 6))


def m6(spark, sf):
    i = Inputs(spark, sf, signals=False)
    req = i.open
    tiers = [
        match.match_exact(req, i.placement),
        match.match_implied(req, i.placement, i.edges["implied"]),
        match.match_related(req, i.placement, i.edges["related"]),
        match.match_stem(req, _stems(i)),
    ]
    return match.resolve_cascade(req, tiers).select("cv_id", "job_id", "skill_id", "tier", "placement", _r("credit"))


def m7(spark, sf):
    rows = match.match_rows(Inputs(spark, sf, signals=False).matched(False))
    return rows.select("cv_id", "job_id", "skill_id", "tier", "placement", _r("weight"), _r("credit"))


def m7_fuzzy(spark, sf):
    rows = match.match_rows(Inputs(spark, sf, signals=False).matched(True))
    return rows.select("cv_id", "job_id", "skill_id", "tier", "placement", _r("weight"), _r("credit"))


def c1(spark, sf):
    i = Inputs(spark, sf, signals=False)
    return score_v1.match_score(match.match_rows(i.matched(False)), i.pairs).select("cv_id", "job_id", _r("match"), "match_confidence")


def c2(spark, sf):
    rows = Inputs(spark, sf).cv_rows()
    codes = F.array_join(F.transform(score_v1.gates(), lambda g: g["code"]), ",")
    return score_v1.structure_score(rows).select("cv_id", _r("structure"), codes.alias("gates"))


def c3(spark, sf):
    return score_v1.achievement_score(Inputs(spark, sf).cv_rows()).select("cv_id", _r("achievements"))


def c4(spark, sf):
    return score_v1.format_score(c.cvs(spark, sf)).select("cv_id", "format", "format_measurability")


def c5(spark, sf):
    return score_v1.length_score(Inputs(spark, sf).cv_rows()).select("cv_id", _r("length"))


def c6(spark, sf):
    return Inputs(spark, sf).scores(False).select("cv_id", "job_id", "overall", "band")


def c7(spark, sf):
    rows = Inputs(spark, sf).scores(False)

    def ids(name):
        return F.array_join(F.transform(name, lambda k: F.concat_ws("/", k["skill_id"], k["note"])), ",").alias(name)

    return rows.select("cv_id", "job_id", ids("present"), ids("partial"), ids("missing"))


def c8(spark, sf):
    rows = Inputs(spark, sf).scores(False).select("cv_id", "job_id", F.posexplode("recommendations").alias("rank", "r"))
    return rows.select("cv_id", "job_id", "rank", "r.kind", "r.component", "r.gain", "r.term")


def c9(spark, sf):
    rows = score_v1.format_issues(Inputs(spark, sf).cv_rows())
    return rows.select("cv_id", F.array_join(F.transform("format_issues", lambda i: F.concat_ws("/", i["code"], i["severity"])), ",").alias("issues"))


def c10(spark, sf):
    rows = Inputs(spark, sf).scores(False)
    return rows.select("cv_id", "job_id", "overall", "band", _r("match"), _r("structure"), _r("achievements"), "format",
                       _r("length"), "covered", "n_requirements", "engine_version", "lexicon_version", "context_hash")


def c11(spark, sf):
    return score_v1.report_v1(Inputs(spark, sf).scores(False))


def c11_keywords(spark, sf):
    rows = score_v1.keyword_report(Inputs(spark, sf).scores(False))
    return rows.withColumns({"weight": F.round("weight", 6), "credit": F.round("credit", 6)})


def c11_recommendations(spark, sf):
    return score_v1.recommendation_report(Inputs(spark, sf).scores(False))


def flagship(spark, sf):
    best = match.best_documents(Inputs(spark, sf).scores(True).select("cv_id", "job_id", "overall", "band", "covered", "n_requirements"))
    return best.select("job_id", "rank", "cv_id", "overall", "band", "covered", "n_requirements")


def flagship_strict(spark, sf):
    best = match.best_documents(Inputs(spark, sf).scores(False).select("cv_id", "job_id", "overall", "band", "covered", "n_requirements"))
    return best.select("job_id", "rank", "cv_id", "overall", "band", "covered", "n_requirements")


QUERIES = {
    "m1_match_exact": m1, "m2_match_implied": m2, "m3_match_related": m3, "m4_match_stem": m4, "m5_match_fuzzy": m5,
    "m6_resolve_cascade": m6, "m7_match_pairs": m7, "m7_match_pairs_fuzzy": m7_fuzzy,
    "c1_match_score": c1, "c2_structure_score": c2, "c3_achievement_score": c3, "c4_format_score": c4,
    "c5_length_score": c5, "c6_overall": c6, "c7_classify_keywords": c7, "c8_recommend": c8, "c9_format_issues": c9,
    "c10_score_pairs": c10, "c11_report": c11, "c11_keyword_report": c11_keywords, "c11_recommendation_report": c11_recommendations,
    "flagship_top_documents": flagship, "flagship_top_documents_strict": flagship_strict,
}

_SECT = c.sql_sections("cvs", "cv_id", c.HEADERS, "header")
_JSECT = c.sql_sections("jobs", "job_id", c.VACANCY_HEADERS, "title", "_j")
_VERBS = "[" + ", ".join(f"'{s}'" for s in sorted({tx.stem_python(v) for v in c.VERBS})) + "]"

_BASE = f"""WITH {c.SQL_SKILLS}, {c.SQL_PATTERN}, {c.SQL_CVS}, {c.SQL_JOBS}, {_SECT}, {_JSECT},
    {c.sql_hits('cv_id', 'sects', 'cv_hits')}, {c.sql_hits('job_id', 'sects_j', 'job_hits')},
    {c.SQL_PLACEMENT}, {c.SQL_REQUIREMENTS}, {c.SQL_PAIRS},
    opened AS (SELECT cv_id, job_id, skill_id, display, category, section, weight FROM pairs JOIN reqs USING (job_id)),
    implied AS (SELECT skill_id AS have, implies AS want FROM skills),
    related AS (SELECT skill_id AS have, related AS want FROM skills UNION SELECT related, skill_id FROM skills
      UNION SELECT implies, skill_id FROM skills),
    stems AS (SELECT DISTINCT cv_id, {c.sql_stem('t')} AS stem FROM (SELECT cv_id, unnest(w) AS t FROM lines)),
    tier0 AS (SELECT o.cv_id, o.job_id, o.skill_id, 'Exact' AS tier, placement, 1.0::DOUBLE AS raw
      FROM opened o JOIN placed p ON p.cv_id = o.cv_id AND p.skill_id = o.skill_id),
    tier1 AS (SELECT o.cv_id, o.job_id, o.skill_id, 'Alias' AS tier, arg_min(placement, first_at) AS placement, 1.0::DOUBLE AS raw
      FROM opened o JOIN implied ON want = o.skill_id JOIN placed p ON p.cv_id = o.cv_id AND p.skill_id = have GROUP BY ALL),
    tier2 AS (SELECT o.cv_id, o.job_id, o.skill_id, 'Related' AS tier, arg_min(placement, first_at) AS placement, 0.5::DOUBLE AS raw
      FROM opened o JOIN related ON want = o.skill_id JOIN placed p ON p.cv_id = o.cv_id AND p.skill_id = have GROUP BY ALL),
    tier3 AS (SELECT o.cv_id, o.job_id, o.skill_id, 'Lemma' AS tier, 'Buried' AS placement, 0.85::DOUBLE AS raw
      FROM opened o JOIN stems s ON s.cv_id = o.cv_id AND s.stem = {c.sql_stem("display")}),
    tiers AS (SELECT *, raw * CASE placement WHEN 'Prominent' THEN 1.0 ELSE 0.6 END AS credit FROM (
      SELECT 0 AS r, * FROM tier0 UNION ALL SELECT 1, * FROM tier1 UNION ALL SELECT 2, * FROM tier2 UNION ALL SELECT 3, * FROM tier3)),
    matches AS (SELECT o.*, coalesce(m.tier, 'None') AS tier, coalesce(m.placement, 'NotFound') AS placement, coalesce(m.credit, 0) AS credit
      FROM opened o LEFT JOIN (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY cv_id, job_id, skill_id ORDER BY r) = 1) m
      ON m.cv_id = o.cv_id AND m.job_id = o.job_id AND m.skill_id = o.skill_id)"""

def _fuzzy(sql: str) -> str:
    """A statement over the cascade of :data:`_BASE` with its fifth tier: the best similar word a CV holds."""
    tier = f"""wanted AS (SELECT DISTINCT skill_id, {c.sql_norm('display')} AS a FROM reqs),
    held AS (SELECT DISTINCT cv_id, t AS b FROM (SELECT cv_id, unnest(w) AS t FROM lines)),
    word_pairs AS (SELECT a, b, translate(a, 'ñßœæªº', '!$%&*^') AS s, translate(b, 'ñßœæªº', '!$%&*^') AS t
      FROM (SELECT DISTINCT a FROM wanted), (SELECT DISTINCT b FROM held)),
    {c.sql_jaro_winkler('word_pairs', FUZZY_THRESHOLD)},
    tier4 AS (SELECT o.cv_id, o.job_id, o.skill_id, 'Fuzzy' AS tier, 'Buried' AS placement, 0.85::DOUBLE * max(score) AS raw
      FROM opened o JOIN wanted USING (skill_id) JOIN held USING (cv_id) JOIN alike USING (a, b)
      WHERE (least(a, b), greatest(a, b)) NOT IN (VALUES {", ".join(f"('{min(x)}', '{max(x)}')" for x in c.CONFUSABLE)})
        AND NOT EXISTS (SELECT 1 FROM skills k WHERE (k.skill_id = o.skill_id AND k.confusable = b) OR (k.skill_id = b AND k.confusable = o.skill_id))
      GROUP BY o.cv_id, o.job_id, o.skill_id),
    tiers AS ("""
    for old, new in (("WITH ", "WITH RECURSIVE "), ("tiers AS (", tier), ("SELECT 3, * FROM tier3", "SELECT 3, * FROM tier3 UNION ALL SELECT 4, * FROM tier4")):
        if old not in sql:
            raise ValueError(f"no {old!r} in the statement")
        sql = sql.replace(old, new, 1)
    return sql


_SIGNALS = f""",
    present_labels AS (SELECT cv_id, list(DISTINCT label) FILTER (WHERE label NOT IN ('header', 'other')) AS present FROM sects GROUP BY cv_id),
    verb_lines AS (SELECT cv_id, line, len(w) AS n_words,
      len(list_filter(w, lambda x: list_contains({_VERBS}, {c.sql_stem('x')}))) AS n_verbs FROM lines),
    verb_counts AS (SELECT cv_id, sum(n_verbs) AS action_verbs, sum(n_words) AS word_count,
      count(*) FILTER (WHERE n_verbs > 0 AND regexp_matches(line, '\\pN')) AS quantified FROM verb_lines GROUP BY cv_id),
    signals AS (SELECT d.cv_id, coalesce(present, []) AS present, action_verbs, word_count, quantified, coalesce(rep, 0) AS rep,
      regexp_matches(text, '[\\pL\\pN_.\\-+]+@[\\pL\\pN_\\-]+\\.[\\pL\\pN_.\\-]+') OR regexp_matches(text, '\\+?\\d[\\d \\-().]{{6,}}\\d')
        OR list_contains(coalesce(present, []), 'contact') AS has_contact,
      list_contains(coalesce(present, []), 'experience') OR regexp_matches(text, '(^|[^\\pL\\pN_])(19|20)\\d{{2}}([^\\pL\\pN_]|$)') AS has_experience
      FROM cvs d JOIN present_labels USING (cv_id) JOIN verb_counts USING (cv_id)
      LEFT JOIN (SELECT cv_id, max(n) AS rep FROM placed GROUP BY cv_id) USING (cv_id)),
    parts AS (SELECT *,
      least(CASE WHEN has_contact THEN 1.0 ELSE 0.5 END, CASE WHEN has_experience THEN 1.0 ELSE 0.4 END, least(1.0::DOUBLE,
        (list_contains(present, 'experience')::INT + list_contains(present, 'education')::INT + list_contains(present, 'skills')::INT) / 3.0::DOUBLE
        + CASE WHEN has_contact THEN 0.1 ELSE 0 END + CASE WHEN list_contains(present, 'summary') THEN 0.1 ELSE 0 END))::DOUBLE AS structure,
      0.5::DOUBLE * least(1, action_verbs / 5.0::DOUBLE) + 0.5::DOUBLE * least(1, quantified / 3.0::DOUBLE) AS achievements,
      (CASE WHEN word_count < 150 THEN 0.4 WHEN word_count < 250 THEN 0.7 WHEN word_count <= 900 THEN 1 WHEN word_count <= 1200 THEN 0.8 ELSE 0.6 END)::DOUBLE
        * (1 - CASE WHEN rep > 5 THEN least(0.5, (rep - 5) * 0.1) ELSE 0 END)::DOUBLE AS length FROM signals)"""

_SCORES = f"""{_BASE}{_SIGNALS},
    sums AS (SELECT cv_id, job_id, sum(weight * credit ORDER BY weight DESC, skill_id) AS got, sum(weight ORDER BY weight DESC, skill_id) AS total,
      count(*) AS n, count(*) FILTER (WHERE tier <> 'None') AS covered FROM matches GROUP BY cv_id, job_id),
    hashes AS (SELECT job_id, sha256(string_agg(skill_id || ':' || printf('%.2f', weight) || ':' ||
      CASE section WHEN 'must' THEN 'MustHave' WHEN 'title' THEN 'Title' WHEN 'resp' THEN 'Responsibility' ELSE 'NiceToHave' END,
      '|' ORDER BY skill_id)) AS context_hash FROM reqs GROUP BY job_id),
    full_pairs AS (SELECT p.cv_id, p.job_id, coalesce(n, 0) AS n, coalesce(covered, 0) AS covered,
      coalesce(least(greatest(got / total, 0), 1), 0)::DOUBLE AS match, coalesce(context_hash, sha256('')) AS context_hash,
      greatest(0.0001, coalesce(total, 0)) AS total, s.* EXCLUDE (cv_id)
      FROM pairs p LEFT JOIN sums USING (cv_id, job_id) LEFT JOIN hashes USING (job_id) JOIN parts s ON s.cv_id = p.cv_id),
    scored AS (SELECT *, CAST(round(100 * (0.45::DOUBLE * match + 0.2::DOUBLE * structure + 0.2::DOUBLE * achievements
        + 0.1::DOUBLE * 0.5 * 0.75 + 0.05::DOUBLE * length)
        / (0.45::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE * 0.5::DOUBLE + 0.05::DOUBLE)) AS INTEGER) AS overall FROM full_pairs),
    banded AS (SELECT *, CASE WHEN overall < 40 THEN 'Bajo' WHEN overall < 65 THEN 'Medio' WHEN overall < 85 THEN 'Bueno' ELSE 'Fuerte' END AS band FROM scored)"""


def _keywords(name: str, tiers: str) -> str:
    note = "CASE WHEN tier = 'None' THEN 'missing' WHEN placement = 'Buried' THEN 'low-visibility' ELSE 'direct' END"
    return f"coalesce(string_agg(skill_id || '/' || {note}, ',' ORDER BY weight DESC, skill_id) FILTER (WHERE tier IN ({tiers})), '') AS {name}"


_TOP = """SELECT job_id, CAST(rank AS INTEGER) AS rank, cv_id, overall, band, CAST(covered AS INTEGER) AS covered, CAST(n AS INTEGER) AS n_requirements FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, cv_id) AS rank FROM banded) WHERE rank <= 10"""

_RANKED = f"""{_SCORES},
        recs AS (
          SELECT m.cv_id, m.job_id, 'Learn' AS kind, 0 AS k, 'match' AS component, display AS term,
            greatest(1, CAST(round_even(weight / total * 100 * 0.45::DOUBLE, 0) AS INTEGER)) AS gain
          FROM matches m JOIN scored s ON s.cv_id = m.cv_id AND s.job_id = m.job_id WHERE tier = 'None'
          UNION ALL SELECT m.cv_id, m.job_id, 'Surface', 3, 'match', display,
            greatest(1, CAST(round_even(0.4::DOUBLE * weight / total * 100 * 0.45::DOUBLE, 0) AS INTEGER))
          FROM matches m JOIN scored s ON s.cv_id = m.cv_id AND s.job_id = m.job_id WHERE placement = 'Buried' AND tier IN ('Exact', 'Alias')
          UNION ALL SELECT cv_id, job_id, 'AddMetric', 2, 'achievements', '', 4 FROM scored WHERE quantified < 2
          UNION ALL SELECT cv_id, job_id, 'FixFormat', 1, 'structure', '', 3 FROM scored WHERE NOT has_contact),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_id, job_id ORDER BY gain DESC, k, term || '"') AS rn FROM recs) WHERE rn <= 8)"""

ORACLES = {
    "m1_match_exact": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, credit FROM tiers WHERE r = 0",
    "m2_match_implied": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, credit FROM tiers WHERE r = 1",
    "m3_match_related": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, credit FROM tiers WHERE r = 2",
    "m4_match_stem": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, round(credit, 6) AS credit FROM tiers WHERE r = 3",
    "m6_resolve_cascade": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, round(credit, 6) AS credit FROM matches",
    "m7_match_pairs": f"{_BASE} SELECT cv_id, job_id, skill_id, tier, placement, round(weight, 6) AS weight, round(credit, 6) AS credit FROM matches",
    "c1_match_score": f"""{_SCORES} SELECT cv_id, job_id, round(match, 6) AS match,
        CASE WHEN n >= 4 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS match_confidence FROM scored""",
    "c2_structure_score": f"""{_BASE}{_SIGNALS} SELECT cv_id, round(structure, 6) AS structure, concat_ws(',',
        CASE WHEN NOT has_contact THEN 'no-contact' END, CASE WHEN NOT has_experience THEN 'no-experience' END,
        'partial-measurement', CASE WHEN rep > 5 THEN 'keyword-stuffing' END) AS gates FROM parts""",
    "c3_achievement_score": f"{_BASE}{_SIGNALS} SELECT cv_id, round(achievements, 6) AS achievements FROM parts",
    "c4_format_score": "SELECT doc_id AS cv_id, 0.75::DOUBLE AS format, 0.5::DOUBLE AS format_measurability FROM documents",
    "c5_length_score": f"{_BASE}{_SIGNALS} SELECT cv_id, round(length, 6) AS length FROM parts",
    "c6_overall": f"{_SCORES} SELECT cv_id, job_id, overall, band FROM banded",
    "c7_classify_keywords": f"""{_BASE} SELECT p.cv_id, p.job_id, {_keywords('present', "'Exact', 'Alias'")},
        {_keywords('partial', "'Related', 'Lemma', 'Fuzzy'")}, {_keywords('missing', "'None'")}
        FROM pairs p LEFT JOIN matches m ON m.cv_id = p.cv_id AND m.job_id = p.job_id GROUP BY p.cv_id, p.job_id""",
    "c8_recommend": f"""{_RANKED} SELECT cv_id, job_id, CAST(rn - 1 AS INTEGER) AS rank, kind, component, gain, term FROM best""",
    "c9_format_issues": f"""{_BASE}{_SIGNALS} SELECT cv_id, concat_ws(',', CASE WHEN quantified < 2 THEN 'few-quantified-achievements/info' END,
        CASE WHEN NOT has_contact THEN 'missing-contact/warn' END) AS issues FROM parts""",
    "c10_score_pairs": f"""{_SCORES} SELECT cv_id, job_id, overall, band, round(match, 6) AS match, round(structure, 6) AS structure,
        round(achievements, 6) AS achievements, 0.75::DOUBLE AS format, round(length, 6) AS length, CAST(covered AS INTEGER) AS covered,
        CAST(n AS INTEGER) AS n_requirements, '1.0.0' AS engine_version, '{c.LEXICON_VERSION}' AS lexicon_version, context_hash FROM banded""",
    "c11_report": f"""{_SCORES}, parts_long AS (
          SELECT *, unnest(['match', 'structure', 'achievements', 'format', 'length']) AS component,
            unnest([match, structure, achievements, 0.75, length]) AS value, unnest([0.45, 0.2, 0.2, 0.1, 0.05]::DOUBLE[]) AS weight,
            unnest([1, 1, 1, 0.5, 1]::DOUBLE[]) AS measurability, unnest([CASE WHEN n >= 4 THEN 'high' ELSE 'medium' END, 'high', 'medium', 'low', 'high']) AS confidence
          FROM banded)
        SELECT cv_id, job_id, overall, CASE band WHEN 'Bajo' THEN 'low' WHEN 'Medio' THEN 'medium' WHEN 'Bueno' THEN 'high' ELSE 'very-high' END AS band_label,
          component, CAST(round(value * 100) AS INTEGER) AS points, weight, measurability, confidence FROM parts_long""",
    "c11_keyword_report": f"""{_BASE} SELECT cv_id, job_id,
        CASE WHEN tier IN ('Exact', 'Alias') THEN 'present' WHEN tier = 'None' THEN 'missing' ELSE 'partial' END AS list, skill_id,
        CASE category WHEN 'hard' THEN 'hardSkill' WHEN 'tool' THEN 'tool' WHEN 'soft' THEN 'softSkill' ELSE 'generic' END AS category,
        CASE section WHEN 'must' THEN 'requisitos' WHEN 'nice' THEN 'deseables' WHEN 'resp' THEN 'responsabilidades' ELSE 'titulo' END AS section,
        CASE tier WHEN 'Lemma' THEN 'stem' ELSE lower(tier) END AS match_level,
        CASE placement WHEN 'NotFound' THEN 'absent' ELSE lower(placement) END AS location,
        round(weight, 6) AS weight, round(credit, 6) AS credit,
        CASE WHEN tier = 'None' THEN 'missing' WHEN placement = 'Buried' THEN 'low-visibility' ELSE 'direct' END AS note FROM matches""",
    "c11_recommendation_report": f"""{_RANKED}, named AS (SELECT *,
          CASE kind WHEN 'Learn' THEN 'learnAdd' WHEN 'Surface' THEN 'resurface' WHEN 'AddMetric' THEN 'addMetric' ELSE 'fixFormat' END AS type FROM best)
        SELECT cv_id, job_id, CAST(rn AS INTEGER) AS rank, type, CASE WHEN term = '' THEN type ELSE type || ':' || term END AS action, component,
          gain AS estimated_gain, false AS invents, CASE kind WHEN 'Learn' THEN 'not-held' ELSE 'in-text' END AS honesty_note FROM named""",
    "flagship_top_documents_strict": f"{_SCORES} {_TOP}",
}
