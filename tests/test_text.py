"""Text operators on small rows, and similarity joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchloom.functions import similarity as sim
from matchloom.functions import text as tx
from matchloom.functions.wordlists import CV_HEADERS
from matchloom.operators import lexicon as lx
from matchloom.operators import similar, text
from matchloom.sources.lexicon import lexicon_from_skills


def norm(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["norm"] for r in text.normalize_corpus(df).orderBy("doc_id").collect()]


def test_normalize(spark):
    assert norm(spark, "Uso C# y Node.js.", "Año Útil", "   ", "CI/CD, (C++)  Objective-C!", "ﬁn Ⅳ ｆｏｏ", "Ж и ñandú ½", "ç# y abc#d") == [
        "uso c# y node.js", "año util", "", "ci/cd c++ objective-c", "fin iv foo", "ж и ñandu 1 2", "c y abc#d"]


def test_latin_folding_equals_exact_folding(spark):
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(32, 0x250)] + list("....##++//--c.netjsaspvue ")
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.filter(tx.is_latin(F.col("t"))).select("t", tx.fold_latin(F.col("t")).alias("f")).collect()
    assert rows and all(
        [w for w in __import__("re").split(r"[^\w-]|_", r["f"]) if w]
        == [w for w in __import__("re").split(r"[^\w-]|_", tx.fold_python(r["t"])) if w] for r in rows if not any(c in r["t"] for c in "²³¹"))


def test_stem(spark):
    words = ["desarrollando", "sol", "soles", "implementaciones", "ando", "gestionamientos"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r["token"]: r["stem"] for r in text.stem_vocabulary(df).collect()}
    assert got == {w: tx.stem_python(w) for w in words}
    assert got["desarrollando"] == "desarroll" and got["sol"] == "sol"


def test_sections_drop_header_line(spark):
    body = "Ana\nSkills: C#, SQL\nSQL avanzado\nExperiencia laboral\nlideré 3 equipos\nperfil que describe una larga vida profesional"
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    rows = [(r["ord"], r["label"], r["body"]) for r in text.split_sections(df, CV_HEADERS).orderBy("ord").collect()]
    assert rows == [(0, "header", "Ana"), (1, "skills", "SQL avanzado"),
                    (2, "experience", "lideré 3 equipos\nperfil que describe una larga vida profesional")]


def test_detect_headers_offsets_and_repair(spark):
    plain = "Ana\nEXPERIENCIA\nuno\nSKILLS:\ndos"
    glued = "Ana Perez EXPERIENCIA Acme SKILLS C#"
    df = spark.createDataFrame([(1, plain), (2, glued), (3, "nada")], "doc_id long, text string")
    rows = {(r["doc_id"], r["heading"]): r for r in text.detect_headers(df).collect()}
    assert set(rows) == {(1, "EXPERIENCIA"), (1, "SKILLS"), (2, "EXPERIENCIA"), (2, "SKILLS")}
    first, second = rows[(1, "EXPERIENCIA")], rows[(1, "SKILLS")]
    assert plain[first["start"]:first["end"]].strip() == "uno" and plain[second["start"]:second["end"]] == "\ndos"
    assert second["end"] == len(plain)
    assert [r["doc_id"] for r in text.section_warnings(df).collect()] == [3]


def test_signals(spark):
    df = spark.createDataFrame([(1, "ana@x.org\nLideré 5 proyectos\nLideré mucho"), (2, "nada")], "doc_id long, text string")
    one, two = text.document_signals(df).orderBy("doc_id").collect()
    assert (one["has_contact"], one["has_experience"], one["action_verbs"], one["quantified"], one["word_count"]) == (True, False, 2, 1, 8)
    assert (two["has_contact"], two["action_verbs"], two["word_count"]) == (False, 0, 1)


@pytest.mark.parametrize("raw, clean", [
    ("mail ana@x.org ya", "mail [EMAIL_REDACTED] ya"),
    ("tel +57 300 555 0101.", "tel [PHONE_REDACTED]."),
    ("ver https://www.linkedin.com/in/a y https://linkedin.com.evil.io/x", "ver https://www.linkedin.com/in/a y [URL_REDACTED]"),
    ("uno\nvivo en Calle 5, piso\ndos", "uno\n[ADDRESS_REDACTED]\ndos"),
    ('{"a":"calle 5, x"}', '{"a":"[ADDRESS_REDACTED], x"}'),
])
def test_redact(spark, raw, clean):
    ok, bad = text.redact(spark.createDataFrame([(raw,)], "t string"), ["t"])
    assert ok.first()["t"] == clean and bad.count() == 0


def test_redact_rejects_long_text(spark):
    ok, bad = text.redact(spark.createDataFrame([("x" * 100_001,)], "t string"), ["t"])
    assert ok.count() == 0 and bad.first()["error_code"] == "redaction_failure"


def test_quarantine(spark):
    df = spark.createDataFrame([("fine",), ("please IGNORE previous",), ("a​b",), ("tab\there",)], "t string")
    clean, bad = text.quarantine(df, ["t"])
    assert clean.count() == 1 and bad.count() == 3


def test_scan_longest_first_and_first_entry_wins(spark):
    skills = spark.createDataFrame(
        [(0, "asp", "ASP.NET Core", "hardSkill", [], [], [], [], []), (1, "net", ".NET", "hardSkill", ["dotnet"], [], [], [], []),
         (2, "dup", "dotnet", "tool", [], [], [], [], [])],
        "entry_ord int, id string, canonical string, category string, aliases array<string>, implies array<string>, "
        "related array<string>, broader array<string>, confusableWith array<string>")
    index = lx.lexicon_index(lexicon_from_skills(skills, "1"))
    docs = spark.createDataFrame([(1, "ASP.NET Core y .NET, dotnet")], "doc_id long, text string")
    hits = lx.scan_skills(lx.sections_of(docs, CV_HEADERS, "header", "doc_id"), index).collect()
    assert {(h["skill_id"], h["n"]) for h in hits} == {("asp", 1), ("net", 2)}


def _words(seed, n, alphabet="abcde", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_jaro_winkler_join_misses_nothing(spark):
    left, right = _words(1, 150), _words(2, 600)
    want = {(a, b) for a in left for b in right if sim.jaro_winkler_python(a, b) >= 0.92}
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    got = {(r["a"], r["b"]) for r in similar.similar_terms(mk(left), mk(right), "jaro_winkler", 0.92).collect()}
    assert got == want and len(want) > 50
    assert round(sim.jaro_winkler_python("kubernetes", "kubernets"), 2) == 0.98


def test_jaro_winkler_join_of_long_words(spark):
    rng = random.Random(5)
    left = [*_words(6, 30, "abcdef", 30), *("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (41, 60, 90, 200))]
    right = [w[:i] + rng.choice("abx") + w[i + rng.randint(0, 2):] for w in left for i in (1, len(w) // 2, len(w) - 1)] + ["ab" * 5000]
    want = {(a, b) for a in left for b in set(right) if abs(len(a) - len(b)) < 500 and sim.jaro_winkler_python(a, b) >= 0.92}
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    got = {(r["a"], r["b"]) for r in similar.similar_terms(mk(left), mk(right), "jaro_winkler", 0.92).collect()}
    assert got == want and any(len(a) >= 90 for a, _ in want)
    assert len(sim.jaro_winkler_keys("abcdefghij" * 16, 0.92, range(1, 400))) < 20_000
    assert not spark.createDataFrame([(10_000,)], "n int").filter(sim.in_reach(F.col("n"), F.lit(30), 0.92)).count()


def test_jaro_winkler_join_at_low_thresholds(spark):
    """Words much longer than their partners are in reach there."""
    left = [*_words(8, 40, "abcd", 6), "abcd", "abcde"]
    right = [*_words(9, 60, "abcd", 6), *(w + "xyzw" * 9 for w in left[-2:]), *("abcd" + "q" * n for n in range(40)), *("abcde" + "q" * n for n in range(50))]
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    for threshold in (0.82, 0.85):
        want = {(a, b) for a in left for b in right if sim.jaro_winkler_python(a, b) >= threshold}
        got = {(r["a"], r["b"]) for r in similar.similar_terms(mk(left), mk(right), "jaro_winkler", threshold).collect()}
        assert got == want
        if threshold == 0.82:
            assert any(len(b) > 4 * len(a) + 4 for a, b in want)


def test_levenshtein_join_misses_nothing(spark):
    left, right = _words(3, 60, "abc", 6), _words(4, 200, "abc", 8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(a, b) for a in left for b in right if distance(a, b) <= 2}
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    assert {(r["a"], r["b"]) for r in similar.similar_terms(mk(left), mk(right), "levenshtein", 2).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bound_of_jaro_winkler_is_never_below_it(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aabeñ0-") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    pairs = spark.createDataFrame([(rng.choice(words), rng.choice(words)) for _ in range(3000)], "a string, b string")
    bits = pairs.withColumns({"_a": sim.signature("a"), "_b": sim.signature("b")})
    rows = bits.select("a", "b", sim.jaro_winkler_bound("a", "b", "_a", "_b").alias("most")).collect()
    assert all(r["most"] >= sim.jaro_winkler_python(r["a"], r["b"]) - 1e-9 for r in rows)
    assert sum(r["most"] < 0.92 for r in rows) > 1000


def test_pairs_are_scored_once_in_even_tasks(spark):
    """A filter on the score must not slip below the step that makes pairs distinct, nor a shuffle be left out."""
    words = spark.createDataFrame([("reactor",), ("reaction",)], "token string")
    plan = _plan(similar.similar_terms(words, words.distinct(), "jaro_winkler", 0.92))
    assert plan.count("jaro_winkler(") == plan.count("ArrowEvalPython [jaro_winkler(") == 1
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_words_meet_in_packs(spark):
    """No row per word and key, of which a word had a hundred: packs of words meet, and each pair comes out once."""
    left, right = _words(11, 400, "abcdeñ", 12), [*_words(12, 9000, "abcdeñ", 12), "\U0001f600ab", "x" * 300]
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    pairs = similar.similar_terms(mk(left), mk(right), "jaro_winkler", 0.92)
    assert "Generate explode" not in _plan(pairs) and "MapInArrow packed" in _plan(pairs)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(set(got)) == len(got) and set(got) == {(a, b) for a in left for b in right if sim.jaro_winkler_python(a, b) >= 0.92}


def test_headers_are_found_behind_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "EXPERIENCE\nwork"), (2, "none")], "doc_id long, text string").hint("rebalance", "doc_id")
    lines = _plan(text.detect_headers(docs)).splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "REBALANCE" in line)
    assert [i for i, line in enumerate(lines) if "RLIKE" in line] and not any("RLIKE" in line for line in lines[shuffle:])


@pytest.mark.parametrize(("query", "narrow"), [("x1_basics", "customer"), ("x4_work", "customer"), ("x4_work_docx", "customer"), ("t9_validate_job_specs", "part")])
def test_costly_expressions_on_narrow_tables_run_in_even_tasks(spark, tmp_path, query, narrow):
    key, kinds = {"customer": ("c_custkey", "c_name string, c_mktsegment string"), "part": ("p_partkey", "p_name string, p_brand string, p_type string, p_size int")}[narrow]
    row = (1, "Ana Gil", "shop") if narrow == "customer" else (1, "name", "brand", "type", 3)
    spark.createDataFrame([row], f"{key} long, {kinds}").write.parquet(str(tmp_path / f"{narrow}.parquet"))
    lines = _plan(entry.queries()[query](spark, str(tmp_path))).splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    assert any("Project" in line for line in lines[:shuffle]) and not any("Project" in line for line in lines[shuffle:])
