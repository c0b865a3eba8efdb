"""Match cascade, both scoring engines, extraction and rewrite audit on small rows."""

from pyspark.sql import functions as F

from matchloom.functions.similarity import jaro_winkler_python
from matchloom.operators import audit, extract, match, score_v1, score_v2, vacancy


def test_requirement_weights(spark):
    df = spark.createDataFrame([("hard", "must", 1), ("tool", "nice", 1), ("hard", "must", 5)], "c string, s string, n int")
    got = [round(r[0], 6) for r in df.select(vacancy.requirement_weight(F.col("c"), F.col("s"), F.col("n"))).collect()]
    assert got == [1.2, 0.54, 1.56]


def test_cascade_tiers(spark):
    reqs = ["own", "up", "near", "lemma", "kubernetes", "gone", "postgresql"]
    need = spark.createDataFrame([(1, 1, r, {"lemma": "desarrollo"}.get(r, r)) for r in reqs],
                                 "cv_id long, job_id long, skill_id string, display string").select(
        "*", F.lit("hard").alias("category"), F.lit("must").alias("section"), F.lit(1.0).alias("weight"))
    placed = spark.createDataFrame([(1, "own", "Prominent", 1, 0, 0), (1, "child", "Prominent", 1, 0, 4), (1, "kin", "Prominent", 1, 0, 7)],
                                   "cv_id long, skill_id string, placement string, n long, first_ord int, first_pos int")
    edge = lambda rows: spark.createDataFrame(rows, "have string, want string")
    pair = lambda rows: spark.createDataFrame(rows, "a string, b string")
    edges = {"implied": edge([("child", "up")]), "related": edge([("kin", "near")]), "confusable": pair([("zz", "zzz")]),
             "confusable_terms": pair([("postgresql", "postgresqx")])}
    words = spark.createDataFrame([(1, ["desarrollar", "kuberneteq", "postgresqx"])], "cv_id long, words array<string>")
    proof = match.evidence(placed, edges, words, need)
    sets = vacancy.requirement_sets(need.drop("cv_id"))
    rows = match.match_rows(match.match_pairs(need.select("cv_id", "job_id").distinct(), proof, sets)).collect()
    got = {r["skill_id"]: (r["tier"], r["placement"], round(r["credit"], 4)) for r in rows}
    fuzzy = round(0.85 * jaro_winkler_python("kubernetes", "kuberneteq") * 0.6, 4)
    assert got == {"own": ("Exact", "Prominent", 1.0), "up": ("Alias", "Prominent", 1.0), "near": ("Related", "Prominent", 0.5),
                   "lemma": ("Lemma", "Buried", 0.51), "kubernetes": ("Fuzzy", "Buried", fuzzy), "gone": ("None", "NotFound", 0.0),
                   "postgresql": ("None", "NotFound", 0.0)}


def _signals(spark, **over):
    base = dict(has_contact=True, has_experience=True, action_verbs=5, quantified=3, word_count=300, max_repetition=0,
                sections_present=["education", "experience", "skills", "summary"])
    base.update(over)
    schema = "has_contact boolean, has_experience boolean, action_verbs int, quantified int, word_count int, max_repetition int, sections_present array<string>"
    return spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)


def test_components(spark):
    value = lambda df, col: round(df.select(col).first()[0], 6)
    assert value(_signals(spark), score_v1.structure_value()) == 1.0
    assert value(_signals(spark, has_contact=False, sections_present=["education", "experience", "skills"]), score_v1.structure_value()) == 0.5
    assert value(_signals(spark, has_contact=False, has_experience=False, sections_present=["education", "skills"]), score_v1.structure_value()) == 0.4
    assert value(_signals(spark), score_v1.achievement_value()) == 1.0
    assert value(_signals(spark, max_repetition=8), score_v1.length_value()) == 0.7
    codes = _signals(spark, max_repetition=8, has_contact=False).select(F.transform(score_v1.gates(), lambda g: g["code"])).first()[0]
    assert codes == ["no-contact", "partial-measurement", "keyword-stuffing"]


def test_overall(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0.75, 1.0)], "match double, structure double, achievements double, format double, length double")
    row = score_v1.overall_v1(df).first()
    assert (row["overall"], row["band"]) == (99, "Fuerte")


CV = ("basics struct<email:string,phone:string,url:string>, work array<struct<name:string,position:string,start:string,end:string>>, "
      "education array<struct<institution:string,area:string,study_type:string>>, skills array<struct<name:string>>, "
      "certificates array<struct<name:string>>, title string, requirements array<string>, cv_id long, job_id long")


def _pair(spark, work=(), email="a@b.co", skills=(), need=(), certificates=0):
    row = ((email, "300 555 0101", "https://x.co"), list(work), [], [(s,) for s in skills], [("c",)] * certificates, "Dev", list(need), 1, 1)
    return score_v2.score_v2(spark.createDataFrame([row], CV)).first()


def test_score_v2(spark):
    zero = _pair(spark, email="nope")
    assert (zero["overall"], zero["band"], [f["code"] for f in zero["red_flags"]], zero["contact_score"]) == (0, "Bajo", ["MISSING_EMAIL"], 0)
    gap = _pair(spark, [("a", "x", "2020-01", "2022-03"), ("b", "x", "2023-05", "2024-12")])
    assert gap["gap_months"] == 14
    assert _pair(spark, [("a", "x", "2020-01", "2022-03"), ("b", "x", "2022-09", None)])["gap_months"] is None
    hop = _pair(spark, [("a", "x", m, None) for m in ("2023-01", "2023-06", "2024-01", "2024-05")])
    assert hop["hopping"] is True
    part = _pair(spark, skills=["a b c d e"], need=["a b c d e f g h"])
    assert part["skills_score"] == 62
    many = _pair(spark, certificates=5)
    assert many["skills_score"] == 100 and many["overall"] == 60  # 30*.4 + 0 + 125*.3 + 100*.1 = 59.5, half to even


def test_work_and_education_blocks(spark):
    lines = ["EXPERIENCE", "Acme · Engineer · 2020 - 2022", "Did a", "Did b", "", "Lead", "2010 - present", "EDUCATION", "Uni · Law · Hons", "2001 - 2005", "SKILLS", "C#, SQL; Docker"]
    docs = spark.createDataFrame([(1, lines)], "doc_id long, lines array<string>")
    pdf = extract.extract_work(docs).collect()
    assert [(r["name"], r["position"], r["start"], r["end"], r["summary"], r["highlights"]) for r in pdf] == [
        ("Acme", "Engineer", "2020-01", "2022-12", "Did a", ["Did b", "Lead"])]
    docx = extract.extract_work(docs, layout="docx").collect()
    assert [(r["name"], r["position"], r["start"], r["end"], r["highlights"]) for r in docx] == [
        ("Acme", "Engineer", "2020-01", "2022-12", ["Did a", "Did b"]), ("Unknown", "Lead", "2010-01", None, [])]
    edu = extract.extract_education(docs).first()
    assert (edu["institution"], edu["area"], edu["start"], edu["end"]) == ("Uni", "Law · Hons", "2001-01", "2005-12")
    assert [r["name"] for r in extract.extract_skills(docs).orderBy("ord").collect()] == ["C#", "SQL", "Docker"]


def test_words_to_lines_moves_anchor_per_line(spark):
    words = [(1, 1, 10.0, 100.0, "a"), (1, 1, 5.0, 98.5, "b"), (1, 1, 7.0, 97.5, "c"), (1, 1, 1.0, 95.4, "d")]
    df = spark.createDataFrame(words, "doc_id long, page int, x double, y double, text string")
    # 97.5 is within 2 of the word before it but not of the first word of the line.
    assert [r["text"] for r in extract.words_to_lines(df).orderBy("line").collect()] == ["b a", "c", "d"]


def test_rewrite_audit(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    before = audit.extract_entities(docs([(1, "Python en Acme"), (2, "x"), (3, "x"), (4, "python")]))
    after = audit.extract_entities(docs([(1, "PYTHON en Globex"), (2, "Docker Redis"), (3, "Docker Redis AWS"), (4, "Python")]))
    invented = audit.inventions(before, after)
    ids = spark.range(1, 5).withColumnRenamed("id", "doc_id")
    assert {r["doc_id"]: r["severity"] for r in audit.severity(ids, invented).collect()} == {1: "Critical", 2: "Warning", 3: "Critical", 4: "None"}
    assert {r["doc_id"]: r["can_export"] for r in audit.export_gate(ids, invented).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_best_of_n(spark):
    rows = [("r", 1, 60, True), ("r", 2, 80, True), ("r", 3, 80, True), ("r", 4, 99, False), ("s", 1, 0, False), ("t", 1, 40, True)]
    steps = spark.createDataFrame(rows, "request_id string, step int, score int, passed boolean")
    requests = spark.createDataFrame([("r", 4, 50, 10), ("s", 1, 50, 10), ("t", 1, 50, 400)], "request_id string, iteration_count int, threshold int, elapsed_seconds int")
    got = {r["request_id"]: (r["best_step"], r["status"], r["low_score_warning"], r["partial"]) for r in audit.run_status(steps, requests).collect()}
    assert got == {"r": (2, "Completed", False, False), "s": (None, "Failed", False, False), "t": (1, "TimedOut", True, True)}
