"""What the matching queries keep between their steps, and how documents are dealt out."""

import re

from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.plans import audit, common, matching, streams
from matchloom.streaming import jobs


def tables(spark, folder):
    # the values differ, so that the file does not shrink to a few kilobytes
    text = "concat('alpha beta gamma\n', sha2(string(id), 512), ' delta ', sha2(string(-id), 512))"
    spark.range(40_000).selectExpr("id AS doc_id", f"{text} AS text").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.range(6).selectExpr("id AS item_id", "'alpha beta gamma delta' AS text").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_documents_come_in_more_tasks_as_they_grow(spark, tmp_path):
    sf, conf = tables(spark, tmp_path), {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        small = common.table(spark, sf, "documents").filter("doc_id < 4000").rdd.getNumPartitions()
        large = common.table(spark, sf, "documents").rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert small < large


def test_kept_tables_are_on_disk_and_without_texts(spark, tmp_path):
    kept = matching.Inputs(spark, tables(spark, tmp_path))
    for table in (kept.docs, kept.placement):
        assert table.storageLevel.useDisk and not table.storageLevel.useMemory
        table.unpersist()
    assert not {"text", "folded"} & set(kept.docs.columns)
    assert "body" not in kept.docs.schema["sections"].dataType.elementType.names


def test_streamed_scores_count_similar_words(spark, tmp_path):
    """The fifth tier of the cascade: a word that is nearly the one sought counts where no other tier finds anything."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, "kuberneteq and more"), (2, "nothing of it"), (3, "kubernetes")], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, "kubernete uses kubernetes")], "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    got = {r["cv_id"]: r["overall"] for r in streams.w7_scores(spark, sf).collect()}
    strict = {r["cv_id"]: r["overall"] for r in matching.c6(spark, sf).collect()}
    assert got == {r["cv_id"]: r["overall"] for r in matching.flagship(spark, sf).collect()}
    assert got[1] > strict[1] and got[2] == strict[2] and got[3] == strict[3] > got[1]


def test_documents_are_screened_once(spark):
    """One pass and one redaction, whatever the verdict."""
    rows = [(1, "call 300 123 4567 or mail a.b@c.org"), (2, "x" * 100_001 + " a.b@c.org"), (3, "see DE LA here http://x.org/1"), (4, None), (5, "Calle 5 {x}, tel"), (6, "una\nCARRERA 9 no\nfin")]
    out = jobs.screened_documents(spark.createDataFrame(rows, "doc_id long, text string"), ["de la"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("EMAIL_REDACTED") == 1
    got = {r["doc_id"]: (r["text"], r["verdict"]) for r in out.collect()}
    assert got[1] == ("call [PHONE_REDACTED] or mail [EMAIL_REDACTED]", "clean") and got[2] == (rows[1][1], "rejected")
    assert got[3] == ("see DE LA here [URL_REDACTED]", "quarantined") and got[4] == (None, "clean")
    assert got[5] == ("[ADDRESS_REDACTED]}, tel", "clean") and got[6] == ("una\n[ADDRESS_REDACTED]\nfin", "quarantined")


def test_audit_reads_each_side_once(spark, tmp_path):
    spark.createDataFrame([(1, "uno"), (2, "dos")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, scans in ((audit.a3, 2), (audit.a4, 3), (audit.a5, 3)):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == scans


def test_documents_are_normalised_once(spark):
    """Signals and words share the normal form; lines have theirs, where headers and where verbs are sought."""
    rows = spark.createDataFrame([(1, "The the\nUnd Ñandú, with c++ that 2019 x@y.z\n\u0416\u0416 ok"), (2, "@b.c x@y x2019 forty"), (3, None)], "cv_id long, text string")
    docs = matching.worked_out(rows)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tx._SEPARATORS[-30:]) == 3
    got = {r["cv_id"]: r for r in docs.collect()}
    assert got[1]["words"] == ["the", "und", "ñandu", "with", "c++", "that", "2019", "x", "y", "z", "жж", "ok"]
    assert [got[1][x] for x in matching.SIGNALS[:5]] == [True, True, 2, 1, 13]
    assert [got[2][x] for x in matching.SIGNALS[:5]] == [False, False, 0, 0, 6] and got[3]["words"] is None


def test_latin_texts_are_told_by_every_character(spark):
    odd = "aé\u00bc\u0130\u0132\u01c4\u2010\u20a8\u1e9a\u3042\U0001f600\x00\x7f\u024f\u0250"
    got = {r["t"]: r["l"] for r in spark.createDataFrame([("plain " + x + " end",) for x in odd], "t string").withColumn("l", tx.is_latin(F.col("t"))).collect()}
    assert got == {"plain " + x + " end": not re.search("[^" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), tx._SAFE) + "]", x) for x in odd}
    assert 0 < sum(got.values()) < len(got)
