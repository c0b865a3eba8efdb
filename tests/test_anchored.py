"""Anchored windows against a plain walk, on hot keys, ties and odd rows; lines of words and quotas on top of them."""

import random
from datetime import datetime, timedelta

import pytest

from matchloom.functions.anchored import openers
from matchloom.operators import extract
from matchloom.operators.extract import words_to_lines
from matchloom.operators.privacy import anchored_window_quota


def walk(values, width, strict):
    out = []
    for v in sorted({x for x in values if x is not None}):
        if not out or (v - out[-1] > width if strict else v - out[-1] >= width):
            out.append(v)
    return out


@pytest.mark.parametrize(("width", "strict"), [(7, False), (7, True), (1, False), (0, True), (5000, False)])
def test_openers_equal_walk(spark, width, strict):
    rng = random.Random(width)
    rows = [(rng.choice([None, "a", "b", "hot", "hot"]), "x", rng.choice([rng.randint(-900, 900), 10_000 + rng.randint(0, 40), None])) for _ in range(600)] + [("one", "x", 3), ("none", "x", None)]
    got = {}
    for r in openers(spark.createDataFrame(rows, "k string, l string, v long"), ["k", "l"], "v", width, strict).collect():
        got.setdefault(r["k"], []).append(r["v"])
    wanted = {k: walk([v for x, _, v in rows if x == k], width, strict) for k in {r[0] for r in rows}}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in wanted.items() if v}


def test_no_table_goes_whole_through_the_driver(spark):
    """Stored values are small on disk for what they hold, so their size must not choose the join."""
    words = spark.createDataFrame([(1, 0, 1.0, 9.0, "a"), (1, 0, 2.0, 1.0, "b")], "doc_id long, page long, x double, y double, text string")
    plan = words_to_lines(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = openers(words, ["doc_id"], "y", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_rows(spark):
    assert openers(spark.createDataFrame([], "k string, v long"), ["k"], "v", 5).count() == 0


def test_quota_of_a_hot_key(spark):
    start, rng = datetime(2024, 1, 1), random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", start + timedelta(seconds=rng.randrange(4000))) for i in range(900)] + [(1000, None, start), (1001, None, start), (1002, "hot", None)]
    got = {r["event_id"]: (r["n"], r["admitted"], r["retry_after"]) for r in anchored_window_quota(spark.createDataFrame(rows, "event_id long, key string, at timestamp"), 2, 60).collect()}
    wanted = {1002: (0, True, 0)}
    for key in {r[1] for r in rows}:
        anchor, n = None, 0
        for at, i in sorted((at, i) for i, k, at in rows if k == key and at):
            if anchor is None or (at - anchor).total_seconds() >= 60:
                anchor, n = at, 0
            n += 1
            wanted[i] = (n, n <= 2, 0 if n <= 2 else max(1, 60 - int((at - anchor).total_seconds())))
    assert got == wanted


def test_quota_has_no_python(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "event_id long, key string, at timestamp")
    frame.write.parquet(f"{tmp_path}/events")
    plan = anchored_window_quota(spark.read.parquet(f"{tmp_path}/events"), 2, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n", [40, 4000])
def test_lines_equal_walk(spark, n):
    rng = random.Random(n)
    words = [(i % 3, i % 2, rng.random() * 500, rng.choice([None, float(rng.randrange(700)), rng.randrange(1400) / 2]), f"w{i}") for i in range(n)]
    got = {(r["doc_id"], r["page"], r["line"]): r["text"] for r in words_to_lines(spark.createDataFrame(words, "doc_id long, page long, x double, y double, text string")).collect()}
    wanted = {}
    for doc, page in {w[:2] for w in words}:
        mine = [w for w in words if w[:2] == (doc, page) and w[3] is not None]
        firsts = walk([-w[3] for w in mine], 2.0, True)
        for line, first in enumerate(firsts):
            end = firsts[line + 1] if line + 1 < len(firsts) else float("inf")
            wanted[doc, page, line] = " ".join(w[4] for w in sorted((w for w in mine if first <= -w[3] < end), key=lambda w: (w[2], w[4])))
    assert got == wanted


@pytest.mark.parametrize("full", [1_000_000, 60])
def test_lines_pass_batches_and_full_pages(spark, monkeypatch, full):
    """Lines and pages go on from one batch to the next; a page that is too full for one task comes out the same."""
    rng = random.Random(full)
    words = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), rng.choice([None, 1.0, 2.5]), rng.choice([None, 5.0, 6.0, float(rng.randrange(90))]), rng.choice([None, f"w{i}"])) for i in range(400)]
    frame = spark.createDataFrame(words, "doc_id string, page long, x double, y double, text string")
    monkeypatch.setattr(extract, "FULL_PAGE", full)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["doc_id"], r["page"], r["line"]): r["text"] for r in words_to_lines(frame).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = {}
    for doc, page in {w[:2] for w in words}:
        mine = [w for w in words if w[:2] == (doc, page) and w[3] is not None]
        firsts = walk([-w[3] for w in mine], 2.0, True)
        for line, first in enumerate(firsts):
            end = firsts[line + 1] if line + 1 < len(firsts) else float("inf")
            held = sorted((w for w in mine if first <= -w[3] < end), key=lambda w: (w[2] is not None, w[2] or 0, w[4] is not None, w[4] or ""))
            wanted[doc, page, line] = " ".join(w[4] for w in held if w[4] is not None)
    assert got == wanted


def test_words_are_shuffled_once(spark, tmp_path):
    """The words of pages that are not too full go through one shuffle, by page; sizes of pages through the other."""
    spark.range(50).selectExpr("id % 3 AS doc_id", "id % 2 AS page", "1D AS x", "double(id) AS y", "string(id) AS text").write.parquet(f"{tmp_path}/words")
    plan = words_to_lines(spark.read.parquet(f"{tmp_path}/words"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1
