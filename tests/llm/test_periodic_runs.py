"""Periodic runs against a plain search, and extensions against comparing value by value."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

import __spark_entry__ as entry
from matchloom.llm import periodic_runs
from matchloom.llm.extensions import COVER, PERIOD, Extensions


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, exponent=4, least=6):
    """Runs of a list of words: maximal stretches of equal words q apart, for each q; the smallest q of a stretch counts."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end - at + q >= max(least, exponent * q):
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_row(doc, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{ln},{q}\n" for s, ln, q in runs), collapsed(w, runs))]
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_plain_version(spark, sf_dir, real):
    got = {tuple(r[c] for c in COLUMNS) for r in entry.queries()["op13_periodic_runs"](spark, sf_dir).collect()}
    wanted = {plain_row(*r) for r in real}
    assert got == wanted and sum(r[1] for r in wanted) > 20


def test_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_extensions():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (5, 1), (200, 1), (300, 2), (700, 3), (500, 40)):
        x = np.concatenate([rng.integers(0, kinds, n), [kinds]])
        if n == 700:
            x[350:690] = x[5:345]
        e, (a, b) = Extensions(x), rng.integers(0, n + 1, (2, 500))
        a, b = a[a != b], b[a != b]
        for i, j, got in zip(a.tolist(), b.tolist(), e.common(a, b).tolist(), strict=True):
            k = 0
            while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert got == k


def test_random_words(spark):
    rng, texts = random.Random(2), []
    for _ in range(300):
        w = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at, q = rng.randrange(len(w) + 1), rng.randrange(1, 9)
            w[at:at] = ([rng.choice("abcd") for _ in range(q)] * 12)[:rng.randrange(3 * q, 12 * q)]
        texts.append(" ".join(w))
    for exponent, least in ((4, 6), (2, 2), (3, 10)):
        got = periodic_runs.find_runs(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), exponent=exponent, least=least).collect()
        for r in got:
            w = texts[r["doc_id"]].split()
            runs = plain_runs(w, exponent, least)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(w, runs) and r["n_words"] == len(w)


def test_odd_texts(odd, odd_rows, empty, spark):
    got = sorted(periodic_runs.find_runs(odd).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [i for i, _ in odd_rows]
    for r, (_, text) in zip(got, odd_rows, strict=True):
        w = words_of(text)
        # a long text of one word again and again, but for its end
        wanted = plain_runs(w) if len(w) < 9000 else [(0, w.count(w[0]), 1)]
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == wanted
        assert r["best_run"] is not None or r["collapsed"] == " ".join(w)
    assert periodic_runs.find_runs(empty).count() == 0
    same = spark.createDataFrame([(1, "x " * 9), (1, "x " * 9), (1, None), (None, "\x0b a a\tb b b b b\nb ")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["collapsed"]) for r in periodic_runs.find_runs(same).collect()) == [(0, "a a b"), (1, ""), (1, "x"), (1, "x")]


def test_pieces_do_not_matter(real, monkeypatch):
    import pyarrow as pa

    texts = [x for _, x in real if x][:20] + ["u v w " * 400]
    whole = periodic_runs._searched(pa.array(texts), 4, 6)
    monkeypatch.setattr(periodic_runs, "GRID", 500)
    assert periodic_runs._searched(pa.array(texts), 4, 6)[:3] == whole[:3]
