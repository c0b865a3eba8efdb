"""Embedding whitening against an eigendecomposition and integers of any size."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from matchloom.llm import whitening


def plain(rows, components):
    """{(id, component): (n, deviation, projection without sign, explained)} of (id, vector) rows."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    y = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for _, v in kept])
    values, axes = np.linalg.eigh(y.T @ y / n)
    out = {}
    for k in range(components):
        e, axis = values[-1 - k], axes[:, -1 - k]
        for (i, v), p in zip(kept, y @ axis / math.sqrt(e), strict=True):
            out[i, k + 1] = n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), abs(p), e / values.sum()
    return out


def same(got, wanted):
    assert {(r[0], r["component"]) for r in got} == set(wanted) and len(got) == len(wanted)
    for r in got:
        n, deviation, projection, explained = wanted[r[0], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(projection, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_query_equals_eigendecomposition(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(entry.queries()["op11_whitening"](spark, sf_dir).collect(), plain(rows, 8))


def test_factors():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 1), (5, 5), (17, 9), (64, 64)):
        half = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        a = half @ half.T
        low = whitening.pivoted_cholesky(a)
        assert low.shape == (d, rank) and np.allclose(low @ low.T, a, rtol=1e-12, atol=1e-12 * a.max())
        assert all((low[:, k] == 0).sum() >= k for k in range(rank))  # rows of earlier pivots
        turned = whitening.one_sided_jacobi(low)
        assert np.allclose((turned ** 2).sum(0), np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8)
        gram = turned.T @ turned
        assert np.abs(gram - np.diag(gram.diagonal())).max() <= 1e-13 * gram.max()


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0, -3.0]), (1, [0.5, 1.0, -3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 2.0]), (5, [1.0, -inf, 2.0]), (None, [0.0, -0.0, 9.25]), (7, []), (8, [1.0, 2.0]),
            (9, [4.0, 4.0, -1.0]), (10, [-2.0, 0.25, 0.125])]
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, embedding array<double>, n long, whitened double, component string").repartition(3)
    got = whitening.whiten(df).collect()
    usable = [(k, v) for k, (_, v) in enumerate(rows) if v and len(v) == 3]
    wanted = sorted((rows[k][0] or -1, c, w[0], w[1], round(w[2], 7), round(w[3], 9)) for (k, c), w in plain(usable, 3).items())
    assert sorted((r["vec_id"] or -1, r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 7), round(r["explained"], 9)) for r in got) == wanted
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_no_variance_and_no_rows(spark):
    kind = "vec_id string, embedding array<float>"
    for rows in ([], [("a", None)], [("a", [])], [("a", [1.0, 2.0]), ("b", [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and len(out.columns) == 7
    flat = spark.createDataFrame([("a", [1.0, 2.0, 2.0]), ("b", [2.0, 2.0, 4.0]), ("c", [5.0, 2.0, 10.0])], kind)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 3 ** k) * 2e3 for k in range(4)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    wanted = {i: w[1] for (i, _), w in plain(rows, 1).items()}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in wanted.items()}
    assert min(wanted.values()) < 1 << 63 < max(wanted.values())
    big = [(i, [(-1.0) ** i * 1e300, float(i)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert len(got) in (6, 12) and all(r["deviation"] is None for r in got)
