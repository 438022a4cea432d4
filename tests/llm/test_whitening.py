"""Whitened embeddings against exact sums and a plain eigen-decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from metricloom.llm import whitening
from metricloom.llm.queries import QUERIES


def usable(vectors):
    good = [v is not None and all(c is not None and math.isfinite(c) for c in v) for v in vectors]
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v, g in zip(vectors, good) if g]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, row string")


def test_query_against_plain_version(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array(usable([r["embedding"] for r in given]), dtype=object)
    n, d = x.shape
    sums = x.sum(0)
    centred = n * x - sums
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in centred.T @ centred])
    values = np.linalg.eigvalsh(cov)[::-1]
    rows = QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(rows) == n * 32
    deviation = dict(zip([r["vec_id"] for r in given], (centred**2).sum(1).tolist()))
    white = {}
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        white.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    w = np.array([[white[r["vec_id"]][k] for k in range(1, 33)] for r in given])
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(32)).max() < 1e-9
    # every component is the projection on an eigenvector: correlating it with the entries gives V times that vector
    y = (centred / n).astype(float)
    vectors = y.T @ w / n / np.sqrt(values[:32])
    assert np.abs(cov @ vectors - vectors * values[:32]).max() < 1e-9 * values[0]


def test_gaps_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(40, 3))]
    odd = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [1.0], [1e30, 0.0, 0.0]]
    docs = frame(spark, [*vectors, *odd, vectors[0]])
    model = whitening.fit(docs, "embedding", 2)
    rows = whitening.whiten(docs, model, "embedding", ["vec_id", "row"], 2).collect()
    assert model.n == 41 and sorted(r["row"]["vec_id"] for r in rows) == [*range(40), 47] and model.identity_error < 1e-9
    by_id = {r["row"]["vec_id"]: r for r in rows}
    assert by_id[0]["whitened"] == pytest.approx(by_id[47]["whitened"], abs=1e-14) and len(by_id[0]["whitened"]) == 2


def test_equal_rows_have_no_components(spark):
    docs = frame(spark, [[0.5, 0.25]] * 4)
    model = whitening.fit(docs, "embedding")
    rows = whitening.whiten(docs, model, "embedding", ["vec_id"]).collect()
    assert [(int(r["deviation"]), r["whitened"]) for r in rows] == [(0, [None, None])] * 4
    assert model.identity_error == 0.0


def test_one_direction_only(spark):
    docs = frame(spark, [[float(i), 0.0] for i in range(5)])
    rows = whitening.whiten(docs, whitening.fit(docs, "embedding"), "embedding", ["vec_id"]).collect()
    assert {round(abs(r["whitened"][0]), 9) for r in rows} == {0.0, round(1 / math.sqrt(2), 9), round(math.sqrt(2), 9)}
    assert all(r["whitened"][1] is None for r in rows)


def test_empty_table(spark):
    docs = frame(spark, [])
    model = whitening.fit(docs, "embedding")
    assert whitening.whiten(docs, model, "embedding", ["vec_id"]).collect() == []


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**40 + i), float(-(2**41)) * i, 0.125] for i in range(7)]
    docs = frame(spark, vectors)
    model = whitening.fit(docs, "embedding")
    x = np.array(usable([[float(np.float32(c)) for c in v] for v in vectors]), dtype=object)
    want = ((7 * x - x.sum(0)) ** 2).sum(1).tolist()
    got = {r["row"]["vec_id"]: int(r["deviation"]) for r in whitening.whiten(docs, model, "embedding", ["vec_id"]).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("bits", [3, 20, 21, 40, 60])
def test_exact_gram(bits):
    rows = np.random.default_rng(bits).integers(-(2**bits), 2**bits, (3000, 5))
    wide = rows.astype(object)
    assert (whitening.exact_gram(rows) == wide.T @ wide).all()


def reference(matrix):
    """Eigenvectors by Jacobi rotations in extended precision."""
    a = matrix.astype(np.longdouble)
    n = len(a)
    v = np.eye(n, dtype=np.longdouble)
    for _ in range(30):
        for p in range(n):
            for q in range(p + 1, n):
                if abs(a[p, q]) < 1e-30:
                    continue
                angle = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if angle >= 0 else -1) / (abs(angle) + np.sqrt(angle * angle + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.eye(n, dtype=np.longdouble)
                turn[p, p] = turn[q, q] = c
                turn[p, q], turn[q, p] = t * c, -t * c
                a, v = turn.T @ a @ turn, v @ turn
    order = np.argsort(-np.diag(a))
    return np.diag(a)[order], v[:, order]


@pytest.mark.parametrize("values", [[9.0, 7, 5, 3, 1], [5, 5 + 1e-6, 5 - 1e-6, 2, 1], [1, 1 + 1e-7, 1 + 2e-7, 1 + 3e-7, 1e-3]])
def test_eigenvectors_to_double_precision(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))[0]
    matrix = (q * np.array(values)) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigen(matrix)
    want, exact = reference(matrix)
    exact = exact * np.sign((exact * vectors).sum(0))
    gap = min(abs(a - b) for i, a in enumerate(want) for b in want[:i])
    assert np.abs((found - want).astype(float)).max() < 4e-15
    assert np.abs((vectors - exact).astype(float)).max() < 2e-16 + 1e-18 / gap


def test_equal_eigenvalues_stay_orthonormal():
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(20, 20)))[0]
    matrix = (q * np.array([4.0] * 8 + [1.0] * 12)) @ q.T
    values, vectors = whitening.eigen((matrix + matrix.T) / 2)
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-15
    assert np.abs(((matrix + matrix.T) / 2) @ vectors - vectors * values).max() < 1e-14
