import math
from fractions import Fraction

import numpy as np
import pytest

from quadframe.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def plain(rows, most=4):
    """The contract by loops, whole numbers and LAPACK's eigenvectors; {row: (deviation, whitened by component)}."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [[math.floor(256 * c) for c in v] for _, v in usable]
    fitted = [list(x) for x in dict.fromkeys(map(tuple, grid))]
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in grid]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fitted])
    v = y.T @ y / n
    e, b = np.linalg.eigh(v)
    e, b = e[::-1][:most], b.T[::-1][:most]
    all_ = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in grid])
    return usable, n, deviation, all_ @ (b / np.sqrt(e)[:, None]).T, e / np.trace(v)


def data(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [None] * d), (n + 2, [math.nan] * d), (n + 3, [math.inf, *[0.0] * (d - 1)]), (None, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (n + 4, [-0.0] * d)]
    return rows


@pytest.mark.parametrize(("n", "d"), [(300, 12), (40, 64), (500, 64)])
def test_against_loops(spark, n, d):
    rows = data(n, d)
    usable, count, deviation, want, explained = plain(rows)
    got = whiten.whitened_components(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(4), "vec_id", "embedding", 4).collect()
    assert len(got) == 4 * len(usable)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for c in range(4):
        mine = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1), key=key)
        theirs = sorted(((i, dev, w) for (i, _), dev, w in zip(usable, deviation, want[:, c])), key=key)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert {(r["n"]) for r in got} == {count}
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-10 for r in got)


@pytest.mark.parametrize("kind", ["random", "equal", "close", "low rank", "diagonal", "zero", "one"])
def test_divide_and_conquer(kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    e = {"random": rng.random(30), "equal": np.repeat([3.0, 2.0, 1.0], 10), "close": 1 + 1e-9 * np.arange(30), "low rank": np.r_[np.arange(1, 6), np.zeros(25)], "diagonal": np.arange(30.0), "zero": np.zeros(30), "one": np.ones(1)}[kind]
    q = np.eye(len(e)) if kind in ("diagonal", "one") else q
    v = (q * e) @ q.T
    values, vectors = whiten.components((v + v.T) / 2)
    assert np.abs(values - np.sort(e)[::-1]).max() < 1e-13 * max(1, e.max())
    assert np.abs(vectors @ vectors.T - np.eye(len(e))).max() < 1e-13
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-13 * max(1, e.max())


def test_sign_of_a_symmetric_matrix():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    e, b = np.linalg.eigh(a)
    assert np.abs(whiten.sign(a) - (b * np.sign(e)) @ b.T).max() < 1e-13


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_no_components(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = whiten.whitened_components(df, "vec_id", "embedding", 4)
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_dimensions_other_lengths_and_large_entries(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [9.0]), (6, [9.0, 9.0])]
    got = whiten.whitened_components(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), "vec_id", "embedding", 4).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in (1, 2, 3, 4) for c in (1, 2)}
    assert {r["deviation"] for r in got} == {(4 * 256 - 2 * 256) ** 2 * 2}
    for i in (1, 2, 3, 4):  # equal eigenvalues: any basis
        assert abs(sum(r["whitened"] ** 2 for r in got if r["vec_id"] == i) - 2) < 1e-12
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0]), (4, [1e10, 3.0])]
    got = whiten.whitened_components(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), "vec_id", "embedding", 4).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4} and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in got)
