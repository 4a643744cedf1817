"""Operator 12 against numpy's eigenvalues, and odd vectors."""

import math

import numpy as np
import pytest

from shotgrid.llm import feast
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(d, seed, values=None):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    w = rng.standard_normal(d) if values is None else np.array(values, float)
    return (q * w) @ q.T


@pytest.mark.parametrize("d", [1, 2, 5, 17, 64])
def test_inertia_counts_eigenvalues(d):
    v = symmetric(d, d)
    w = np.linalg.eigvalsh(v)
    for s in np.concatenate([(w[1:] + w[:-1]) / 2, [w[0] - 1, w[-1] + 1]]):
        assert feast.inertia_below(v, s) == (w < s).sum()


def test_inertia_needs_two_by_two_pivots():
    assert feast.inertia_below(np.array([[0.0, 1], [1, 0]]), 0.0) == 1
    assert feast.inertia_below(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [[9, 5, 4, 3, 2, 1, 0.5, 0.1], [9, 9, 4, 3.9999, 3.9998, 1, 0, 0], [1e6, 1, 1e-3, 1e-6, 0, 0, 0, 0],
                                    [3, 3, 3, 3, 3, 3, 3, 3]])
def test_components_equal_numpy(values):
    v = symmetric(8, 3, values)
    v = (v + v.T) / 2
    w, u = feast.components(v, 4)
    assert np.allclose(w, np.linalg.eigvalsh(v)[::-1][:len(w)], rtol=1e-9, atol=1e-12 * max(values))
    assert np.allclose(u.T @ u, np.eye(len(w)), atol=1e-12)
    assert np.abs(v @ u - u * w).max() < 1e-11 * max(values)


def test_feast_finds_inner_interval():
    v = symmetric(30, 5, range(30))
    w, _ = feast.feast((v + v.T) / 2, 9.5, 14.5, 5)
    assert np.allclose(w, [14, 13, 12, 11, 10])


def brute(rows, k=4):
    keep = [(i, [float(c) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    x = [[math.floor(256 * np.float64(np.float32(c))) for c in e] for _, e in keep]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[a - t / n for a, t in zip(r, s, strict=True)] for r in fit])
    v = c.T @ c / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    white = (np.array(x) - np.array(s) / n) @ u / np.sqrt(w)
    return keep, n, [sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True)) for r in x], np.abs(white), w / np.trace(v)


def test_whitening_against_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    rows += [(9001, None), (9002, [None] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), rows[0], (None, rows[1][1]), (9005, []),
             (9006, [1.0, 2.0])]
    keep, n, dev, white, explained = brute([(i, e) for i, e in rows if i not in (9005, 9006)])
    extra = spark.createDataFrame([(i, e, None) for i, e in rows], SCHEMA).repartition(5).selectExpr("*", "1 as n", "'a' as component", "2 as x")
    got = feast.whiten(extra).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 4 * len(keep) and (got.n == n).all() and (got.identity_error < 1e-9).all()
    want = sorted((-1 if i is None else i, k + 1, dev[j], round(float(white[j, k]), 6)) for j, (i, _) in enumerate(keep) for k in range(4))
    have = sorted((int(i), int(c), int(d), round(abs(w), 6)) for i, c, d, w in zip(got.vec_id.fillna(-1), got.component, got.deviation, got.whitened,
                                                                                     strict=True))
    assert [r[:3] for r in want] == [r[:3] for r in have]
    assert np.allclose([r[3] for r in want], [r[3] for r in have], atol=1e-5)
    for k in range(4):
        assert np.allclose(got.explained[got.component == k + 1], explained[k], rtol=1e-9)
    signs = got.groupby("component").whitened.first()
    assert len(signs) == 4


def test_odd_vectors(spark):
    def run(rows):
        return feast.whiten(spark.createDataFrame(rows, SCHEMA)).collect()

    assert run([]) == []
    assert run([(1, None, 1), (2, [], 1)]) == []
    assert run([(1, [1.0, 2.0], 1)]) == []
    assert run([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]) == []
    line = run([(1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (2, [0.0, 2.0], 1)])            # one direction with variance
    assert [(r.vec_id, r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in line] == [
        (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    assert {r.deviation for r in line} == {256 ** 2}


def test_large_entries_are_exact(spark):
    rows = [(1, [3.0e9, 1.0], 1), (2, [-3.0e9, 2.0], 1), (3, [1.5, 0.25], 1)]
    with pytest.raises(Exception, match="(?i)int|long|overflow"):                  # the squares don't fit a long
        feast.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    rows = [(1, [3.0e5, 1.0], 1), (2, [-3.0e5, 2.0], 1), (3, [1.5, 0.25], 1)]
    x = [[math.floor(256 * c) for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: r.deviation for r in feast.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: sum((3 * a - t) ** 2 for a, t in zip(y, s, strict=True)) for r, y in zip(rows, x, strict=True)}
