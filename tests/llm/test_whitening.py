"""Whitening against whole-number covariances and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from wayfare.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(3)


def plain(rows, dim):
    """x of the rows that remain, n, S and the covariance in whole numbers."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    centred = [[n * x[d] - sums[d] for d in range(dim)] for x in fit]
    cov = np.array([[float(Fraction(sum(y[i] * y[j] for y in centred), n**3)) for j in range(dim)] for i in range(dim)])
    return kept, n, sums, cov


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_equals_plain(spark, scale):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 5)) @ np.diag([3, 2, 1.5, 1, 0.4]) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[0].tolist()) for i in range(60)] + [(None, base[1].tolist()), (700, base[2].tolist())]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, []), (905, [1.0]), (906, [0.0] * 5)]
    kept, n, sums, cov = plain(rows, 5)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(frame(spark, rows), 4).collect()
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"] is None, r["vec_id"], r["component"]) for r in got) == sorted((i is None, i, c) for i, _ in kept for c in range(1, 5))
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(4):
        want = {i: (np.array([n * a - s for a, s in zip(x, sums, strict=True)], float) / n) @ axes[:, k] / np.sqrt(values[k]) for i, x in kept}
        sign = np.sign(by[3, k + 1]["whitened"] * want[3])
        for i, x in kept:
            r = by[i, k + 1]
            assert abs(sign * r["whitened"] - want[i]) < 1e-9
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) or scale > 1
            assert abs(r["explained"] - values[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-10


def test_squares_of_every_length():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 30, 40, 61):
        v = rng.integers(-(1 << bits), 1 << bits, (37, 3))
        assert whitening.square_sums(v) == [sum(int(a) ** 2 for a in c) for c in v.T]
        assert whitening.column_sums(v) == [sum(int(a) for a in c) for c in v.T]
        assert all(whitening._number(whitening._limbs(n)) == n for n in (int(v[0, 0]), -(1 << 100), (1 << 140) + 5))


def test_long_deviation_is_null_and_too_long_is_an_error(spark):
    rows = [(i, [float(v), float(-v)]) for i, v in enumerate(np.random.default_rng(2).integers(0, 10**9, 50))]
    got = whitening.whiten(frame(spark, rows)).collect()
    kept, n, sums, _ = plain(rows, 2)
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    assert any(v >= 1 << 63 for v in exact.values())
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None) for r in got)
    with pytest.raises(ValueError, match="too long"):
        whitening.whiten(frame(spark, [(0, [1e300]), (1, [0.0])]))


def test_few_vectors_and_none(spark):
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.5])] * 3)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(1, 0, None, None)}
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0 and whitening.whiten(frame(spark, [])).columns[0] == "vec_id"


def test_reruns_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    first = {tuple(r) for r in whitening.whiten(frame(spark, rows)).collect()}
    assert first == {tuple(r) for r in whitening.whiten(frame(spark, rows[::-1]).repartition(7)).collect()}
