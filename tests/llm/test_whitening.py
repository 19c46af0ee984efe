"""Whitening against numpy's eigenvectors of the full covariance, exact integers, edge cases."""

import math

import numpy as np
import pytest

from tixpark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def expected(rows):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(x)), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = (fit * n - s) / n
    cov = y.T @ y / n
    values, u = np.linalg.eigh(cov)
    return kept, x, n, s, values[::-1], u[:, ::-1], np.trace(cov)


@pytest.mark.parametrize("d,spread", [(80, 1.03), (64, 1.3), (10, 1.5)])
def test_against_eigh(spark, d, spread):
    rng = np.random.default_rng(d)
    scale = spread ** -np.arange(d)
    v = (rng.standard_normal((900, d)) * scale @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32)
    rows = [(i, [float(c) for c in row], "x", None) for i, row in enumerate(v)]
    rows += [(1000 + i, rows[0][1], "copy", None) for i in range(400)] + [(None, rows[1][1], None, None)]
    rows += [(2000, None, None, None), (2001, [1.0] * (d - 1) + [None], None, None), (2002, [float("nan")] * d, None, None),
             (2003, [float("inf")] + [0.0] * (d - 1), None, None)]
    kept, x, n, s, values, u, trace = expected(rows)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    k = min(16, d)
    assert len(got) == len(kept) * k
    sign = {}
    of = {}
    for r in got:
        of.setdefault(r.vec_id, {})[r.component] = r
    for (i, _), vec in zip(kept, x):
        y = (np.array(vec) * n - s) / n
        for c in range(k):
            r = of[i][c + 1]
            want = float(y @ u[:, c]) / math.sqrt(values[c])
            sign.setdefault(c, math.copysign(1, want * r.whitened))
            assert r.whitened * sign[c] == pytest.approx(want, abs=1e-8)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-10)
            assert (r.n, r.deviation) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(vec, s)))
            assert r.identity_error < 1e-9 and r.residual < 1e-11 * values[0]


def test_eigenpairs_take_few_passes():
    rng = np.random.default_rng(1)
    d = 300
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    true = np.concatenate(([500, 120], np.linspace(70, 50, d - 2)))
    a = (q * true) @ q.T
    calls = []

    def multiply(b):
        calls.append(b.shape[1])
        return a @ b

    values, u, residual = whitening.eigenpairs(multiply, d, 16)
    assert np.allclose(values, true[:16], rtol=1e-13) and residual < 1e-11 * 500
    assert np.abs(np.abs(np.diag(u.T @ q[:, :16])) - 1).max() < 1e-12
    assert len(calls) < 150


def test_few_or_odd_vectors(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    assert make([(1, []), (2, None)]).count() == 0
    # two distinct vectors have one component; a row of another length is dropped
    got = make([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [3.0, 2.0, 0.0]), (4, [1.0])]).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 12))) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    huge = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in huge)
