"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V = XᵀX / n of the centred vectors X
are found without forming V: a pass over the written fit list multiplies V with
a block Q (every task sums Xᵀ(XQ) of its rows, Spark adds the sums, the driver
holds d x m numbers).  A few Lanczos steps bound the spectrum from below; then
rounds of

* a polynomial of V on the block by the Chebyshev recurrence, whose interval
  reaches from the lower bound to the block's least Ritz value: it is damped,
  all above grows,
* QR of the block,
* Rayleigh-Ritz (one more pass), which also gives the residuals |V u - e u|

run until every wanted pair is certified: its residual is at the level of
double rounding.  A polynomial's degree is what the residuals still ask for,
bounded so that the block keeps its rank.

Entries are exact integers: x = floor(64 c) + 1,000,000.  Centring subtracts the
integer nearest to the mean first, exactly, then the rest of the mean (under a
half), so nothing is lost to the offset.

Defined cases: a row whose vector is null or holds a null or non-finite entry is
dropped; so is one that has not as many entries as most vectors have (of equal
counts the larger).  Equal vectors count once in the fit list; every row is
returned.  Components whose variance is under 1e-12 of the first (fewer distinct
vectors than components, constant dimensions) cannot be whitened and are not
returned; with fewer than two distinct vectors no row is.  |x| is held at 2**61;
a deviation beyond a long is null.  Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

COMPONENTS = 16
OFFSET, SCALE, LIMIT = 1_000_000, 64, 1 << 61
LANCZOS_STEPS, MAX_DEGREE, MAX_ROUNDS = 10, 20, 60
#: The first pair may outgrow the last wanted one in a polynomial by this much.
MAX_GROWTH = 1e10
#: Variances under this share of the first are rounding.
RANK = 1e-12

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, residual double")


@dataclass
class Whitener:
    """A fitted transform: ``components`` (d x k) of the distinct vectors, their variances, and the certificate."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.n, self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as its nearest integers and what is left of it."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(near, dtype=np.int64), np.array([(s - n * r) / n for s, r in zip(sums, near)])


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the rows with a whole vector of the common length, entries as integers; a written table."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c):
        x = F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT - OFFSET), x)) + F.lit(OFFSET)

    rows = materialize(embeddings.where(fine).select(F.col("vec_id").cast("long"), F.transform(v, whole).alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].d if sizes and sizes[0].d else -1))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, d: int, parts: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``parts(x)``, a flat array: one row of sums per entry and task, added by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for x in _blocks(batches, 0, d):
            part = parts(x)
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], names=["pos", "v"])

    rows = fit.select("x").mapInArrow(work, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.pos] = r.v
    return out


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the sums of the dimensions, as integers: halves of 32 bits are added apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for x in _blocks(batches, 0, d):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d + 1)), pa.array(np.append(high, n)), pa.array(np.append(low, 0))], names=["pos", "high", "low"])

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = {r.pos: (int(r.high), int(r.low)) for r in
            fit.select("x").mapInArrow(work, "pos long, high long, low long").groupBy("pos").agg(*total).collect()}
    if not rows:
        return 0, []
    return rows[d][0], [(rows[i][0] << 32) + rows[i][1] for i in range(d)]


def _lower_bound(multiply: Callable, d: int, rng: np.random.Generator) -> float:
    """A value under (almost) all of the spectrum: the least Ritz value of some Lanczos steps, less its residual."""
    q = rng.standard_normal(d)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS_STEPS, d)):
        w = multiply(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(abs(a) for a in alphas):
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    values, weights = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:k - 1], 1) + np.diag(betas[:k - 1], -1))
    return max(0.0, float(values[0] - betas[-1] * abs(weights[-1, 0])))


def _filtered(multiply: Callable, q: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` on [low, high] of V, applied to the block."""
    centre, half = (high + low) / 2, (high - low) / 2
    before, now = q, (multiply(q) - centre * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (multiply(now) - centre * now) / half - before
    return now


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The k leading eigenpairs of the symmetric, non-negative d x d operator, and their greatest residual.

    ``multiply(Q)`` is the only access to the operator; one call is one pass over the data.
    """
    rng = np.random.default_rng(seed)
    m = min(d, 3 * k)
    k = min(k, d)
    low = _lower_bound(multiply, d, rng) if m < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    last = math.inf
    for _ in range(MAX_ROUNDS):
        vq = multiply(q)
        t = q.T @ vq
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max())
        goal = 16 * np.finfo(float).eps * math.sqrt(d) * top
        if residual <= goal or (residual <= 1e-11 * top and residual > last / 2):
            break
        last = residual
        high = max(float(values[-1]), low + 1e-6 * top)
        grow = [math.acosh(max(1 + 1e-9, (2 * float(v) - high - low) / (high - low))) for v in (values[0], values[k - 1])]
        wanted = math.ceil(math.log(residual / goal) / grow[1]) if grow[1] > 0 else MAX_DEGREE
        bound = math.floor(math.log(MAX_GROWTH) / (grow[0] - grow[1])) if grow[0] > grow[1] else MAX_DEGREE
        degree = max(2, min(wanted, bound, MAX_DEGREE))
        q = np.linalg.qr(_filtered(multiply, q, low, high, degree))[0]
    return values[:k], q[:, :k], residual


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct vectors of ``rows`` (vec_id, x); None where there are fewer than two."""
    small_batches(rows.sparkSession, 4096)
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0].d
    fit = materialize(rows.select("x").distinct(), "fit-list")
    n, sums = _exact_sums(fit, d)
    near, rest = _centre(n, sums)
    passes = [0]

    def multiply(q: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def part(x: np.ndarray) -> np.ndarray:
            y = (x - near) - rest
            return (y.T @ (y @ q)).ravel()

        return _summed(fit, d, part).reshape(q.shape) / n

    values, u, residual = eigenpairs(multiply, d, components)
    real = values > RANK * max(float(values[0]), 0.0)
    values, u = values[real], u[:, real]
    k = len(values)
    if not k:
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - near) - rest
        w = (y @ u) / np.sqrt(values)
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0), [np.square(y).sum()]))

    s = _summed(fit, d, moments) / n
    cov = s[:k * k].reshape(k, k) - np.outer(s[k * k:-1], s[k * k:-1])
    return Whitener(n, sums, u, values, float(s[-1]), residual, float(np.abs(cov - np.eye(k)).max()), passes[0])


def _deviation(x: np.ndarray, near: np.ndarray, n: int, left: list[int]) -> np.ndarray | list:
    """The sum of (n x - S)**2 of every row, exactly, from x less the near mean and what is left of S."""
    gap = x - near
    widest = max(abs(int(gap.max())), abs(int(gap.min()))) * n + max(abs(v) for v in left)
    if widest * widest * x.shape[1] < 1 << 63:
        return np.square(gap * n - np.array(left, dtype=np.int64)).sum(axis=1)
    exact = (sum((n * int(g) - v) ** 2 for g, v in zip(row, left)) for row in gap)
    return [v if v < 1 << 63 else None for v in exact]


def transformed(rows: DataFrame, model: Whitener) -> DataFrame:
    """One row per vector and component: the whitened coordinate, with the fit's figures."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(RESULT))
    n, (near, rest), u = model.n, model.centre, model.components / np.sqrt(model.variances)
    left = [s - n * int(r) for s, r in zip(model.sums, near)]
    d, k = u.shape
    explained = model.variances / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _blocks(iter([batch]), 1, d):
                size = len(x)
                w = ((x - near) - rest) @ u
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), k)))
                dev = pa.array(_deviation(x, near, n, left), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
                flat = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), size), np.full(size * k, n), dev, w.ravel(),
                        np.tile(explained, size), np.full(size * k, model.identity_error), np.full(size * k, model.residual)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(flat, arrow)],
                                                 schema=arrow)

    return rows.select("vec_id", "x").mapInArrow(work, RESULT)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every remaining row's coordinates along the leading components, each of variance one over the distinct vectors."""
    rows = vectors(embeddings)
    model = fitted(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    return transformed(rows, model)
