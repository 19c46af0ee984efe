"""Truncated SVD of sparse rows, uncentred (M21), by passes over the rows.

The right singular vectors are the leading eigenvectors of XᵀX.  A pass
multiplies XᵀX with a block: every task works through its sparse rows and
returns sums by term, Spark adds them, and the driver holds terms x block
numbers (5,000 terms and 100 columns: 4 MB).  Each round extends the block by
two Krylov blocks and keeps the best Ritz vectors, until the residuals of all
wanted pairs are below the tolerance.  Rows are made dense in blocks of bounded
size over the terms that they hold, where few enough cells are empty: products
of matrices take far less time than sums by row and by term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Non-zeros that a task multiplies at a time.
SLICE = 1 << 16
#: Cells (rows x terms) that a task makes dense at a time: 16 MB.
DENSE = 1 << 21
#: Rows of less than one cell in so many stay sparse.
SPARSE = 64


@dataclass
class Latent:
    """``components`` (terms x k), singular values, and the greatest relative residual |XᵀX v - s² v| / s₁²."""

    components: np.ndarray
    singular: np.ndarray
    residual: float


def _rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(row, term, value, first row, rows) of a column of sparse vectors, in slices of bounded size."""
    first, count = 0, len(vectors)
    kind, _, indices, values = vectors.flatten()
    if count and not (np.asarray(kind) == 0).all():
        raise ValueError("the vectors must be sparse")
    ends = np.cumsum(np.diff(values.offsets.to_numpy()))
    term, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
    while first < count:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        held = np.diff(np.append(base, ends[first:last]))
        yield np.repeat(np.arange(last - first), held), term[base:ends[last - 1]], value[base:ends[last - 1]], first, last - first
        first = last


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The slice's rows times q."""
    out = np.zeros((n, q.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(value[:, None] * q[term], starts, axis=0)
    return out


def _add_gram_times(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, q: np.ndarray, acc: np.ndarray, seen: np.ndarray) -> None:
    """Add XᵀX q of the slice's rows to ``acc`` and mark their terms in ``seen``."""
    step = max(1, DENSE // len(q))
    for lo in range(0, n, step):
        count = min(step, n - lo)
        first, last = np.searchsorted(row, (lo, lo + count))
        r, t, v = row[first:last] - lo, term[first:last], value[first:last]
        here = np.zeros(len(q), dtype=bool)
        here[t] = True
        at = np.flatnonzero(here)
        if len(t) * SPARSE < count * len(at):
            y = _times(r, t, v, count, q)
            order = np.argsort(t, kind="stable")
            starts = np.flatnonzero(np.diff(t[order], prepend=-1))
            acc[at] += np.add.reduceat((v[:, None] * y[r])[order], starts, axis=0)
        elif len(at):
            x = np.zeros((count, len(at)))
            x[r, (np.cumsum(here) - 1)[t]] = v
            acc[at] += x.T @ (x @ q[at])
        seen |= here


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """XᵀX q by one pass."""
    terms, m = q.shape
    names = [f"c{j}" for j in range(m)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, seen = np.zeros((terms, m)), np.zeros(terms, dtype=bool)
        for batch in batches:
            for row, term, value, _, n in _rows(batch.column(0)):
                _add_gram_times(row, term, value, n, q, acc, seen)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(acc[at, j]) for j in range(m))], names=["term", *names])

    schema = "term long, " + ", ".join(f"{c} double" for c in names)
    sums = rows.select("features").mapInArrow(work, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((terms, m))
    out[sums.column("term").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in names], axis=1)
    return out


def _orth(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for q in against:
            block = block - q @ (q.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def latent_svd(rows: DataFrame, terms: int, k: int = 90, oversample: int = 10, tolerance: float = 1e-6, max_rounds: int = 25, seed: int = 42) -> Latent:
    """The k leading components of ``rows`` (features: sparse vectors over ``terms`` terms; a written table)."""
    k = min(k, terms)
    m = min(terms, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, m)))[0]
    aq = _gram_times(rows, q)
    for _ in range(max_rounds):
        basis, products = [q], [aq]
        for _ in range(2):
            room = terms - sum(b.shape[1] for b in basis)
            if room <= 0:
                break
            basis.append(_orth(products[-1][:, :room], *basis))
            products.append(_gram_times(rows, basis[-1]))
        b, ab = np.concatenate(basis, axis=1), np.concatenate(products, axis=1)
        t = b.T @ ab
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        q, aq = b @ turn, ab @ turn
        top = max(float(values[0]), 1e-300)
        residual = float(np.linalg.norm(aq[:, :k] - q[:, :k] * values[:k], axis=0).max()) / top
        if residual <= tolerance:
            break
    return Latent(q[:, :k], np.sqrt(np.maximum(values[:k], 0.0)), residual)


def project(rows: DataFrame, latent: Latent, id_col: str = "number") -> DataFrame:
    """``id, latent``: every row's coordinates X V."""
    v = latent.components

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, term, value, first, n in _rows(batch.column(1)):
                y = _times(row, term, value, n, v)
                offsets = pa.array(np.arange(0, (n + 1) * v.shape[1], v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))],
                                                 names=["id", "latent"])

    return rows.select(F.col(id_col).cast("string"), "features").mapInArrow(work, "id string, latent array<double>")
