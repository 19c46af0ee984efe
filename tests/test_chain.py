"""Persisted chains, grid search, sparse neighbours, SVD and the F tail against plain versions."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tixpark.operators import chain as ch
from tixpark.operators import evaluate as ev
from tixpark.operators import models as md
from tixpark.operators import neighbours as nn
from tixpark.operators import svd
from tixpark.operators.profile import f_tail
from tixpark.session import scratch_path

TOPICS = {"cheques": "cheque rechazado firma banco", "cuentas": "cuenta nueva saldo abierta", "garantias": "garantía vencida crédito hipoteca"}


@pytest.fixture(scope="module")
def tickets(spark):
    r = random.Random(3)
    rows = []
    for i in range(72):
        clase = list(TOPICS)[i % 3]
        words = r.choices(TOPICS[clase].split(), k=5) + r.choices(["caso", "urgente", "cliente", "sistema"], k=3)
        rows.append((f"N{i:03d}", " ".join(words), None if i % 4 else "detalle adicional", clase, "x"))
    return spark.createDataFrame(rows, "number string, short_description string, description string, clase string, prediction_note string")


@pytest.mark.parametrize("style,classifier,blocks", [("filled", "lr", ch.TERMS), ("present", "svm", ch.UNION)])
def test_reloaded_chain_scores_raw_tickets(spark, tickets, style, classifier, blocks):
    chain = ch.fit_chain(tickets, "clase", ch.TicketText(["short_description", "description"], style), blocks, classifier, max_iter=30)
    path = scratch_path(spark, f"chain-{uuid.uuid4().hex[:8]}")
    md.save_model(chain.stages, path)
    raw = tickets.drop("clase").unionByName(spark.createDataFrame([("Z1", "cheque sin firma", None, "x"), ("Z2", None, None, None)],
                                                                 "number string, short_description string, description string, prediction_note string"))
    a = {r.number: r["Clasificación"] for r in ch.scorer(chain, review_empty=True)(raw).collect()}
    b = {r.number: r["Clasificación"] for r in ch.scorer(md.load_model(path), review_empty=True)(raw).collect()}
    truth = {r.number: r.clase for r in tickets.collect()}
    assert a == b and all(a[n] == c for n, c in truth.items())
    assert a["Z1"] == "cheques" and a["Z2"] == "revision"


def _vectors(spark, n=60, terms=40, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = np.sort(r.choice(terms, size=r.integers(1, 9), replace=False))
        if i % 3 == 0:
            at = np.unique(np.append(at, [0, 1]))
        rows.append((f"N{i:03d}", f"c{i % 3}", float(i % 3), SparseVector(terms, at.tolist(), (r.random(len(at)) + 0.1).tolist())))
    return rows, spark.createDataFrame(rows, ["number", "clase", "label_idx", "features"])


def test_grid_search_equals_a_plain_loop(spark):
    _, df = _vectors(spark)
    model, scores = ch.grid_search_c(df, 3, (0.5, 5.0), 2, max_iter=20)
    weighted = df.join(ev.class_weights_balanced(df, "clase").select("clase", "weight"), "clase")
    folded = ev.stratified_kfold(weighted, "clase", "number", 3, 42, "fold").cache()
    plain = {}
    for c in scores:
        f1 = []
        for k in range(3):
            fit = md.svm_ovr_balanced(df.count() * 2 // 3, c, 20).fit(folded.filter(F.col("fold") != k))
            p = [(r.label_idx, r.prediction) for r in fit.transform(folded.filter(F.col("fold") == k)).collect()]
            per = []
            for label in {x for pair in p for x in pair}:
                tp = sum(y == q == label for y, q in p)
                per.append(2 * tp / (sum(y == label for y, _ in p) + sum(q == label for _, q in p)))
            f1.append(sum(per) / len(per))
        plain[c] = sum(f1) / 3
    folded.unpersist()
    assert scores == pytest.approx(plain, abs=1e-9)


def test_sparse_neighbours_equal_brute_force(spark):
    rows, df = _vectors(spark, n=80)
    rows += [("Z0", "c0", 0.0, SparseVector(40, [], []))]
    df = df.union(spark.createDataFrame(rows[-1:], df.schema)).withColumn("g", (F.crc32("number") % 3).cast("long"))
    group = {r.number: r.g for r in df.collect()}
    near = nn.nearest_sparse(df.repartition(3), nn.fit_index(df, "number", "features", "clase", "g"), "number", "features", "g", k=4)
    got = {}
    for r in near.collect():
        got.setdefault(r.id, {})[r["rank"]] = r.label
    dense = {n: v.toArray() / (np.linalg.norm(v.toArray()) or 1) for n, _, _, v in rows}
    label = {n: c for n, c, *_ in rows}
    for n in label:
        order = sorted((-round(float(dense[n] @ dense[o]), 9), o) for o in label if group[o] != group[n])[:4]
        assert [got[n][i + 1] for i in range(4)] == [label[o] for _, o in order]
    share = {r.id: (r.pred, r.share) for r in nn.vote_share(near, 3).collect()}
    for n, (pred, s) in share.items():
        votes = [got[n][i] for i in (1, 2, 3)]
        assert (pred, s) == (min(set(votes), key=lambda c: (-votes.count(c), c)), pytest.approx(votes.count(pred) / 3))


def test_svd_against_numpy(spark):
    rows, df = _vectors(spark, n=200, terms=60, seed=4)
    df = df.repartition(5)
    x = np.stack([v.toArray() for *_, v in rows])
    latent = svd.latent_svd(df, 60, k=7, oversample=4, tolerance=1e-12)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(latent.singular, s[:7], rtol=1e-9)
    got = {r.id: np.array(r.latent) for r in svd.project(df, latent).collect()}
    y = np.stack([got[n] for n, *_ in rows])
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x @ vt[:7].T, axis=1), atol=1e-7)
    assert np.linalg.norm(x - y @ latent.components.T) == pytest.approx(math.sqrt((s[7:] ** 2).sum()), rel=1e-8)


def test_f_tail():
    def plain(f, d1, d2, steps=200_000):
        """Simpson over t in (0, x) of the beta density, x = d2 / (d2 + d1 f), by t = u^2."""
        a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
        norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        u = np.linspace(0, math.sqrt(x), steps + 1)
        with np.errstate(divide="ignore"):
            g = 2 * u * np.exp(norm + (a - 1) * np.log(u * u) + (b - 1) * np.log1p(-u * u))
        g[0] = 0.0
        w = np.ones(steps + 1)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return float((g * w).sum() * math.sqrt(x) / steps / 3)

    for f, d1, d2 in ((4.0, 3, 20), (0.3, 2, 50), (1.0, 4, 4), (2.5, 7, 995), (12.0, 2, 30), (0.01, 5, 9)):
        assert f_tail(f, d1, d2) == pytest.approx(plain(f, d1, d2), abs=1e-9)
    # for two degrees of freedom between, the tail is (1 + 2 f / d2) ** (-d2 / 2)
    assert f_tail(3.0, 2, 17) == pytest.approx((1 + 6 / 17) ** -8.5, abs=1e-13)
    assert f_tail(None, 2, 3) is None and f_tail(0.0, 2, 3) == 1.0


def test_gram_products_of_dense_and_sparse_slices(monkeypatch):
    """Blocks made dense and blocks left sparse, of any number of rows, add up to the plain product."""
    rng = np.random.default_rng(3)
    for density, cells in ((0.3, 1 << 21), (0.3, 100), (0.004, 1 << 21), (0.004, 700), (0.0, 100)):
        x = rng.random((50, 40)) * (rng.random((50, 40)) < density)
        q, acc, seen = rng.standard_normal((40, 6)), np.zeros((40, 6)), np.zeros(40, dtype=bool)
        row, term = np.nonzero(x)
        monkeypatch.setattr(svd, "DENSE", cells)
        svd._add_gram_times(row, term.astype(np.int32), x[row, term], 50, q, acc, seen)
        assert np.allclose(acc, x.T @ (x @ q)) and (seen == x.any(axis=0)).all()


def test_macro_f1_scores_rows_once(spark):
    _, df = _vectors(spark, n=30)
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def predict(y):
        scored.add(1)
        return y if y < 2 else 0.0

    f1 = ch.MacroF1().evaluate(df.withColumn("prediction", predict("label_idx")))
    assert f1 == pytest.approx((2 * 10 / 30 + 1.0) / 3) and scored.value == 30
