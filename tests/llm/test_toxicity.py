"""Toxicity: held-out accuracy, the score against a plain noisy-or, sentences located, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tixpark.llm import toxicity

BAD = ["scumbag", "Idiot", "grobzork", "grobfel", "chllamo"]


def corpus(n=900, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnlmpé") for _ in range(r.randrange(2, 9))) for _ in range(600)]
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = [[r.choice(vocabulary) for _ in range(r.randrange(3, 12))] for _ in range(r.randrange(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                r.choice(words).append(r.choice(BAD))
        docs.append((i, ". ".join(" ".join(s) for s in words) + ("\n" if i % 2 else ""), "en", f"s{i % 7}", "clash"))
        truth[i] = int(toxic)
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return docs, labels, truth


def plain_grams(sentence):
    out = set()
    for word in re.findall(r"[a-z0-9À-῿]+", sentence):
        word = "<" + word + ">"
        out |= {word[k:k + n] for n in toxicity.GRAMS for k in range(len(word) - n + 1)}
    return out


def gram_hash(gram):
    mask = (1 << 64) - 1
    h = len(gram)
    for c in gram:
        h = (h * 0x100000001B3 & mask) ^ (1 if c in "<>" else ord(c))
    h = h * 0x9E3779B97F4A7C15 & mask
    h ^= h >> 32
    h = h * 0xBF58476D1CE4E5B9 & mask
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, truth = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string").repartition(4)
    l = spark.createDataFrame(labels + labels[:9] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return d, truth, toxicity.fitted(d, l)


def test_held_out_documents(model):
    docs, truth, fit = model
    rows = toxicity.scored(docs, fit).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    wrong = [r for r in rows if r.held_out and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 3


def test_score_is_a_noisy_or_of_sentences(model):
    docs, _, fit = model
    weight = dict(zip(fit.grams.tolist(), fit.weights.tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, fit).collect():
        clean = 1.0
        for sentence in re.split(r"[.!?\n…。]", texts[r.doc_id].lower()):
            if grams := plain_grams(sentence):
                pass
            elif not re.search(r"[a-z0-9À-῿]", sentence):
                continue
            z = fit.bias + sum(weight.get(gram_hash(g), 0.0) for g in grams)
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert r.score == pytest.approx(1 - clean, abs=1e-9)


def test_located_sentences(model):
    docs, truth, fit = model
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.located(docs, fit).collect()
    assert all(texts[r.doc_id][r.start:r.end].strip() == r.sentence for r in found)
    bad = [r for r in found if any(b.lower() in r.sentence.lower() for b in BAD)]
    assert len(bad) >= 0.97 * len(found)
    assert len({r.doc_id for r in bad}) >= 0.97 * sum(truth.values())


def test_labels_of_held_out_rows_are_not_used(spark, model):
    docs, _, fit = model
    _, labels, _ = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.fitted(docs.repartition(7), spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert np.array_equal(again.grams, fit.grams) and np.allclose(again.weights, fit.weights, atol=1e-6)


def test_edges(spark, model, monkeypatch):
    _, _, fit = model
    long_text = "word and scumbag idiot " * 4000
    rows = [(1, None), (2, ""), (None, "scumbag idiot grobzork"), (3, "... ?! \n"), (4, long_text), (4, long_text), (5, "é" * 3000), (6, "😀")]
    docs = spark.createDataFrame([(i, t and t.encode("utf-16", "surrogatepass").decode("utf-16")) for i, t in rows], "doc_id long, text string")
    whole = {(r.doc_id, round(r.score, 9)) for r in toxicity.scored(docs, fit).collect()}
    assert {(1, 0.0), (2, 0.0), (3, 0.0)} <= whole and len([k for k in whole if k[0] == 4]) == 1
    assert [s for i, s in whole if i is None][0] > 0.3
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert len(list(toxicity._pieces([long_text]))) > 100
    assert "".join(p for _, p in toxicity._parts(long_text)) == long_text


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a text. more"), (None, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        got = toxicity.scored(docs, toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 2
    fit = toxicity.fitted(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.scored(docs.limit(0), fit).count() == 0
