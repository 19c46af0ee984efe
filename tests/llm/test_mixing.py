"""Mixing: targets against a plain loop, permutations, near targets, bounds, reruns, rendered words."""

import re
from collections import Counter

import numpy as np
import pytest

from tixpark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in sources if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 3, None: 50}, {"B": 5, "a": 5, "é": 500, "z": 1}, {"x": 7}, {None: 9}, {"a": 0, "b": 10},
    {"a": 1, "b": 1, "c": 1, "d": 100000}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        for key in (1, 12345678901234567890):
            out = mixing._permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))
    a, b = (mixing._permuted(np.arange(500), np.full(500, 500), np.full(500, k, np.uint64)) for k in (1, 2))
    assert (a == b).mean() < 0.05 and (a == np.arange(500)).mean() < 0.05


def corpus(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i * 37 % 211)), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(240)]
    rows += [(1000, None, "hot", 0), (1000, None, "hot", 0), (1001, " \t", None, 0), (1002, " lead " * 300, None, 0), (None, "n " * 200, "hot", 0), (7, rows[7][1], rows[7][2], 0),
             (1003, "x y", "tiny", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)


def test_taken_is_near_target_and_within_bounds(spark):
    rows, docs = corpus(spark)
    got = mixing.taken(docs, block=16).collect()
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((d, len(WORD.findall(t or "")))) for d, t, _, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(2), block=16).collect()))
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 32


def test_mixed_rows_hold_the_words_that_are_taken(spark):
    rows, docs = corpus(spark)
    docs = docs.withColumnRenamed("size", "n_chars")
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns
    got = out.collect()
    taken = Counter()
    for r in mixing.taken(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    texts = {}
    for d, t, _, _ in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        n = WORD.findall(r.text)
        words[r.doc_id] += len(n)
        assert r.n_chars == len(r.text)
        whole = [WORD.findall(t or "") for t in texts[r.doc_id]]
        assert any(not Counter(n) - Counter(w) for w in whole)
    assert +words == +taken
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0


def test_slots_follow_the_draws(spark):
    rows, docs = corpus(spark)
    sources, pieces, slots = mixing.mix(docs, block=16, shard_slots=64)
    plan = {r.code: (r.slots, r.blocks) for r in sources.collect()}
    got = slots.collect()
    for code, (n, blocks) in plan.items():
        mine = [r for r in got if r.code == code]
        assert sorted(r.slot for r in mine) == list(range(n))
        times = Counter(r.block for r in mine)
        assert not times or max(times.values()) - min(times[b] for b in range(blocks)) <= 1
    sizes = Counter(r.shard for r in got)
    assert abs(max(sizes.values()) - 64) <= 24


def test_thousands_of_equal_rows(spark):
    rows = [(i % 3 or None, "the same words of a row " * 5, "hot") for i in range(6000)] + [(10 + i, f"other words {i} " * 20, f"s{i}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken, out = mixing.taken(docs, block=16).collect(), mixing.mixed(docs, block=16).collect()
    assert len(taken) == len(rows)
    assert sum(r.taken for r in taken) == sum(len(WORD.findall(r.text)) for r in out) > 0
    assert all(r.taken <= 3 * r.size for r in taken)
    per = Counter((r.doc_id, r.source) for r in out)
    assert all(n <= 3 * m for n, m in ((per[k], Counter((d, s) for d, _, s in rows)[k]) for k in per))


def test_columns_with_clashing_names(spark):
    names = ["_tie", "_words", "_id", "_nth", "_place", "row", "body", "copy", "spans", "whole", "words", "size", "a.b", "code"]
    rows = [(i, f"d{i} " * (20 + i), "s", 1, *[f"{n}{i}" for n in names]) for i in range(20)]
    schema = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    out = mixing.mixed(spark.createDataFrame(rows, schema), block=16)
    assert out.columns == ["doc_id", "text", "source", "n_chars", *names]
    got = out.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names) and all(r.n_chars == len(r.text) for r in got)
    assert all(set(r.text.split()) == {f"d{r.doc_id}"} for r in got)
