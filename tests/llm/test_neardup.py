"""Near duplicates against brute force on all pairs, with hot groups and chains."""

import itertools
import random
import re

import numpy as np

from tixpark.llm import neardup
from tixpark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, size):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(rows, size, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    sets = {d: sets_of(t, size) for d, t in rows}
    root = {d: d for d in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=90)
    rows, i = [], 0
    for _ in range(60):  # a hot group of near copies, some only linked through others
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
        i += 1
    chain = rng.choices(vocabulary, k=60)
    for k in range(12):  # each near the next, the ends far apart
        chain = chain[2:] + rng.choices(vocabulary, k=2)
        rows.append((i, " ".join(chain)))
        i += 1
    for _ in range(30):
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 50)))))
        i += 1
    rows += [(i + k, rows[3][1].upper()) for k in range(40)]  # exact copies but for case
    i += 40
    for t in [None, "", " \t ", "one", "ONE", "one two", "one  two\n", "É é", "é é", "a b c", "a\x0bb c", "x " * 3000]:
        rows.append((i, t))
        i += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    for size, percent, chunks in ((3, 85, 8), (5, 80, 10)):
        truth = brute(rows, size, percent)
        docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
        got = neardup.near_duplicates(docs, size, percent, chunks).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_nulls_and_repeated_rows(spark):
    t = "one two three four five six"
    rows = [(None, t), (7, t), (7, t), (9, t), (None, "other words that stand alone here"), (None, None), (4, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([
        (None, 4, 7, False), (7, 4, 7, True), (7, 4, 7, True), (9, 4, 7, False), (None, 4, None, True), (None, 0, None, True), (4, 0, 4, True)], key=str)


def test_empty_table_and_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "a b c d e f g", 2), (3, "q", 3)], "doc_id long, text string, node int")
    assert sorted(tuple(r) for r in neardup.keep_one(docs).collect()) == [(1, "a b c d e f g", 2), (3, "q", 3)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_row_of_each_component(spark):
    rng = random.Random(8)
    one, two, three, alone = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    near = one.rsplit(" ", 1)[0] + " other"
    rows = [(None, near, 1), (7, one, 2), (9, one, 3), (9, alone, 4),       # a null id beside ids; an id with a copy and a text of its own
            (None, two, 5), (None, two, 6), (None, two.upper(), 7),         # null ids alone
            (3, three, 8), (3, three, 8), (3, three, 9), (3, three.upper(), 9),   # repeated rows
            (None, None, 10), (None, "", 10), (None, "", 10), (4, " ", 11)]        # empty sets
    rows += [(None, two, 6)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 int").repartition(3)
    for _ in range(2):
        got = [(r.doc_id, (r.text or "").lower(), r.h1) for r in neardup.keep_one(docs).collect()]
        assert sorted((g for g in got if g[1].strip() and g[1] not in (two, three)), key=str) == sorted([(7, one, 2), (9, alone, 4)], key=str)
        assert [g[:2] for g in got if g[1] == two] == [(None, two)] and [g[:2] for g in got if g[1] == three] == [(3, three)]
        assert sorted(g[2] for g in got if not g[1].strip()) == [10, 10, 10, 11]


def test_signature_distance_follows_similarity():
    memo = neardup._WordHashes()
    factors = np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    a = [f"w{i}" for i in range(1000)]
    with np.errstate(over="ignore"):
        x, y = (neardup.shingle_set(" ".join(w), 1, memo) for w in (a, a[100:] + [f"v{i}" for i in range(100)]))
        s, t = (neardup._signature(h, factors).view(np.uint16) for h in (x, y))
    assert abs((s == t).mean() - 900 / 1100) < 0.12


def test_connected_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 300), (300, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
