"""Line dedup against edit distances of all pairs of lines."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tixpark.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]")


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def brute(docs):
    first = {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            if WORD.search(line) and line not in first:
                first[line] = ((d is not None, d or 0), i)
    gone = set()
    long = [x for x in first if len(x) >= linededup.MIN_CHARS]
    for a, b in itertools.combinations(long, 2):
        if within_one(a, b):
            gone.add(max(a, b, key=first.get))
    out = {}
    for d, t in docs:
        if t is not None:
            key = (d is not None, d or 0)
            out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if not WORD.search(x) or first[x] == (key, i) and x not in gone)
    return out


def corpus():
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdé 😀", k=rng.randrange(20, 60))) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            x = rng.choice(base)
            kind, i = rng.randrange(6), rng.randrange(len(x))
            lines.append([x, x, x[:i] + x[i + 1:], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1:], x + " far away"][kind])
        docs.append((d, "\n".join(lines + rng.choices(["", " \t", "short", "shorx"], k=2))))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, "a" * 30 + "\n" + "a" * 31 + "\n" + "a" * 32), (104, "w" * 5000 + "\n" + "w" * 4999 + "v"), (105, "\r\nx\r\n")]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, line int").repartition(4)
    got = linededup.deduplicated(frame).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert r.text == want.get(r.doc_id), r.doc_id
        before = dict(docs)[r.doc_id]
        assert r.n_lines == (0 if before is None else len(before.split("\n")))
        if r.text:
            assert r.n_lines - r.n_dropped == len(r.text.split("\n"))


def test_repeated_rows_stay_alike(spark):
    t = "a line that is long enough\nand one more of them"
    got = linededup.deduplicated(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, t), (1, t), (2, "")]
    assert linededup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_frequent_line_and_its_variants(spark):
    base = "this line is everywhere in the corpus"
    docs = [(i, f"{base[:i % 30]}#{base[i % 30:]}" if i % 2 else base) for i in range(200)]
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: base if i == 0 else "" for i in range(200)}


def test_only_documents_that_lose_lines_are_shuffled_with_their_texts(spark):
    """Documents that lose nothing, and the rows that the bitmap names too many of, pass as they are."""
    line = "a line that is long enough"
    docs = [(None, line), (1, line), (2, f"{line}\n\nbut another one stays"), (3, "nothing goes\n here"), (4, ""), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    d = frame.withColumn("tie", F.xxhash64("text")).withColumn("d1", F.xxhash64("doc_id", "tie"))
    stays = d.filter("doc_id IS NULL OR doc_id IN (2, 3)").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.expr("CASE WHEN doc_id IS NULL THEN array(0) WHEN doc_id = 2 THEN array(2) ELSE array(0, 1) END").alias("_stay"))
    assert sorted((r["_id"], r["_stay"]) for r in linededup._cut_documents(d, stays).collect()) == [(1, []), (2, [2])]
    want = {None: line, 1: "", 2: "\nbut another one stays", 3: "nothing goes\n here", 4: "", 5: None}
    assert {r.doc_id: r.text for r in linededup.deduplicated(frame).collect()} == want
