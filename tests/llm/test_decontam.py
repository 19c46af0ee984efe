"""Decontamination against brute-force edit distance over all parts of a text."""

import random

from tixpark.llm import decontam


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def hurt(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = "z"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "q")
    return "".join(out)


def test_finds_all_within_the_budget_and_nothing_else():
    rng = random.Random(11)
    items = [(i, words(rng, rng.randrange(8, 40))) for i in range(12)]
    items = [(i, decontam.normal(t)) for i, t in items if len(t) >= decontam.MIN_CHARS]
    index = decontam.Index(items)
    texts = []
    for i, t in items:
        for n in (0, decontam._budget(len(t)), decontam._budget(len(t)) + 4):
            texts.append(f"{words(rng, rng.randrange(0, 30))} {hurt(rng, t, n)} {words(rng, rng.randrange(0, 30))}")
    texts += [None, "", words(rng, 200), items[0][1], items[1][1][:-1], items[2][1][: len(items[2][1]) // 2]]
    found = {(r, index.ids[i]): e for r, i, e, _, _ in decontam.find_all(index, texts)}
    for r, t in enumerate(texts):
        for i, item in items:
            edits = least_edits(item, decontam.normal(t or ""))
            if edits <= decontam._budget(len(item)):
                assert found.pop((r, i)) == edits
    assert not found


def test_windows_of_a_long_text_lose_nothing(monkeypatch):
    rng = random.Random(2)
    item = decontam.normal(words(rng, 20))
    index = decontam.Index([(5, item)])
    monkeypatch.setattr(decontam, "WINDOW", 700)
    for shift in range(0, 700, 37):
        text = "x" * (400 + shift) + " " + item.upper() + " " + "y" * 900
        (row, number, edits, shared, at), = decontam.find_all(index, ["", None, text])
        assert (row, number, edits, at) == (2, 0, 0, 401 + shift)


def test_rows_blocks_and_edge_cases(spark):
    rng = random.Random(3)
    a, b = words(rng, 20), words(rng, 25)
    bench = spark.createDataFrame([(1, a, 0), (2, b, 0), (3, None, 0), (4, "", 0), (5, "short", 0), (None, a, 0), (1, a, 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(10, f"so {a.upper()} it is", "x"), (11, "clean " + words(rng, 50), "x"), (12, None, "x"), (None, b, "x"), (10, f"so {a.upper()} it is", "x")],
                                 "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()), key=str)
    assert got == sorted([(10, 1), (10, 1), (10, None)] * 2 + [(None, 2)], key=str)
    assert [r.doc_id for r in decontam.keep_clean(docs, bench).collect()] == [11, 12]
    assert decontam.keep_clean(docs, bench).columns == docs.columns
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.matches(docs.limit(0), bench).count() == 0
    assert decontam.keep_clean(docs, bench.limit(0)).count() == 5
    parts = list(decontam.blocks(bench, block_chars=50))
    assert len(parts) == 4 and sum(map(len, parts)) == 4


def test_separated_documents_do_not_make_a_match():
    rng = random.Random(4)
    item = decontam.normal(words(rng, 20))
    index = decontam.Index([(1, item)])
    half = len(item) // 2
    assert decontam.find_all(index, [item[:half], item[half:]]) == []
    assert [(r, e) for r, _, e, _, _ in decontam.find_all(index, ["", item, item + " more"])] == [(1, 0), (2, 0)]


def test_items_longer_than_a_window(monkeypatch):
    rng = random.Random(8)
    item, other = words(rng, 400), words(rng, 900)
    monkeypatch.setattr(decontam, "WINDOW", 500)      # the item alone is several windows long
    index = decontam.Index([(1, decontam.normal(item))])
    found = decontam.find_all(index, [other + " " + item + " " + other, other, item])
    assert {(r, i) for r, i, *_ in found} == {(0, 0), (2, 0)}
