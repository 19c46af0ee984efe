"""Periodic runs: every document against a plain search of all lags, planted tails, edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

from tixpark.llm import runs


def plain_runs(words):
    """All runs by their definition: for every lag the maximal stretches, the smallest period checked at every divisor."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                piece = words[i:j + q]
                if not any(all(a == b for a, b in zip(piece, piece[d:])) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = [w for w in _split(text)]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(kept))


def _split(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        kind, alphabet = r.random(), r.choice([1, 2, 3, 50, 5000])
        words = [f"w{r.randrange(alphabet)}" for _ in range(r.randrange(0, 260))]
        for _ in range(r.randrange(0, 4)):  # runs side by side and one inside the other
            period = r.choice([1, 2, 3, 5, 8, 9, 12, 15, 16, 17, 24, 31, 32, 33, 40])
            unit = [f"w{r.randrange(alphabet)}" for _ in range(period)]
            if kind < 0.3:
                unit = (unit * 6)[:max(6, int(4.5 * period))] + ["x"]
            tail = unit * r.randrange(3, 7)
            at = r.randrange(len(words) + 1)
            words[at:at] = tail[:len(tail) - r.randrange(0, period)]
        yield " ".join(words)


def test_runs_of_against_plain_search():
    some = [t.split() for t in texts(3, 250)]
    for group in (some, some[:1], [[]], [[], ["a"] * 6, ["a"] * 5]):
        assert runs.runs_of(group) == [plain_runs(w) for w in group]


def test_digests(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(11, 300))]
    rows += [(None, "a b " * 9, "x"), (None, None, None), (7, None, "x"), (9001, "", "x"), (9002, "    \t\r\n\x0b\x0c", "x"),
             (5, "z z z z z z", "x"), (5, "z z z z z z", "x"), (9003, "a b c d e f g h i " * 4 + "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(5)
    got = sorted((tuple(r) for r in runs.digests(docs).collect()), key=repr)
    assert got == sorted((plain_digest(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_long_text_and_empty_table(spark, monkeypatch):
    unit = [f"u{i}" for i in range(3001)]
    words = ["a"] * 40000 + ["b"] + unit * 7 + ["c"] + ["d", "e"] * 30000
    assert runs.runs_of([words, ["q"]]) == [[(0, 40000, 1), (40001, 7 * 3001, 3001), (61009, 60000, 2)], []]
    monkeypatch.setattr(runs, "GROUP_WORDS", 10)
    docs = spark.createDataFrame([(1, "a b " * 6)], "doc_id long, text string")
    assert [tuple(r.runs[0]) for r in runs.runs(docs).collect()] == [(0, 12, 2)]
    assert runs.collapsed(docs).first().collapsed == "a b"
    assert runs.digests(docs.limit(0)).count() == 0
