"""Quality rules: base counts against a plain count, edge cases, and what is kept."""

import random
import re

import pytest

from tixpark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def prose(n, seed=0):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "a", "in", "is", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.25 else "".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) + "." * (i % 9 == 8)
                    for i in range(n))


TEXTS = [None, "", " \t\n", "one", " lead and trail ", "a b c a b c", "a b c d a b c e a b c", "x\nx\n\nx\n y\ny", "é ü ß €", "a\x0bb\x0cc\rd", "# * $%&|<> a",
         "a " * 5000, prose(400), prose(300, 3), "same same same same", "tail\n", "\nhead"]


def test_counts_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words string")
    for r in quality.judged(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(spark):
    good = [(i, prose(200 + i, i), "en") for i in range(20)]
    junk = [(100, re.sub(r" ", "%%% ", prose(300)), "en"), (101, " | ".join(w for w in prose(300).split() if len(w) > 4), "en"), (102, "buy " * 200, "en")]
    nulls = [(None, prose(200), "en"), (200, prose(200), None), (201, None, None), (100, prose(220), "en")]
    kept = {}
    for r in quality.judged(spark.createDataFrame(good + junk + nulls, "doc_id long, text string, lang string")).collect():
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert all(kept[i] == [True] for i in range(20)) and kept[None] == [True] and kept[200] == [True] and kept[201] == [False]
    assert sorted(kept[100]) == [False, True] and kept[101] == [False] and kept[102] == [False]


def test_guards_leave_short_texts_to_the_base_rules(spark):
    r = quality.judged(spark.createDataFrame([(1, "a %% " * 3, "en"), (2, prose(90), "en")], "doc_id long, text string, lang string")).collect()
    assert {x.doc_id: x.chars_distance is None for x in r} == {1: True, 2: False}


def test_keep_good_keeps_all_columns_and_the_empty_table(spark):
    docs = spark.createDataFrame([(1, prose(200), "en", "x", 5), (2, "junk", "en", "y", 6)], "doc_id long, text string, lang string, kept string, n_words int")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, prose(200), "en", "x", 5)]
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.judged(docs.limit(0)).columns[0] == "doc_id"


def test_keep_good_judges_each_row_by_itself(spark):
    docs = spark.createDataFrame([(None, prose(200), "en"), (None, "junk", "en"), (None, prose(210, 1), "en"), (5, prose(220, 2), "en"), (5, "buy " * 200, "en"),
                                  (6, prose(230, 3), "en"), (6, prose(230, 3), "en"), (7, None, None)], "doc_id long, text string, lang string")
    want = [(None, prose(200)), (None, prose(210, 1)), (5, prose(220, 2)), (6, prose(230, 3)), (6, prose(230, 3))]
    assert sorted(((r.doc_id, r.text) for r in quality.keep_good(docs).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("lang", [None, "xx"])
def test_every_language_has_a_word_reference(spark, lang):
    good = [(i, prose(200 + i, i), lang) for i in range(20)] + [(50, prose(200), "en")]
    junk = [(100 + i, " | ".join(w for w in prose(300, i).split() if len(w) > 4), lang) for i in range(4)]
    got = quality.judged(spark.createDataFrame(good + junk + [(60, "only one", "yy")], "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.kept for r in got} == {d: d <= 50 for d, *_ in good + junk} | {60: False}
    assert all(r.words_distance > quality.ODD_WORDS and quality.ODD_CHARS < r.chars_distance <= quality.FAR_CHARS for r in got if r.doc_id >= 100)


def test_common_words_are_counted_over_acceptable_documents(spark):
    docs = [("xx", "el ra " * 3 + " ".join(f"u{i}" for i in range(60))), ("xx", "ra mo | 7 " + " ".join(f"v{i}" for i in range(60))), ("xx", "buy " * 500), ("en", prose(90))]
    got = quality._learned(spark.createDataFrame(docs, "lang string, text string"), "text", "lang").collect()
    assert [(r.word_lang, r.learned) for r in got] == [("xx", ["ra", "el", "mo"])]
    assert quality._learned(spark.createDataFrame(docs[3:], "lang string, text string"), "text", "lang") is None


def test_reference_is_not_shaped_by_junk(spark):
    rows = [(i, prose(200 + i, i), "en") for i in range(20)] + [(100 + i, re.sub(" ", "%%%% ", prose(300 + i)), "en") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] == (i < 100) for i in kept)


@pytest.mark.parametrize("p, q, d", [([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0)])
def test_distance(spark, p, q, d):
    from pyspark.sql import functions as F
    row = spark.range(1).select(quality._distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()
    assert abs(row.d - d) < 1e-12
