"""Quality rules by distribution divergence (native: DataFrame functions only).

A document is a histogram over character classes and one over the common words
of its language.  Each language's reference histograms are sums over all its
acceptable documents; a document whose Jensen-Shannon distance from the
reference is too large is rejected.

Common words count as written in lower case.  The references are found in two passes over the narrow table of counts: first
from all documents that pass the base rules, then from those near the first
reference, so that junk does not shape what it is compared with.

Defined cases: a null or blank text has no words and fails the base rules; a
null ``lang`` is a language of its own; a language without fixed list takes the
words of letters that its acceptable documents hold most often, and keeps its
first reference if none is near that; a language without any acceptable document is judged by
the base rules alone; repeated rows count and are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, total

#: The most common words of these languages; those of every other are counted.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un"],
}
N_COMMON = 8
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Guards: a histogram of fewer characters or words says nothing.
MIN_CHARS = 200
#: Distances (0..1).  Far characters reject alone; strange characters need strange words as well.
FAR_CHARS, ODD_CHARS, ODD_WORDS = 0.30, 0.17, 0.20
#: A document this far from the first reference is left out of the second.
TRIM = 0.25

_CLASSES = ["c_lower", "c_upper", "c_digit", "c_blank", "c_symbol", "c_other_ascii", "c_beyond_ascii"]
_BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
_WORDS = [f"w_{i}" for i in range(N_COMMON)] + ["w_other"]


def _left(text: str, keep: str) -> str:
    """SQL: how many characters of ``text`` are in the class ``keep``."""
    return f"length(regexp_replace({text}, '[^{keep}]+', ''))"


def _learned(docs: DataFrame, text: str, lang: str) -> DataFrame | None:
    """``word_lang, learned``: the most common words of each language without fixed list, over its acceptable documents."""
    others = docs.filter(F.col(lang).isNull() | ~F.col(lang).isin(*COMMON_WORDS))
    if others.isEmpty():
        return None
    others = others.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    good = features(others, "lang", "text", "lang", words=True).filter("NOT base_failed")
    counted = good.select("lang", F.explode("parts").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.filter(r"word RLIKE '^[\\p{L}\\p{M}][\\p{L}\\p{M}''’-]*$'")
    # ranks in two levels: no task holds all words of a language
    order = [F.desc("n"), "word"]
    counted = counted.withColumn("b", F.pmod(F.xxhash64("word"), F.lit(256)))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).filter(F.col("r") <= N_COMMON)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= N_COMMON)
    words = top.groupBy(F.col("lang").alias("word_lang")).agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("top"))
    return materialize(words.select("word_lang", F.col("top.word").alias("learned")), "quality-words")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", whole: bool = False,
             learned: DataFrame | None = None, words: bool = False) -> DataFrame:
    """One row of counts per document: the base counts and both histograms; with ``whole`` also the row itself, as ``row``.

    ``learned`` holds the common words of languages without fixed list; ``words`` asks for ``lang, base_failed, parts`` alone.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.lit(0)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"), row.alias("row"))
    # blanks at either end leave an empty part there
    d = d.selectExpr("doc_id", "lang", "t", "row", r"split(t, '[\\x20\\x09-\\x0D]+') AS cut")
    d = d.selectExpr("*", "CAST(cut[0] = '' AS INT) AS lead", "CAST(size(cut) > 1 AND element_at(cut, -1) = '' AS INT) AS trail")
    d = d.selectExpr("doc_id", "lang", "t", "row", "CASE WHEN lead + trail = 0 THEN cut ELSE slice(cut, 1 + lead, size(cut) - lead - trail) END AS parts")
    if learned is None:
        d = d.withColumn("learned", F.lit(None).cast("array<string>"))
    else:
        d = d.join(learned, d["lang"].eqNullSafe(learned["word_lang"]), "left")
    cases = " ".join(f"WHEN '{k}' THEN array({', '.join(repr(w) for w in v)})" for k, v in COMMON_WORDS.items())
    d = d.selectExpr("*", "size(parts) AS n_words", "array_join(parts, '') AS joined",
                     r"filter(split(t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS lines",
                     f"CASE lang {cases} ELSE coalesce(learned, CAST(array() AS ARRAY<STRING>)) END AS common")
    d = d.selectExpr("doc_id", "lang", "t", "row", "parts", "n_words", "lines", "common", "length(joined) AS word_chars",
                     "regexp_replace(joined, '[a-z]+', '') AS rest", "filter(parts, x -> array_contains(common, x)) AS known")
    # three-word windows as hashes; sorted together with their places only where one is found twice
    d = d.selectExpr(
        "*",
        "CASE WHEN n_words < 3 THEN array() ELSE zip_with(zip_with(slice(parts, 1, n_words - 2), slice(parts, 2, n_words - 2), "
        "(a, b) -> xxhash64(a, b)), slice(parts, 3, n_words - 2), (h, c) -> xxhash64(h, c)) END AS grams")
    d = d.selectExpr(
        "*",
        "CASE WHEN size(array_distinct(grams)) = size(grams) THEN NULL "
        "ELSE sort_array(transform(grams, (h, i) -> struct(h, i))) END AS placed")
    d = d.selectExpr(
        "*",
        "CASE WHEN placed IS NULL THEN NULL ELSE sort_array(transform(filter("
        "zip_with(zip_with(placed, slice(placed, 2, size(placed)), (a, b) -> struct(a.h AS h, a.i AS i, b.h AS next)), "
        "concat(array(struct(CAST(NULL AS BIGINT) AS h, 0 AS i)), slice(placed, 1, size(placed) - 1)), "
        "(x, y) -> struct(x.i AS i, coalesce(x.h = x.next, false) OR coalesce(x.h = y.h, false) AS twice)), "
        "z -> z.twice), z -> z.i)) END AS at")
    # a place covers three words; neighbours overlap
    d = d.selectExpr(
        "*",
        "CASE WHEN at IS NULL OR size(at) = 0 THEN 0 ELSE 3 + aggregate(zip_with(slice(at, 2, size(at)), slice(at, 1, size(at) - 1), "
        "(n, p) -> least(3, n - p)), 0, (s, x) -> s + coalesce(x, 0)) END AS n_repeat_words",
        *[f"CAST(size(filter(known, x -> x = get(common, {i}))) AS BIGINT) AS w_{i}" for i in range(N_COMMON)])
    if words:
        return d.selectExpr("lang", f"{_BASE_FAILED} AS base_failed", "parts")
    sums = " + ".join(f"w_{i}" for i in range(N_COMMON))
    beyond = r"length(regexp_replace(rest, '[\\x00-\\x7F]+', ''))"
    d = d.selectExpr(
        "doc_id", "lang", "row", "CAST(n_words AS BIGINT) AS n_words", "CAST(word_chars AS BIGINT) AS word_chars",
        f"CAST({_left('rest', '#*$%&|<>')} AS BIGINT) AS n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "CAST(n_repeat_words AS BIGINT) AS n_repeat_words",
        "length(t) AS n_chars", "length(rest) AS n_rest",
        f"{_left('rest', 'A-Z')} AS c_upper", f"{_left('rest', '0-9')} AS c_digit", f"{beyond} AS c_beyond_ascii",
        *[f"w_{i}" for i in range(N_COMMON)], f"n_words - ({sums}) AS w_other")
    return d.selectExpr(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"{_BASE_FAILED} AS base_failed", "n_chars",
        "word_chars - n_rest AS c_lower", "c_upper", "c_digit", "n_chars - word_chars AS c_blank", "n_symbols AS c_symbol",
        "n_rest - c_upper - c_digit - n_symbols - c_beyond_ascii AS c_other_ascii", "c_beyond_ascii", *_WORDS, *["row"] * whole)


def _references(counts: DataFrame) -> DataFrame:
    """The two reference histograms (as shares) of each language of ``counts``."""
    sums = counts.groupBy("lang").agg(*[F.sum(c).cast("double").alias(c) for c in _CLASSES + _WORDS])
    chars, words = total([F.col(c) for c in _CLASSES]), total([F.col(c) for c in _WORDS])
    return sums.select(F.col("lang").alias("ref_lang"), F.array(*[F.col(c) / chars for c in _CLASSES]).alias("ref_chars"),
                       F.array(*[F.col(c) / words for c in _WORDS]).alias("ref_words"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    def half(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))))


def _compared(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """Add the distances of each document from its language's reference (null where the guards speak)."""
    c = counts.join(refs, counts["lang"].eqNullSafe(refs["ref_lang"]), "left")
    chars = F.when(F.col("n_chars") >= MIN_CHARS, F.array(*[F.col(x) / F.col("n_chars") for x in _CLASSES]))
    words = F.when(F.col("n_words") >= MIN_WORDS, F.array(*[F.col(x) / F.col("n_words") for x in _WORDS]))
    c = c.withColumn("p_chars", chars).withColumn("p_words", words)
    return (c.withColumn("chars_distance", _distance(F.col("p_chars"), F.col("ref_chars")))
            .withColumn("words_distance", _distance(F.col("p_words"), F.col("ref_words")))
            .drop("p_chars", "p_words", "ref_chars", "ref_words", "ref_lang"))


def _verdicts(docs: DataFrame, doc_id: str, text: str, lang: str, whole: bool = False) -> DataFrame:
    """The counts of each row with both distances and ``kept``; with ``whole`` also the row itself."""
    learned = _learned(docs, text, lang)
    counts = materialize(features(docs, doc_id, text, lang, whole, learned), "quality-counts")
    good = ~F.col("base_failed")
    refs = _references(counts.filter(good))
    first = _compared(counts, refs)
    near = F.coalesce(F.greatest("chars_distance", "words_distance"), F.lit(0.0)) <= TRIM
    again = _references(first.filter(good & near))
    if learned is not None:
        lone = refs.filter(F.col("ref_lang").isNull() | ~F.col("ref_lang").isin(*COMMON_WORDS))
        mine = again.select(F.col("ref_lang").alias("_lang"))
        again = again.union(lone.join(mine, lone["ref_lang"].eqNullSafe(mine["_lang"]), "left_anti"))
    last = _compared(counts, again)
    far = F.col("chars_distance") > FAR_CHARS
    odd = (F.col("chars_distance") > ODD_CHARS) & (F.col("words_distance") > ODD_WORDS)
    return last.withColumn("kept", good & ~F.coalesce(far | odd, F.lit(False)))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: counts, ``base_failed``, both distances and ``kept``."""
    return _verdicts(docs, doc_id, text, lang).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "chars_distance", "words_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep, each by its own verdict; the rows are written beside their counts."""
    return _verdicts(docs, "doc_id", "text", "lang", whole=True).filter("kept").select("row.*")
