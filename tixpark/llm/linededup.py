"""Line deduplication by a deletion-neighbourhood join (native: DataFrame functions only).

The lines of all documents are in one order: doc_id, hash of the text, line
number.  A line goes if an equal line, or one within one edit (a character
inserted, deleted or replaced), comes before it.  Lines without a word stay as
they are; lines shorter than ``MIN_CHARS`` have no near lines, only equal ones.

Equal lines are one node, which stands at its first place.  The deletion
neighbourhood of a line is every string with one character deleted, and the
line itself.  Two lines are within one edit if one line is a variant of the
other, or both give the same variant by a deletion at the same place.  Variants
are hashed keys: sums of hashes of (character, place), so that all deletions of
a line come from two running sums and a line of any length costs its length.

Variants are many, so they are made only for lines that can have a near line.
Lines within one edit are equal but for the part that the edit lies in: first
halves are compared for all lines, then finer parts for those left; only the
places in the parts that are left are deleted.

A bucket of equal variants is never expanded into pairs: all its members are
near each other, so each needs only the first of them.  That candidate is
verified by edit distance on the texts, and the earliest verified one is kept.

Defined cases: a null text stays null and has no lines; a null doc_id comes
first; rows that repeat doc_id and text are one document and stay alike; a
document may lose all its lines and is then the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_CHARS = 20
#: Bits of the pre-filter: 2 MB at most.
BITMAP = 1 << 24
FINE_PARTS = 32
_WORD = r"[^\x20\x09-\x0D]"


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``place (doc_id, tie, no), d1, line`` for every line with a word; d1 is a digest of the line."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("no", "line"))
    return d.filter(F.col("line").rlike(_WORD)).select(F.struct("doc_id", "tie", "no").alias("place"), F.xxhash64("line").alias("d1"), "line")


def _distinct(all_lines: DataFrame) -> DataFrame:
    """``d1, d2`` (digest of 128 bits) and ``first`` place, one row per different line."""
    return all_lines.select("place", "d1", F.xxhash64(F.lit(2), "line").alias("d2")).groupBy("d1", "d2").agg(F.min("place").alias("first"))


def _with_near(some_lines: DataFrame, parts: int) -> DataFrame:
    """``d1, lo, hi``: the lines of at least ``MIN_CHARS`` that are equal to another line but for one of
    ``parts`` parts, with the places ``lo <= at < hi`` that an edit may then be at.

    Lines within one edit have a common front and back that together are no
    shorter than the longer line less one.  With ``base`` the length less one,
    down to a multiple of four (neighbours in length share it, or the longer
    one takes that of the class below too), the edit lies in some part of
    ``base``, and the front before and the back after that part are the same.
    """
    sized = some_lines.select("d1", "line", F.length("line").alias("size")).filter(F.col("size") >= MIN_CHARS)
    bases = "explode_outer(CASE WHEN (size - 1) % 4 = 0 THEN array(size - 1, size - 5) ELSE array((size - 1) DIV 4 * 4) END) AS base"
    front, back = f"CAST(base * j DIV {parts} AS INT)", f"CAST(base - base * (j + 1) DIV {parts} AS INT)"
    # outer explodes: inner ones would infer filters that compute their arrays once more
    ends = sized.selectExpr("d1", "line", "size", bases).selectExpr("d1", "line", "size", "base", f"explode_outer(sequence(0, {parts - 1})) AS j")
    ends = ends.selectExpr("d1", f"xxhash64(j, base, left(line, {front}), right(line, {back})) AS end", f"{front} AS lo", f"size - {back} AS hi")
    shared = ends.groupBy("end").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).filter("least <> most").select("end")
    return ends.join(shared, "end", "left_semi").select("d1", "lo", "hi")


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_in``: whether their ``d1`` may be in ``wanted (d1)``, by a bitmap of ``BITMAP`` bits:
    4 KB for each 32768, so its size is bounded and it is broadcast."""
    maps = wanted.select(F.expr(f"bitmap_bucket_number(pmod(d1, {BITMAP}L))").alias("_part"), F.expr(f"bitmap_bit_position(pmod(d1, {BITMAP}L))").alias("_at"))
    maps = maps.groupBy("_part").agg(F.expr("bitmap_construct_agg(_at)").alias("_map"))
    r = rows.withColumn("_part", F.expr(f"bitmap_bucket_number(pmod(d1, {BITMAP}L))")).join(F.broadcast(maps), "_part", "left")
    at = F.expr(f"bitmap_bit_position(pmod(d1, {BITMAP}L))")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1
    return r.withColumn("_in", F.coalesce(bit, F.lit(False))).drop("_part", "_map")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``d1`` may be in ``wanted (d1)``.  Spares the join that follows most of the rows."""
    return _marked(rows, wanted).filter("_in").drop("_in")


def _variants(some_lines: DataFrame) -> DataFrame:
    """``first, kind, key`` of ``some_lines (first, line, parts)``: the line itself ('w'), and the deletions
    inside its parts, alone ('d') and with their place ('s')."""
    chars = some_lines.select("first", "parts", F.length("line").alias("size"), F.posexplode_outer(F.split("line", "")).alias("at", "c")).filter("at < size")

    def half(seed: int, shift: int) -> Column:
        # 32 bits each: a sum over 2^31 characters cannot overflow
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "c", F.col("at") - shift), 32)

    here = [half(seed, 0).alias(f"a{seed}") for seed in (1, 2)] + [half(seed, 1).alias(f"b{seed}") for seed in (1, 2)]
    inside = F.exists("parts", lambda p: (F.col("at") >= p["lo"]) & (F.col("at") < p["hi"]))
    chars = chars.select("first", "size", "at", inside.alias("inside"), *here)
    line = Window.partitionBy("first").orderBy("at")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    ends = Window.partitionBy("first").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = []
    for k in (1, 2):
        left = F.coalesce(F.sum(f"a{k}").over(before), F.lit(0))
        right = F.sum(f"b{k}").over(ends) - F.sum(f"b{k}").over(after)
        sums += [(left + right).alias(f"v{k}"), F.sum(f"a{k}").over(ends).alias(f"w{k}")]
    cut = chars.select("first", "size", "at", "inside", *sums).filter("inside OR at = 0")
    variant = F.xxhash64(F.col("size") - 1, F.col("v1"), F.col("v2"))
    kinds = F.array(F.struct(F.when(F.col("inside"), F.lit("d")).alias("kind"), variant.alias("key")),
                    F.struct(F.when(F.col("inside"), F.lit("s")).alias("kind"), F.xxhash64(F.lit("s"), "at", variant).alias("key")),
                    F.struct(F.when(F.col("at") == 0, F.lit("w")).alias("kind"), F.xxhash64("size", "w1", "w2").alias("key")))
    return cut.select("first", F.inline(kinds)).filter(F.col("kind").isNotNull())


def _candidates(variants: DataFrame) -> DataFrame:
    """``first, near``: of each bucket that a line is in, the earliest line near to it."""
    def least(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("first")))

    buckets = variants.groupBy("key").agg(least("w").alias("w"), least("d").alias("d"), least("s").alias("s"), F.max("first").alias("last"))
    buckets = buckets.filter("(w IS NOT NULL AND d IS NOT NULL) OR s < last")
    near = F.expr("CASE kind WHEN 'w' THEN d WHEN 'd' THEN w ELSE s END")
    found = variants.join(buckets, "key").select("first", near.alias("near"))
    return found.filter(F.col("near") < F.col("first")).distinct()


def _near_lines(all_lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """``first`` of the different lines that have an earlier near line, verified."""
    wanted = materialize(_with_near(all_lines, 2).select("d1").distinct(), "lines-wanted")
    some = _among(all_lines.select("d1", F.xxhash64(F.lit(2), "line").alias("d2"), "line"), wanted).join(wanted, "d1", "left_semi")
    firsts = distinct.join(wanted, "d1", "left_semi")
    some = materialize(some.join(firsts, ["d1", "d2"]).select("first", "d1", "line").distinct(), "lines-some")
    # at most two parts for each of FINE_PARTS in a row
    parts = _with_near(some, FINE_PARTS).groupBy("d1").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    some = materialize(some.join(parts, "d1").select("first", "line", "parts"), "lines-near")
    pairs = _candidates(materialize(_variants(some), "lines-variants"))
    texts = pairs.join(some.select("first", "line"), "first").join(some.select(F.col("first").alias("near"), F.col("line").alias("other")), "near")
    return texts.filter(F.levenshtein("line", "other", 1) >= 0).select("first").distinct()


def _cut_documents(d: DataFrame, stays: DataFrame) -> DataFrame:
    """``d1, _id, _tie, _stay``: the documents that lose a line, with the lines with a word that stay; no text is shuffled."""
    words = F.expr(f"size(filter(split(text, '\n'), x -> x RLIKE '{_WORD}'))".replace("\\", "\\\\"))
    sizes = d.filter("text IS NOT NULL").select("doc_id", "tie", "d1", words.alias("_words")).distinct()
    x = sizes.join(stays, sizes["doc_id"].eqNullSafe(F.col("_id")) & (sizes["tie"] == F.col("_tie")), "left")
    stay = F.coalesce("_stay", F.array().cast("array<int>"))
    return x.filter(F.col("_words") > F.size(stay)).select("d1", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), stay.alias("_stay"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, text`` without the lines that go, ``n_lines`` and ``n_dropped``."""
    every = lines(docs, doc_id, text)
    distinct = materialize(_distinct(every), "lines-distinct")
    near = materialize(_near_lines(every, distinct), "lines-dropped")
    # the only place of a line that may stay is its first
    stays = distinct.join(near, "first", "left_anti").select(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie"), F.col("first.no").alias("no"))
    stays = stays.groupBy("_id", "_tie").agg(F.collect_list("no").alias("_stay"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie")).withColumn("d1", F.xxhash64("doc_id", "tie"))
    cuts = materialize(_cut_documents(d, stays), "documents-cut")
    d = _marked(d, cuts.select("d1")).withColumn("cut", F.split("text", "\n"))
    size = F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_lines")
    whole = d.filter("NOT _in").select("doc_id", "text", size, F.lit(0).cast("long").alias("n_dropped"))
    # merged at every size: the list of documents that lose lines grows with the input
    d = d.filter("_in").drop("d1").join(cuts.drop("d1").hint("merge"), d["doc_id"].eqNullSafe(F.col("_id")) & (d["tie"] == F.col("_tie")), "left")
    blank = F.expr(f"filter(transform(cut, (x, i) -> CASE WHEN NOT x RLIKE '{_WORD}' THEN i END), i -> i IS NOT NULL)".replace("\\", "\\\\"))
    kept = F.array_sort(F.array_union("_stay", blank))
    d = d.withColumn("kept", F.when(F.col("_tie").isNotNull(), kept).otherwise(F.expr("transform(cut, (x, i) -> i)")))     # the bitmap may name too many
    some = d.select("doc_id", F.expr("CASE WHEN text IS NOT NULL THEN array_join(transform(kept, i -> cut[i]), '\n') END").alias("text"), size,
                    F.coalesce(F.size("cut") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"))
    return whole.unionByName(some)
