"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct word shingles.  Its signature is one
b-bit MinHash value for each of ``4 * chunks`` permutations (b = 16), packed by
four into longs.  The distance of two signatures is the number of values that
differ.  Split by pigeonhole into ``chunks`` parts of four values, signatures
within distance ``2 * chunks - 1`` agree in some part but for one value at
most; so each part is indexed once for every value left out, and all pairs
within that distance meet in an index bucket.  (Eight chunks: 15 of 32 values
may differ.  At a Jaccard similarity of 0.85 a value differs with probability
0.15, and more than 15 of 32 do with probability 3e-6.)  What meets is confirmed
on the full shingle sets, so there are no false links.

Equal sets are one node before any join.  Only the components are asked for, so
a bucket is not expanded into its pairs: rounds of stars link its members to one
hub, and what is left to compare exactly are pairs of different components.
That last join compares every such pair.

A pair is only brought to its full sets if two exact bounds allow the
similarity: the sizes, and an odd sketch.  The sketch has a bit for each of
``SKETCH`` hash values, set if an odd number of the set's shingles have it; the
bits in which two sketches differ are never more than the shingles in which
the sets differ.

Defined cases: a null, empty or blank text has an empty set, links with nothing
and is its own component; a text of fewer words than a shingle is one shingle;
rows of one doc_id with one text are one document; rows of one doc_id with
different texts are nodes of their own that share the id; a null doc_id is
never a component's id, and a component of such rows alone has the id null and
marks them all.  ``keep_one`` thins a table: it keeps one row of each component,
also of null ids and of repeated rows, and every row with an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import joined_components

LANES, BITS = 4, 16
SKETCH, FOLDED = 1024, 8
MEMO = 300_000
STAR_ROUNDS = 3
#: The bits of each value in a signed long.
_LANE = [0xFFFF << (BITS * j) if j < LANES - 1 else -(1 << BITS * j) for j in range(LANES)]
#: What a row goes by: its id and a 128-bit hash of its text.
_KEY = ["doc_id", "h1", "h2"]
_HASHES = ["xxhash64({0}) AS h1", "xxhash64(1, {0}) AS h2"]
_MIX = [np.uint64(xxhash.xxh64_intdigest(f"mix{i}") | 1) for i in range(16)]


class _WordHashes(dict):
    """64-bit hash of a word; forgets all when it has become large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[0]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; lower-cases A-Z only, words end at ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += w[i:i + n] * _MIX[1 + i]
    return np.unique(_mixed(total))


def _signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The packed signature, one int64 for every four values."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (factors[:, None] * hashes[None, at:at + 4096]).min(axis=1), out=least)
    values = _mixed(least) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return (values.reshape(-1, LANES) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch, as int64s."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").astype(np.int64)


def _longs(chunks: int) -> list[str]:
    return [f"s{i}" for i in range(chunks)] + [f"o{i}" for i in range(SKETCH // 64)]


def signatures(docs: DataFrame, shingle: int, chunks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h1, h2`` (hash of the text), ``n_shingles, f1, f2`` (fingerprint of the set), ``s0..`` (signature) and ``o0..`` (sketch) per row;
    nulls where the set is empty."""
    small_batches(docs.sparkSession)
    names = _longs(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        factors = np.array([xxhash.xxh64_intdigest(f"permutation{i}") | 1 for i in range(LANES * chunks)], np.uint64)
        for b in batches:
            n = len(b)
            out = np.zeros((n, 2 + len(names)), np.int64)
            counts = np.zeros(n, np.int64)
            with np.errstate(over="ignore"):
                for i, t in enumerate(b["text"]):
                    s = shingle_set(t, shingle, memo)
                    counts[i] = len(s)
                    if len(s):
                        out[i, :2] = _fingerprint(s)
                        out[i, 2:] = np.concatenate((_signature(s, factors), _sketch(s)))
            frame = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h1": b["h1"], "h2": b["h2"], "n_shingles": counts})
            empty = counts == 0
            for k, c in enumerate(["f1", "f2", *names]):
                frame[c] = pd.array(out[:, k], "Int64")
                frame.loc[empty, c] = pd.NA
            yield frame

    schema = "doc_id long, h1 long, h2 long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in names)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.selectExpr("*", *[h.format("text") for h in _HASHES]).mapInPandas(run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """``node, hashes`` for the nodes of ``wanted (node, doc_id, h1, h2, f1, f2)``, from whole texts."""
    small_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, seen = _WordHashes(), set()
        for b in batches:
            nodes, sets = [], []
            with np.errstate(over="ignore"):
                for node, f1, f2, t in zip(b["node"], b["f1"], b["f2"], b["text"]):
                    if node in seen:  # a repeated row
                        continue
                    s = shingle_set(t, shingle, memo)
                    if tuple(_fingerprint(s)) == (f1, f2):
                        seen.add(node)
                        nodes.append(node)
                        sets.append(s.view(np.int64))
            yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "hashes": pd.Series(sets, dtype="object")})  # none if all were seen

    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    d = d.selectExpr("_id", "text", *[f"{h.format('text')}_" for h in _HASHES])
    rows = d.join(wanted, d["_id"].eqNullSafe(wanted["doc_id"]) & (d["h1_"] == wanted["h1"]) & (d["h2_"] == wanted["h2"])).select("node", "f1", "f2", "text")
    return materialize(rows.mapInPandas(run, "node long, hashes array<long>"), "neardup-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    x = x.withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return x.filter(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b").distinct()


def _differs(chunk: int) -> str:
    """SQL: how many of the four values of a chunk differ between l and r."""
    return "(" + " + ".join(f"if(((shiftrightunsigned(l.s{chunk} ^ r.s{chunk}, {BITS * j})) & 65535L) = 0, 0, 1)" for j in range(LANES)) + ")"


def _bounds(percent: int, longs: int = SKETCH // 64) -> str:
    """SQL: the sizes and sketches of l and r allow the similarity."""
    odd = " + ".join(f"bit_count(l.o{i} ^ r.o{i})" for i in range(longs))
    return f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) AND {100 + percent} * ({odd}) <= {100 - percent} * (l.n + r.n)"


def _distance(chunks: int) -> str:
    """SQL: the signatures of l and r are within the threshold."""
    return " + ".join(_differs(c) for c in range(chunks)) + f" <= {2 * chunks - 1}"


def _first() -> Column:
    """The smallest key of a group: null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *_KEY)).alias("first")


def _components(docs: DataFrame, shingle: int, percent: int, chunks: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of each row; ``f1, f2, doc_id, h1, h2, root`` (the first key that has the set, and its component) of each set."""
    longs = _longs(chunks)
    per_row = materialize(signatures(docs, shingle, chunks, doc_id, text), "neardup-signatures")
    nodes = (per_row.filter("n_shingles > 0").groupBy("f1", "f2")
             .agg(_first(), F.first("n_shingles").alias("n"), *[F.first(s).alias(s) for s in longs])
             .select("f1", "f2", *[f"first.{c}" for c in _KEY], "n", *longs).withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(nodes, "neardup-nodes")

    # the index: each chunk once for every value left out; buckets of one are dropped
    entries = [f"xxhash64({c * LANES + j}, s{c} & {~_LANE[j]}L)" for c in range(chunks) for j in range(LANES)]
    index = nodes.selectExpr("node", f"explode(array({', '.join(entries)})) AS key")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).filter("members > 1").drop("members")
    index = materialize(index.join(shared, "key").select("key", "node", "hub"), "neardup-index")

    sig = nodes.select("node", "n", *longs)

    def plausible(pairs: DataFrame) -> DataFrame:
        left, right = sig.alias("l"), sig.alias("r")
        p = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node"))
        return p.filter(_bounds(percent)).filter(_distance(chunks)).select("a", "b")

    met = index.select("node").distinct()
    sets = _sets_of(docs, nodes.join(met, "node", "left_semi").select("node", *_KEY, "f1", "f2"), shingle, doc_id, text)

    tried = roots = None
    stars = index.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).filter("a <> b").distinct()
    for turn in range(STAR_ROUNDS):
        new = stars if tried is None else stars.join(tried, ["a", "b"], "left_anti")
        new = materialize(plausible(new), "neardup-stars")
        tried = new if tried is None else tried.union(new)
        roots = joined_components(roots, materialize(_confirmed(new, sets, percent), "neardup-links"))
        split = index.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        several = split.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        split = materialize(split.join(several, "key", "left_semi"), "neardup-split")
        if turn + 1 == STAR_ROUNDS or split.isEmpty():
            break
        # another hub in each bucket that still holds several components
        hubs = split.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("hub"), F.min_by(
            "root", F.xxhash64("node", "key", F.lit(turn))).alias("hub_root"))
        stars = split.join(hubs, "key").filter("root <> hub_root").select(
            F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()

    # every pair of different components that meets; first by sizes and a folded sketch, which keeps the join's rows short
    folded = nodes.select("node", "n", *[F.expr(" ^ ".join(f"o{i}" for i in range(f, SKETCH // 64, FOLDED))).alias(f"o{f}") for f in range(FOLDED)])
    rows = split.join(folded, "node")
    cross = rows.alias("l").join(rows.alias("r"), F.expr(f"l.key = r.key AND l.root < r.root AND {_bounds(percent, FOLDED)}"))
    cross = plausible(cross.select(F.greatest("l.node", "r.node").alias("a"), F.least("l.node", "r.node").alias("b")).distinct())
    cross = materialize(cross.join(tried, ["a", "b"], "left_anti"), "neardup-cross")
    last = materialize(_confirmed(cross, sets, percent), "neardup-links")
    if not last.isEmpty():
        roots = joined_components(roots, last)

    roots = materialize(nodes.select("node", *_KEY, "f1", "f2").join(roots, "node", "left")
                        .select("f1", "f2", *_KEY, F.coalesce("root", "node").alias("root")), "neardup-roots")
    return per_row, roots


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 10,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    per_row, roots = _components(docs, shingle, percent, chunks, doc_id, text)
    named = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = roots.join(named, "root").select("f1", "f2", "component_id", F.lit(True).alias("_known"))
    out = per_row.select("doc_id", "n_shingles", "f1", "f2").join(of_set, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 10) -> DataFrame:
    """One row (all columns) of each component of ``docs``, and the rows with an empty set.

    The smallest doc_id stays, null ids last, then the smallest hash of the
    text; among rows equal in both, the one whose row hash is smallest.
    """
    per_row, roots = _components(docs, shingle, percent, chunks, "doc_id", "text")
    firsts = roots.groupBy("root").agg(_first()).select(*[F.col(f"first.{c}").alias(f"_{c}") for c in _KEY])
    keys = per_row.filter("n_shingles > 0").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"))

    # keys whose rows do not all stay
    marked = keys.join(firsts, keys["doc_id"].eqNullSafe(firsts["_doc_id"]) & (keys["h1"] == firsts["_h1"]) & (keys["h2"] == firsts["_h2"]), "left")
    marked = marked.select(*[F.col(c).alias(f"_{c}") for c in _KEY], "copies", F.col("_h1").isNotNull().alias("stays"))
    marked = materialize(marked.filter("NOT stays OR copies > 1"), "neardup-marked")
    repeated = marked.filter("stays")

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"),
                        *[F.expr(h.format("text")) for h in _HASHES])

    def at(keys: DataFrame) -> Column:
        return keyed["_id"].eqNullSafe(keys["_doc_id"]) & (keyed["h1"] == keys["_h1"]) & (keyed["h2"] == keys["_h2"])

    out = keyed.join(marked, at(marked), "left_anti").select("row.*")
    if repeated.isEmpty():
        return out
    one = keyed.join(repeated, at(repeated), "left_semi").groupBy("_id", "h1", "h2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.union(one.select("row.*"))
