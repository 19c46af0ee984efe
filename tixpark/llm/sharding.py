"""Sharding by a K-d tree over the documents' metadata.

A document is a point: its source, language, length in characters and size,
each as a coordinate of 20 bits (names by hash, numbers by logarithm).  The
tree starts with all documents and the wanted number of leaves, and splits a
node along its widest dimension at the weighted median (for an odd number of
leaves the quantile that gives both sides the same size per leaf) until a node
is one leaf, which by then holds the target bytes.

Ties in a coordinate are broken by the hash of the text, then by that of the
doc_id: both are the lower bits of the coordinate's key.  So a cut goes through
a group of equal texts only where its size demands it.

Cuts are found for all nodes of a level at once by histograms of the keys over
a narrow written table: each round looks into the bin that holds the median.
The driver holds the tree (one cut per inner node), nothing of the rows.

Defined cases: a null text has no bytes and the checksum of no bytes; null
metadata is a value of its own; rows that repeat doc_id and text are numbered
once in a written table and that number takes the place of the doc_id's hash, so
a cut may go through them too (which of such equal rows goes where is not told);
fewer documents than leaves leave shards empty; an empty table gives no row;
further columns are not read, whatever their names; a text is one point, however
long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize, running_total

LEAVES = 40
ROW_BYTES = 16
VALUE_BITS, TEXT_BITS, ID_BITS = 20, 20, 22
TIE_BITS = TEXT_BITS + ID_BITS
BINS = 4096
#: A cut may miss its median by this share of a leaf (or by one row).
TOLERANCE = 0.0005


@dataclass
class Node:
    """A node of the tree: its leaves are ``first`` .. ``first + leaves - 1``; keys below ``cut`` go left."""

    first: int
    leaves: int
    dimension: int = 0
    cut: int = 0


def _bits(c: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - bits)


def points(docs: DataFrame, dimensions: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32`` and ``k``: the keys in each dimension (names of metadata columns, then the size)."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(t) + ROW_BYTES).cast("long")
    tie = _bits(t, TEXT_BITS) * (1 << ID_BITS) + _bits(F.col(doc_id), ID_BITS)

    def key(value: Column) -> Column:
        return value * (1 << TIE_BITS) + tie

    def coordinate(name: str) -> Column:
        if docs.schema[name].dataType.simpleString() == "string":
            return _bits(F.col(name), VALUE_BITS)
        return _scaled(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))

    keys = F.array(*[key(coordinate(n)) for n in dimensions], key(_scaled(size))).alias("k")
    return docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), keys)


def _scaled(x: Column) -> Column:
    """A number on a logarithmic scale that reaches beyond 2^60."""
    return F.floor(F.log2(1 + F.greatest(x, F.lit(0.0))) * ((1 << VALUE_BITS) / 64)).cast("long")


def _at_node(values: dict[int, float], kind: str, leaves: int) -> Column:
    """The value of a row's node (null where it has none)."""
    return F.array(*[F.lit(values.get(n)).cast(kind) for n in range(leaves)])[F.col("node")]


def _split(rows: DataFrame, nodes: list[Node], width: list[int], allowed: float, leaves: int) -> None:
    """Set dimension and cut of all ``nodes``; rows carry the ``node`` they are in."""
    of = {n.first: n for n in nodes}
    dims = range(len(width))
    mine = rows.filter(F.col("node").isin(list(of)))
    stats = mine.groupBy("node").agg(F.sum("size").alias("size"), F.array(*[F.min(F.col("k")[d]) for d in dims]).alias("least"),
                                     F.array(*[F.max(F.col("k")[d]) for d in dims]).alias("most"))
    lo, step, below, want = {}, {}, {}, {}
    for r in stats.collect():
        n = r["node"]
        spread = [((r["most"][d] >> TIE_BITS) - (r["least"][d] >> TIE_BITS)) / width[d] for d in dims]
        d = of[n].dimension = max(dims, key=lambda d: (spread[d], -d))
        lo[n], below[n] = r["least"][d], 0
        step[n] = (r["most"][d] - lo[n]) // BINS + 1
        want[n] = r["size"] * (of[n].leaves // 2) / of[n].leaves
    while lo:
        key = F.col("k")[_at_node({n: of[n].dimension for n in lo}, "int", leaves)]
        bins = mine.select("node", "size", key.alias("key"), _at_node(lo, "long", leaves).alias("lo"), _at_node(step, "long", leaves).alias("step")) \
            .filter("key >= lo").withColumn("bin", F.expr("(key - lo) DIV step")).filter(F.col("bin") < BINS) \
            .groupBy("node", "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        up_to = F.sum("size").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        reached = bins.withColumn("up_to", up_to).filter(F.col("up_to") >= _at_node({n: want[n] - below[n] for n in lo}, "double", leaves))
        for r in reached.groupBy("node").agg(F.min(F.struct("bin", "up_to", "size", "n")).alias("m")).select("node", "m.*").collect():
            n = r["node"]
            before = below[n] + r["up_to"] - r["size"]
            begin = lo[n] + r["bin"] * step[n]
            if step[n] == 1 or r["n"] == 1 or r["size"] <= allowed:
                # the nearer edge of the bin
                of[n].cut = begin if want[n] - before < before + r["size"] - want[n] else begin + step[n]
                del lo[n], step[n]
            else:
                below[n], lo[n], step[n] = before, begin, (step[n] - 1) // BINS + 1


def kd_leaves(points: DataFrame, leaves: int) -> DataFrame:
    """:func:`points` with ``node``, the leaf of each row.  A level of the tree writes the narrow table anew."""
    rows = points.withColumn("node", F.lit(0))
    total = points.agg(F.sum("size").alias("size"), F.max(F.size("k")).alias("dims")).first()
    if not total["size"] or leaves == 1:
        return rows
    dims = range(total["dims"])
    whole = points.agg(*[f(F.col("k")[d]) for f in (F.min, F.max) for d in dims]).first()
    width = [max((whole[d + len(dims)] >> TIE_BITS) - (whole[d] >> TIE_BITS), 1) for d in dims]
    level = [Node(0, leaves)]
    while level:
        _split(rows, level, width, TOLERANCE * total["size"] / leaves, leaves)
        key = F.col("k")[_at_node({n.first: n.dimension for n in level}, "int", leaves)]
        right = key >= _at_node({n.first: n.cut for n in level}, "long", leaves)
        moved = F.when(right, _at_node({n.first: n.first + n.leaves // 2 for n in level}, "int", leaves)).otherwise(F.col("node"))
        rows = materialize(rows.withColumn("node", moved), "kd-level")
        halves = [Node(n.first, n.leaves // 2) for n in level] + [Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2) for n in level]
        level = [n for n in halves if n.leaves > 1]
    return rows


def _numbered(points: DataFrame) -> DataFrame:
    """:func:`points` with ``copy``: 0, or for rows that repeat one another a number of their own, which then
    makes the lowest bits of their keys."""
    rows = materialize(points.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("copy", F.monotonically_increasing_id() + 1), "kd-rows")
    again = rows.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("h", F.lit(True).alias("_again"))
    rows = rows.join(again, "h", "left").withColumn("copy", F.when(F.col("_again"), F.col("copy")).otherwise(F.lit(0)))
    low = _bits(F.col("copy"), ID_BITS)
    keys = F.when(F.col("_again"), F.transform("k", lambda k: F.shiftleft(F.shiftright(k, ID_BITS), ID_BITS) + low)).otherwise(F.col("k"))
    return materialize(rows.select("doc_id", "size", "text_crc32", "copy", keys.alias("k")), "kd-points")


def sharded(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"),
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of near equal size, slots gapless from 0 in each.

    Give ``leaves``, or ``target_bytes`` for as many leaves as that takes.
    """
    dims = [d for d in dimensions if d in docs.columns]
    rows = _numbered(points(docs, dims, doc_id, text))
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // (target_bytes or 1 << 27)))
    placed = materialize(kd_leaves(rows, leaves).select("doc_id", "size", "text_crc32", "copy", F.col("node").alias("shard")), "kd-placed")
    return running_total(placed, ["shard"], ["doc_id", "text_crc32", "size", "copy"], F.lit(1), "slot", buckets_for(placed.count())).drop("copy")
