"""Chat formatting after a cumulative-snapshot collapse.

Chat logs often hold a conversation once per turn: each snapshot is a prefix of
the next.  Every turn gets the hash of its conversation up to it: running sums
of four 31-bit hashes of (place, role, text), 124 bits in all, so that a long
conversation's prefix sums can be built in pieces and some 10^12 prefixes are
still told apart (two meet by chance with probability below 10^-12).  A conversation whose whole
hash is the hash of a proper prefix of another is a snapshot of that one; an
anti-join drops it.  Of equal conversations the smallest id stays.  What is left
is maximal and is rendered.

Rendering: per turn ``<|im_start|>role`` line break, text, ``<|im_end|>`` line break.
``<|`` inside roles and texts is written ``< |``, so that no text can end a turn.
A row holds up to ``PART_TURNS`` turns; longer conversations have more parts.

Defined cases: turns are in order of (turn, role, text), null first; rows that
repeat a turn are further turns; a null text is empty, a null role is
"unknown"; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PART_TURNS = 1024
_BITS = 31
_SEEDS = (1, 2, 3, 4)
_HASHES = [f"h{k}" for k in _SEEDS]


def placed(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, role, text`` with places 0.. in each conversation.

    Places are counted in runs of turn numbers (their quotient by
    ``PART_TURNS``) and added up over runs, so a conversation of any length is
    spread over tasks.
    """
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("run", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62))))
    t = materialize(t, "chat-turns")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("nth", F.row_number().over(inside))
    t = t.join(runs, t["conv_id"].eqNullSafe(runs["_c"]) & (t["run"] == runs["_r"]))
    return t.select("conv_id", (F.col("base") + F.col("nth") - 1).alias("place"), "role", "text")


def hashed(turns: DataFrame) -> DataFrame:
    """Add ``h1`` to ``h4`` (hash of the conversation up to each turn) to :func:`placed` turns; ``size`` is the prefix's length."""
    parts = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", "role", "text"), 64 - _BITS).alias(f"g{seed}") for seed in _SEEDS]
    t = turns.withColumn("run", F.floor(F.col("place") / PART_TURNS)).select("conv_id", "place", "run", *parts)
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("conv_id", "run").agg(*[F.sum(f"g{k}").alias(f"s{k}") for k in _SEEDS])
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in _SEEDS])
    t = t.select("conv_id", "place", "run", *[F.sum(f"g{k}").over(inside).alias(f"r{k}") for k in _SEEDS])
    t = t.join(sums, t["conv_id"].eqNullSafe(sums["_c"]) & (t["run"] == sums["_r"]))
    return t.select("conv_id", (F.col("place") + 1).alias("size"), *[(F.col(f"b{k}") + F.col(f"r{k}")).alias(f"h{k}") for k in _SEEDS])


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that stay, from a written table of :func:`hashed` prefixes."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("size", *_HASHES)).alias("e")).select("conv_id", "e.*")
    first = ends.groupBy("size", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    marked = prefixes.join(ends.select(F.col("conv_id").alias("_c"), F.col("size").alias("_n")), F.col("conv_id").eqNullSafe(F.col("_c")))
    inner = marked.filter(F.col("size") < F.col("_n")).select("size", *_HASHES).distinct()
    return first.join(inner, ["size", *_HASHES], "left_anti").select("conv_id", F.col("size").alias("n_turns"))


def rendered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per maximal conversation (and part of it): ``conv_id, n_turns, part, text``."""
    t = materialize(placed(turns, conv_id, turn, role, text), "chat-placed")
    stays = maximal(materialize(hashed(t), "chat-prefixes")).withColumnRenamed("conv_id", "_c")

    def safe(c: str) -> Column:
        return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))

    line = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    t = t.join(stays, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("part", F.floor(F.col("place") / PART_TURNS).cast("int"))
    parts = t.groupBy("conv_id", "n_turns", "part").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "n_turns", "part", F.concat_ws("", F.expr("transform(lines, x -> x.line)")).alias("text"))
