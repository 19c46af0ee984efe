"""Connected components of an edge table, by min-hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node reachable.

    A round hooks each node to its smallest neighbour, follows the hooks to
    their ends by doubling, and contracts the edges to those ends; the number
    of nodes left at least halves.  All state stays in written tables; the
    driver sees only counts.  Aggregates by node combine before the shuffle,
    joins leave skewed nodes to adaptive execution.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    done = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"),
                           "cc-hook")
        while True:
            up = hook.select(F.col("node").alias("_n"), F.col("to").alias("_up"))
            hook = materialize(hook.join(up, F.col("to") == F.col("_n")).select("node", "to", "_up"), "cc-jump")
            moved = not hook.filter("to <> _up").isEmpty()
            hook = hook.select("node", F.col("_up").alias("to"))
            if not moved:
                break
        if done is None:
            done = hook.select("node", F.col("to").alias("root"))
        else:
            done = materialize(done.join(hook.withColumnRenamed("node", "root"), "root", "left")
                               .select(done["node"], F.coalesce("to", "root").alias("root")), "cc-done")
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        left = left.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = materialize(left, "cc-edges")
    if done is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return done


def joined_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots (node, root)`` after further ``links (a, b)``: only the roots that these join are worked on."""
    if roots is None:
        return connected_components(links)
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    ends = links.join(r, links["a"] == r["_n"], "left").select(F.coalesce("_r", "a").alias("a"), "b")
    ends = ends.join(r, ends["b"] == r["_n"], "left").select("a", F.coalesce("_r", "b").alias("b"))
    new = connected_components(ends).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = roots.join(new, roots["root"] == new["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    fresh = new.join(roots.select(F.col("node").alias("_n")), "_n", "left_anti").select(F.col("_n").alias("node"), F.col("_r").alias("root"))
    return materialize(moved.union(fresh), "cc-roots")
