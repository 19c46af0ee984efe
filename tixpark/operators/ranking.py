"""Ranks inside large groups without one task per group.

A rank is the count of rows in earlier buckets plus the place inside the
bucket.  Buckets follow the wanted order (a prefix of the hash, an hour, a run
of ids), so the counts are a small table and the window runs inside
(group, bucket), however many rows one group holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def two_level_rank(df: DataFrame, group: list[str], order: list, bucket: Column, out: str, total: str | None = None) -> DataFrame:
    """Add ``out``: the 1-based rank by ``order`` inside ``group`` (all rows if empty), and
    the group's row count as ``total``.  ``bucket`` must be monotone in ``order`` and not null."""
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    x = b.withColumn("_place", F.row_number().over(inside)).join(base, reduce(lambda a, c: a & c, same))
    x = x.withColumn(out, F.col("_before") + F.col("_place"))
    if total:
        x = x.withColumn(total, F.col("_total"))
    return x.drop("_bucket", "_b", "_before", "_total", "_place", *[f"_g{i}" for i in range(len(group))])
