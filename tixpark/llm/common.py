"""Helpers shared by the corpus operators: scratch tables and running totals."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixpark.session import scratch_path

#: ASCII white space as the contracts define it: blank, TAB, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (not yet made) below the session's shared checkpoint folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor re-reads files, it does not recompute, and
    values such as ``monotonically_increasing_id`` are fixed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows (and bytes) of one Arrow batch: texts are long, workers are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 256) -> int:
    """Buckets that hold about ``per_bucket`` rows each; many even for few rows,
    so that one hot group is always spread."""
    return max(least, -(-rows // per_bucket))


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the exclusive running total of ``value`` inside each ``group``.

    The order is (hash bucket of ``order``, ``order``), a fixed pseudorandom one.
    A group is never gathered in one task: sums per (group, bucket) are small,
    their prefix sums give each bucket its base, and the window runs inside one
    bucket.  ``df`` is read twice, so it should be a written table.  Group
    columns must not be null.
    """
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_v", value.cast("long"))
    sums = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(base, [*group, "_b"])
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_b", "_v", "_base")


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
