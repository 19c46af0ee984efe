"""Several tables written as one run: readers see all of a run's tables or none.

Every attempt at a run writes its tables into folders of its own; the last step
appends one row to the list of commits.  Readers take, of each run, the latest
committed attempt, so a half-written run is not seen, and a run done again
replaces all of its tables at once.  Runs are committed by one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "run string, attempt string, seq long, tables array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


class CommittedStore:
    """Named tables under ``root``, by run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> DataFrame:
        path = f"{self.root}/commits"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(path)

    def latest(self) -> DataFrame:
        """The attempt that counts of every committed run."""
        return self._commits().groupBy("run").agg(F.max_by(F.struct("attempt", "seq", "tables"), "seq").alias("_c")).select("run", "_c.*")

    def write(self, run: str, tables: dict[str, DataFrame]) -> None:
        """Write all tables of a run, then commit it.  Nothing of it is visible before the last step."""
        before = self._commits().where(F.col("run") == run).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            write_table(df, f"{self.root}/tables/{name}/run=r-{run}/attempt=a-{attempt}")
        row = self.spark.createDataFrame([(run, attempt, before + 1, sorted(tables))], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def read(self, name: str, like: DataFrame | None = None, except_run: str | None = None) -> DataFrame:
        """The committed rows of a table over all runs, with the column ``run``; ``like`` gives the columns of a
        table that has no run yet.  The join is on the folders' columns: only committed folders are read."""
        keep = self.latest().where(F.array_contains("tables", name))
        if except_run is not None:
            keep = keep.where(F.col("run") != except_run)
        folder = f"{self.root}/tables/{name}"
        if not _exists(self.spark, folder) or keep.isEmpty():
            if like is None:
                raise ValueError(f"no committed run has the table {name}")
            return like.limit(0).withColumn("run", F.lit(""))
        rows = self.spark.read.option("basePath", folder).parquet(f"{folder}/run=r-*/attempt=a-*/")
        keys = keep.select(F.concat(F.lit("r-"), "run").alias("run"), F.concat(F.lit("a-"), "attempt").alias("attempt"))
        return rows.join(keys, ["run", "attempt"]).withColumn("run", F.substring("run", 3, 1 << 20)).drop("attempt")
