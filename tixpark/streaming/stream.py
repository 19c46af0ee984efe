"""Structured Streaming form of the polling robot.

New export files dropped in a folder are picked up by a file-source stream;
the source's checkpoint replaces "files newer than the cycle start" (each file
once), ``foreachBatch`` routes every micro-batch and appends it idempotently
(batch id partition overwritten on retry), and the appended history is the
workload state the next batch re-aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..sources.committed import CommittedStore


#: Rows of a dropped file: one with line breaks in its fields is read by a single task.
FILE_ROWS = 20_000


def drop_files(df: DataFrame, folder: str, parts: int = 4, sep: str = ";") -> None:
    """Write a frame as several delimited files (test feed for T1): ``parts``, more where a file would have over ``FILE_ROWS`` rows."""
    (df.repartition(max(parts, -(-df.count() // FILE_ROWS))).write.mode("append").option("sep", sep).option("header", True)
       .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(folder))


def ticket_stream(spark: SparkSession, folder: str, schema, sep: str = ";", max_files: int = 100,
                  multiline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """T1 + T2: file stream of exports, each file handled once; ``multiline`` where quoted fields hold line breaks."""
    return (spark.readStream.schema(schema).option("sep", sep).option("header", True)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline).option("encoding", encoding)
            .option("maxFilesPerTrigger", max_files).csv(folder))


def idempotent_append(out: str):
    """T3 + T5: write a micro-batch into its own ``batch_id`` partition; a retried
    batch overwrites the same partition (dynamic partition overwrite)."""
    def _write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))
    return _write


def run_available(spark: SparkSession, folder: str, schema, out: str, checkpoint: str,
                  transform=None, processing_time: str | None = None, multiline: bool = False):
    """Process what is in ``folder`` now (``availableNow``), or keep polling at
    ``processing_time`` (e.g. ``'30 minutes'``) when given; restart from the
    checkpoint after a failure (T5)."""
    s = ticket_stream(spark, folder, schema, multiline=multiline)
    if transform is not None:
        s = transform(s)
    w = s.writeStream.foreachBatch(idempotent_append(out)).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    if not processing_time:
        q.awaitTermination()
    return q


def batch_run(batch_id: int) -> str:
    return f"batch-{batch_id:09d}"


def stream_assign(spark: SparkSession, folder: str, schema, desk: jobs.Desk, store: CommittedStore, checkpoint: str,
                  prepare=None, scorer: jobs.Scorer | None = None, class_col: str = "Clasificación", max_files: int = 100,
                  processing_time: str | None = None, **options):
    """Score, route and balance every micro-batch against the state that the batches before it left.

    A batch is one committed run named by its id: its sinks appear together, and a batch that is tried again
    after a failure (T5) replaces what its first try left and reads the same state.
    """
    def assign(batch: DataFrame, batch_id: int) -> None:
        run = batch_run(batch_id)
        if not batch.isEmpty():
            jobs.assign_incidents(batch, jobs.with_history(desk, store, run), store, run, scorer, class_col, **options)

    s = ticket_stream(spark, folder, schema, max_files=max_files)
    s = prepare(s) if prepare else s
    w = s.writeStream.foreachBatch(assign).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start()
    if not processing_time:
        q.awaitTermination()
    return q


def running_counts(stream_df: DataFrame, key: str = "assigned_to") -> DataFrame:
    """T4: load counters carried across micro-batches (stateful aggregation, update mode)."""
    return stream_df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stream_workload(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, key: str = "assigned_to"):
    """T4: keep the counters in the state store; every micro-batch writes the counters it changed (an upsert:
    a key's newest row counts, a retried batch replaces its own rows)."""
    counts = running_counts(ticket_stream(spark, folder, schema), key)
    q = counts.writeStream.outputMode("update").foreachBatch(idempotent_append(out)).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current_counts(counters: DataFrame, key: str = "assigned_to") -> DataFrame:
    """The newest counter of every key."""
    return counters.groupBy(key).agg(F.max_by("n", "batch_id").alias("n"))
