"""Records of delimited files whose quoted fields hold line breaks, read in splits.

A multi-line CSV scan is one task per file.  Here the files are read as lines,
in splits of any size: the quotes of each split are counted, the parity before
a split is a running sum over the file's splits (one row each), and the parity
before a line a running sum inside its split.  A line that starts outside
quotes starts a record.  A split's lines are joined to records where they are
read; only records that go over two splits or more are shuffled.  ``""`` inside
quotes turns the parity twice, so it needs no rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..session import written

LATIN1, UTF8 = "ISO-8859-1", "UTF-8"
#: Lines that one record may have; a file whose quote is never closed would be one record.
MAX_LINES = 100_000
_BREAK = "\r\n|\r|\n"


def replace_outside_quotes(c: Column, old: str = ",", new: str = ";") -> Column:
    """S3: ``old`` outside quotes becomes ``new``; null stays null."""
    return F.array_join(F.transform(F.split(c, '"'), lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(old), F.lit(new))).otherwise(s)), '"')


def clean_csv_text(c: Column, replacement: str = " ", change_separator: bool = True, sep: str = ";") -> Column:
    """S4 on a column of whole texts: line breaks inside quotes replaced (CRLF once), commas outside them changed."""
    c = F.array_join(F.transform(F.split(c, '"'), lambda s, i: F.when(i % 2 == 1, F.regexp_replace(s, _BREAK, _literal(replacement))).otherwise(s)), '"')
    return replace_outside_quotes(c, ",", sep) if change_separator else c


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, block, pos, value, quotes: lines in splits; ``pos`` grows with the line inside a split."""
    if encoding.upper() not in (LATIN1, UTF8):
        raise ValueError(f"{encoding}: lines are found in the bytes, so only {LATIN1} and {UTF8} are read")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("pos"), "value")
    if encoding.upper() == LATIN1:
        raw = raw.withColumn("value", F.decode(F.col("value").cast("binary"), LATIN1))
    return raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def _pieces(lines: DataFrame, replacement: str, max_lines: int) -> DataFrame:
    """``split, pos, begun, closed, n, header, record``: the lines of every split joined to records.  A record that
    starts in an earlier split is not ``begun``, one that goes on in a later split not ``closed``.  ``lines`` has split, top (the
    file's first split), entry (parity before the split), pos, value, quotes; a task has a split's lines in a row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, first, begun, place, held, done = None, 0, False, False, 0, [], []

        def end(closed: bool) -> None:
            done.append((split, place, begun, closed, len(held), first and begun, replacement.join(held)))

        for batch in batches:
            for s, top, entry, pos, value, quotes in zip(*(c.to_pylist() for c in batch.columns)):
                new = s != split
                if new:
                    if held:
                        end(False)
                    split, odd, held = s, entry, []
                if not held:
                    begun, place, first = odd == 0, pos, new and top
                held.append(value)
                if len(held) > max_lines:
                    raise ValueError(f"{_TOO_LONG} split {split}")
                odd ^= quotes & 1
                if not odd:
                    end(True)
                    held = []
            yield _batch(done)
            done.clear()
        if held:
            end(False)
            yield _batch(done)

    return lines.select("split", "top", "entry", "pos", "value", "quotes").mapInArrow(work, _PIECE)


_PIECE = "split int, pos long, begun boolean, closed boolean, n long, header boolean, record string"
_ARROW = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
_TOO_LONG = "open quote: a record has too many lines in"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=[c.split()[0] for c in _PIECE.split(", ")])


def logical_records(spark: SparkSession, path: str, encoding: str = UTF8, replacement: str = " ", max_lines: int = MAX_LINES) -> DataFrame:
    """``file, block, pos, header, record``: one row per record, its inner line breaks replaced.

    (block, pos) is the place of the record's first line and orders the records
    of a file; ``header`` marks each file's first record.  A last record whose
    quote stays open ends with the file.  A record of more than ``max_lines``
    lines is an error, not a cut.  An empty file has no records.
    """
    lines = _lines(spark, path, encoding)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    splits = splits.select("file", "block", F.coalesce(F.sum("odd").over(earlier) % 2, F.lit(0)).alias("entry"),
                           F.row_number().over(Window.orderBy("file", "block")).alias("split"))
    splits = F.broadcast(written(splits, "splits"))      # one row per split: the lines stay where they are read
    pieces = _pieces(lines.join(splits, ["file", "block"]).withColumn("top", F.col("block") == 0), replacement, max_lines)
    pieces = pieces.join(splits.select("split", "file", "block"), "split")
    whole = pieces.filter("begun AND closed").select("file", "block", "pos", "header", "record")
    # at most two of a split: its first lines belong to the last record that an earlier split left open
    parts = pieces.filter("NOT (begun AND closed)")
    upto = Window.partitionBy("file").orderBy("block", "begun").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("start", F.last(F.when(F.col("begun"), F.struct("block", "pos")), ignorenulls=True).over(upto))
    message = F.concat(F.lit(f"{_TOO_LONG} "), F.col("file"))
    value = F.when(F.sum("n").over(Window.partitionBy("file", "start")) <= max_lines, F.col("record")).otherwise(F.raise_error(message))
    parts = parts.withColumn("record", value)
    joined = parts.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "record"))).alias("l"), F.max("header").alias("header"))
    joined = joined.select("file", "start.block", "start.pos", "header", F.array_join(F.col("l.record"), replacement).alias("record"))
    return whole.unionByName(joined)


def split_fields(records: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """The fields of :func:`logical_records`' rows as strings.  Blank records and those with more fields than
    ``columns`` go, short ones end in nulls."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    record = F.col("record")
    outside = F.regexp_replace(record, r'"[^"]*"', "")
    width = F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) + 1
    fields = F.from_csv(record, schema.toDDL(), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0001"})
    return records.filter(~F.col("header") & (F.trim(record) != "") & (width <= len(columns))).select(fields.alias("f")).select("f.*")


def clean_csv_job(spark: SparkSession, source: str, target: str, encoding: str = UTF8, replacement: str = " ", change_separator: bool = True,
                  sep: str = ";", max_lines: int = MAX_LINES) -> None:
    """Files to files.  Records keep their text but for inner line breaks and unquoted commas, so records that are
    too short or too long stay.  Every part file has the header; the order of the records is not kept.  The files of
    ``source`` must share one header.  A source without lines gives no file."""
    records = logical_records(spark, source, encoding, replacement, max_lines)
    text = replace_outside_quotes(F.col("record"), ",", sep) if change_separator else F.col("record")
    records = records.select("header", text.alias("record"))
    headers = [r["record"] for r in records.filter("header").select("record").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"files with different headers in {source}")
    if not headers:
        return
    # one column that is named as the header; quote, separator and comment are noncharacters, so the text is written as it is
    (records.filter(~F.col("header")).select(F.col("record").alias(headers[0])).write.mode("overwrite")
     .option("header", True).option("quote", "\ufdd0").option("sep", "\ufdd1").option("comment", "\ufdd2").option("emptyValue", "").option("encoding", encoding)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target))
