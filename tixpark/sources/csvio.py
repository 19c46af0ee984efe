"""Delimited ticket exports: scan, repair, sinks and run archives.

Scans are plain ``spark.read.csv`` jobs, or of the records of
:mod:`.records` where quoted fields hold line breaks; repairs are column expressions; sinks are
``DataFrameWriter`` calls.  Scratch output goes under the shared
``spark.checkpoint.dir``, never a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import LATIN1, UTF8, logical_records, split_fields

# Cell texts that pandas reads as missing by default.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
               "None", "n/a", "nan", "null")


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Column names by the CSV reader itself: only the first line is read, in the file's encoding."""
    names = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
             .csv(path).columns)
    return [n.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf").strip().strip('"') for n in names]


def sniff_delimiter(spark: SparkSession, path: str, first: str = ";", other: str = ",",
                    encoding: str = LATIN1) -> tuple[str, list[str]]:
    """S5 + S6: header probe; use ``other`` when ``first`` yields one column; strip a BOM."""
    names = _header(spark, path, first, encoding)
    return (first, names) if len(names) > 1 else (other, _header(spark, path, other, encoding))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 (with or without BOM) if every line decodes, else latin-1."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return UTF8 if bad.isEmpty() else LATIN1


def scan_tickets(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = LATIN1,
                 multiline: bool = False, null_tokens=NULL_TOKENS) -> DataFrame:
    """Header, all strings, drop over-long rows, keep short rows null-padded.

    Reads PERMISSIVE with the header's n columns plus ``_rest`` and
    ``_corrupt``; a row that parses cleanly has n + 1 fields (a trailing
    separator makes one), for others the raw record's separators outside quotes
    count.  ``encoding`` None: UTF-8 if the whole file is, else latin-1.
    ``multiline`` where quoted fields hold line breaks (read as ``\\n``): the
    records are found in splits, with one more shuffle; only encodings other
    than these two make one task per file.
    """
    encoding = encoding or detect_encoding(spark, path)
    s, cols = sniff_delimiter(spark, path, sep or ";", "," if (sep or ";") == ";" else ";", encoding)
    sep = sep or s
    toks = list(null_tokens)
    cells = [F.when(F.col(f"`{c}`").isin(toks), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in cols]
    if multiline and encoding.upper() in (LATIN1, UTF8):
        return split_fields(logical_records(spark, path, encoding, "\n"), cols, sep).select(*cells)
    n = len(cols)
    schema = StructType([StructField(c, StringType()) for c in cols]
                        + [StructField("_rest", StringType()), StructField("_corrupt", StringType())])
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding)
          .option("quote", '"').option("escape", '"').option("multiLine", multiline)
          .option("columnPruning", False)  # a record's width counts whole records
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
          .option("enforceSchema", True).option("nullValue", "\u0001").csv(path))
    unq = F.regexp_replace(F.col("_corrupt"), r'"[^"]*(?:""[^"]*)*"', "")
    width = F.when(F.col("_corrupt").isNull(), F.lit(n + 1))\
             .otherwise(F.lit(1) + F.length(unq) - F.length(F.replace(unq, F.lit(sep), F.lit(""))))
    return df.filter(width <= n).select(*cells)


def repair_quoted_newlines(df: DataFrame, replacement: str = " ") -> DataFrame:
    """Line breaks inside (quoted) values -> replacement; CRLF counts once."""
    return df.select(*[(F.regexp_replace(F.col(f"`{f.name}`"), "\r\n|\r|\n", replacement).alias(f.name)
                        if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")) for f in df.schema.fields])


def write_delimited(df: DataFrame, path: str, sep: str = ";", encoding: str = "ISO-8859-1",
                    mode: str = "overwrite", header: bool = True) -> None:
    """One ``write.csv`` job (``;``, latin-1 by default)."""
    (df.write.mode(mode).option("sep", sep).option("encoding", encoding).option("header", header)
       .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


def append_aligned(target_columns: list[str], scored: DataFrame, class_candidates=("Categoría", "clasificacion", "Clasificación"),
                   class_source: str = "Clasificación", date_from: str = "opened_at") -> DataFrame:
    """Scored rows aligned to the training set's columns; absent -> ''."""
    cls_target = next((c for c in class_candidates if c in target_columns), None)
    cols = []
    for c in target_columns:
        if c == cls_target and class_source in scored.columns:
            cols.append(F.col(f"`{class_source}`").cast("string").alias(c))
        elif c == "fecha_asignacion" and date_from in scored.columns:
            cols.append(F.col(date_from).cast("string").alias(c))
        elif c in scored.columns:
            cols.append(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c))
        else:
            cols.append(F.lit("").alias(c))
    return scored.select(*cols)


def append_history(df: DataFrame, path: str, original_columns: list[str], run_ts: str) -> None:
    """S10 + S13: the original columns (assignee overwritten) as the run's own partition; a retried run replaces it."""
    (df.select(*[F.col(f"`{c}`") for c in original_columns])
       .withColumn("run_date", F.substring(F.lit(run_ts), 1, 10)).withColumn("run_ts", F.lit(run_ts))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_ts").parquet(path))


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the newest run; date and run are partition columns, so only its files are read."""
    last = df.agg(F.max(F.struct(F.col("run_date").cast("string").alias("d"), F.col("run_ts").cast("string").alias("t"))).alias("m")).first()["m"]
    return df.filter((F.col("run_date").cast("string") == last["d"]) & (F.col("run_ts").cast("string") == last["t"])) if last else df.limit(0)


def latest_version(spark: SparkSession, folder: str, pattern: str = "*.csv", since: str | None = None, by_version: bool = True) -> DataFrame:
    """``path, version, modificationTime`` of the newest export: the largest ``_v<N>`` (none: 0), then the latest
    change; without ``by_version`` the latest change alone.  ``since`` (a timestamp) leaves out older files.  Equal times go
    to the larger path.  A folder named ``..._v<N>.csv`` is one export, changed when its last file was.  No file, no row.
    Names and times are listed, contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
             .select("path", "modificationTime"))
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    whole = F.regexp_extract("path", r"(?i)^(.*_v\d+\.csv)/[^/]*$", 1)
    files = files.groupBy(F.when(whole == "", F.col("path")).otherwise(whole).alias("path")).agg(F.max("modificationTime").alias("modificationTime"))
    v = F.regexp_extract("path", r"(?i)_v(\d+)\.csv$", 1)
    files = files.withColumn("version", F.when(v == "", F.lit(0)).otherwise(v.try_cast("bigint")))
    order = ([F.desc("version")] if by_version else []) + [F.desc("modificationTime"), F.desc("path")]
    return files.select("path", "version", "modificationTime").orderBy(*order).limit(1)


def config_lookup(cfg_json, key: str, default: str = ""):
    """S15 + F29: value of ``configuration_items[key]`` from a JSON text column."""
    m = F.from_json(cfg_json, "map<string,string>")
    return F.coalesce(F.element_at(m, F.lit(key)), F.lit(default))


def summary_text(lines: DataFrame, order_cols, path: str) -> None:
    """Human-readable report lines written as one small text file."""
    lines.orderBy(*order_cols).select("line").coalesce(1).write.mode("overwrite").text(path)
