"""Registered queries: scan/write round trips and the file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import bindings as b
from ..sources import csvio, records
from ..streaming import stream
from .catalog import register

W = b.ORACLE_WITH


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


_NULLS = ", ".join(f"'{t}'" for t in csvio.NULL_TOKENS)


def _cell(c: str) -> str:
    return f"CASE WHEN {c} IN ({_NULLS}) THEN NULL ELSE {c} END"


@register("scan_tickets", W + f"""
SELECT number, {_cell('u_subcategory')} AS u_subcategory,
       category, regexp_replace({_cell('description')}, '\\r\\n|\\r|\\n', ' ', 'g') AS description FROM tickets
""")
def q_scan_tickets(spark, sf):
    t = b.tickets(spark, sf).select("number", "u_subcategory", "category", "description")
    path = _scratch(spark, "export")
    csvio.write_delimited(t, path, sep=";", encoding="ISO-8859-1")
    df = csvio.scan_tickets(spark, path, sep=";", multiline=True)
    return csvio.repair_quoted_newlines(df)


@register("change_separator", W + f"""
SELECT number, category, contact_type, {_cell('short_description')} AS short_description, {_cell('description')} AS description FROM tickets
""")
def q_change_separator(spark, sf):
    t = b.tickets(spark, sf).select("number", "category", "contact_type", "short_description", "description")
    a = _scratch(spark, "comma")
    csvio.write_delimited(t, a, sep=",")
    df = csvio.scan_tickets(spark, a, sep=",", multiline=True)
    bpath = _scratch(spark, "semicolon")
    csvio.write_delimited(df, bpath, sep=";")
    return csvio.scan_tickets(spark, bpath, multiline=True)


_ONE_LINE = "regexp_replace({}, '\\r\\n|\\r|\\n', ' ', 'g')"


@register("clean_csv_job", W + f"""
SELECT number, category, contact_type, {_cell(_ONE_LINE.format('short_description'))} AS short_description,
       {_cell(_ONE_LINE.format('description'))} AS description FROM tickets
""")
def q_clean_csv_job(spark, sf):
    """A comma export with line breaks in its fields, cleaned file to file, then read line by line."""
    t = b.tickets(spark, sf).select("number", "category", "contact_type", "short_description", "description")
    source, target = _scratch(spark, "raw"), _scratch(spark, "clean")
    csvio.write_delimited(t, source, sep=",", encoding="UTF-8")
    records.clean_csv_job(spark, source, target)
    return csvio.scan_tickets(spark, target, encoding="UTF-8")


@register("append_aligned", W + """
SELECT number, coalesce(short_description, '') AS short_description, coalesce(clasificacion, '') AS "Categoría",
       strftime(sys_created_on, '%Y-%m-%d %H:%M:%S.%f') AS fecha_asignacion, '' AS "Origen" FROM tickets
""")
def q_append_aligned(spark, sf):
    t = b.tickets(spark, sf).select("number", "short_description", F.col("clasificacion").alias("Clasificación"),
                                    F.date_format("sys_created_on", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened_at"))
    return csvio.append_aligned(["number", "short_description", "Categoría", "fecha_asignacion", "Origen"],
                                t.withColumn("Clasificación", F.coalesce("Clasificación", F.lit(""))))


@register("read_json_config", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def q_read_json_config(spark, sf):
    e = b.read_table(spark, sf, "events")
    return e.select("event_id", csvio.config_lookup(F.col("props"), "k"))\
            .toDF("event_id", "k")


@register("archive_runs_by_date", W + "SELECT number, assigned_to, state FROM history WHERE state IS NOT NULL")
def q_archive_runs(spark, sf):
    h = b.history(spark, sf).select("number", "assigned_to", "state")
    path = _scratch(spark, "history")
    # three runs, the last tried twice; the newest holds the tickets with a state
    csvio.append_history(h, path, h.columns, "2024-01-01_00-00-00")
    csvio.append_history(h.filter("state IS NULL"), path, h.columns, "2024-01-02_07-00-00")
    for _ in range(2):
        csvio.append_history(h.filter("state IS NOT NULL"), path, h.columns, "2024-01-02_08-30-00")
    return csvio.latest_run(spark.read.parquet(path)).select("number", "assigned_to", "state")


@register("stream_tickets", W + "SELECT number, category, u_subcategory, short_description, description FROM tickets")
def q_stream_tickets(spark, sf):
    t = b.tickets(spark, sf).select("number", "category", "u_subcategory", "short_description", "description")
    src = _scratch(spark, "inbox")
    out = _scratch(spark, "stream-out")
    ckpt = _scratch(spark, "stream-ckpt")
    stream.drop_files(t, src, parts=4)
    stream.run_available(spark, src, t.schema, out, ckpt, multiline=True)
    return spark.read.parquet(out).select(*t.columns)


@register("latest_version", W + "SELECT 10 AS version, number, category FROM tickets WHERE ord % 3 = 1")
def q_latest_version(spark, sf):
    """Three versions of an export; the largest number is read, though it was written first."""
    t = b.tickets(spark, sf).select("ord", "number", "category")
    folder = _scratch(spark, "versions")
    for version, part in ((10, 1), (9, 0), (2, 2)):
        csvio.write_delimited(t.filter(F.col("ord") % 3 == part).drop("ord"), f"{folder}/training_v{version}.csv", encoding="UTF-8")
    newest = csvio.latest_version(spark, folder).first()
    return csvio.scan_tickets(spark, newest["path"], encoding="UTF-8").withColumn("version", F.lit(newest["version"]).cast("int"))
