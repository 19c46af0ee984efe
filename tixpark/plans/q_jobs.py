"""Registered queries: the assignment jobs, their streaming form, update rows.

Each query writes through the job's sinks, reads them back and returns what it read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import dimensions as dim
from ..operators import jobs
from ..operators import projections as pj
from ..operators import updates as up
from ..session import scratch_path, written
from ..sources import bindings as b
from ..sources import csvio
from ..sources.committed import CommittedStore
from ..streaming import stream
from .catalog import register
from .q_routing import _ROUTE_SQL, _RT_CTE, routing_tickets
from .q_text import _DCORE, _SCORE
from .q_workload import AS_OF, WINDOW
from .sqlfrag import s_strip

RUN = "2024-02-01_08-00-00"


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


def _desk(spark, sf):
    return jobs.Desk(b.group_members(spark, sf), dim.prepare_users(b.users(spark, sf)), b.history(spark, sf), b.shifts(spark, sf), AS_OF, WINDOW)


def _export(spark, sf):
    """An export with an assignee and a group that the job overwrites, and the routing class as its class."""
    t = written(routing_tickets(spark, sf), "export")
    return t.select("number", "u_subcategory", "category", "contact_type", "sys_created_on", F.lit("Nuevo").alias("state"),
                    F.lit("nobody").alias("assigned_to"), F.lit("old group").alias("assignment_group"), F.col("rclass").alias("Clasificación"))


def _reread(store):
    """One row per ticket from the three ticket sinks as they were committed."""
    a = store.read("assignments").select("run", "number", "route", "grp", "predicted_assigned_to", "predicted_assignment_group")
    h = store.read("history").select("run", "number", "state", F.col("assigned_to").alias("history_assignee"), F.col("assignment_group").alias("history_group"))
    return a.join(h, ["run", "number"])


_SINKS_SQL = """
SELECT '{run}' AS run, number, route, grp, assigned_to AS predicted_assigned_to, rclass AS predicted_assignment_group, 'Nuevo' AS state,
       assigned_to AS history_assignee, rclass AS history_group, {more} FROM routed
"""


@register("assign_incidents", _ROUTE_SQL + _SINKS_SQL.format(run=RUN, more="coalesce(rclass, '') AS training_class"))
def q_assign_incidents(spark, sf):
    store = CommittedStore(spark, _scratch(spark, "incidents"))
    jobs.assign_incidents(_export(spark, sf), _desk(spark, sf), store, RUN, training_columns=("number", "Categoría"))
    t = store.read("training").select("number", F.coalesce(F.col("Categoría"), F.lit("")).alias("training_class"))
    return _reread(store).join(t, "number")


_RT_REQ = _RT_CTE.replace(", rt AS (", ", rt0 AS (") + f"""
, rt AS (SELECT r.* REPLACE (CASE WHEN coalesce(ft, '') = '' THEN '{fixed.REVIEW_CLASS}' ELSE rclass END AS rclass)
         FROM rt0 r JOIN (SELECT number, {tx.sql_choose_text(_DCORE, _SCORE)} AS ft FROM tickets) USING (number))
"""
_RES_SQL = """
SELECT s.*, strftime(workday + CASE WHEN workday < base - INTERVAL 5 DAY THEN 3 ELSE 0 END * INTERVAL 1 DAY, '%d/%m/%Y %H:%M:%S') AS fecha_resolucion
FROM sinks s JOIN (SELECT number, base, calc - greatest(isodow(calc) - 5, 0) * INTERVAL 1 DAY AS workday
                   FROM (SELECT number, base, base - r * INTERVAL 1 DAY AS calc
                         FROM (SELECT number, sys_created_on + INTERVAL 1 MONTH AS base, {r} AS r FROM tickets))) USING (number)
"""


def _requirement_oracle():
    from .q_routing import _RES_R
    sinks = _SINKS_SQL.format(run=RUN, more="coalesce(rclass, '') AS training_class")
    return _ROUTE_SQL.replace(_RT_CTE, _RT_REQ) + f", sinks AS ({sinks})" + _RES_SQL.format(r=_RES_R)


def _assign_requirements(spark, sf, store, training_columns=("number", "clasificacion")):
    def review(df):
        """M25's text steps and P14: a requirement without usable text goes to review."""
        core = [tx.strip_boilerplate(tx.mask_entities(F.col(c))).alias(f"_{c}") for c in ("description", "short_description")]
        final = written(b.tickets(spark, sf).select("number", *core), "cores")
        final = final.select("number", tx.choose_text(F.col("_description"), F.col("_short_description")).alias("_ft"))
        x = df.join(final, "number")
        # the job reads the classes twice: texts are chosen once
        return written(x.withColumn("Clasificación", pj.empty_text_to_review(F.col("_ft"), F.col("Clasificación"))).drop("_ft"), "reviewed")

    export = _export(spark, sf).withColumnRenamed("sys_created_on", "opened_at")
    jobs.assign_requirements(export, _desk(spark, sf), store, RUN, review, training_columns=training_columns)


@register("assign_requirements", _requirement_oracle())
def q_assign_requirements(spark, sf):
    store = CommittedStore(spark, _scratch(spark, "requirements"))
    _assign_requirements(spark, sf, store)
    t = store.read("training").select("number", F.col("clasificacion").alias("training_class"))
    dates = store.read("assignments").select("number", "fecha_resolucion")
    return _reread(store).join(t.withColumn("training_class", F.coalesce("training_class", F.lit(""))), "number").join(dates, "number")


# ------------------------------------------------------------- update rows
BASE_URL = "https://desk.example/"
ITEMS = '{"Bancs": "item-7"}'


def _update_sql(assigned: str, requirement: bool) -> str:
    due = f"coalesce(fecha_resolucion, strftime(TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY, '%d/%m/%Y %H:%M:%S'))" if requirement else "CAST(NULL AS VARCHAR)"
    app, item, state = (f"'{v}'" if requirement else "CAST(NULL AS VARCHAR)" for v in (fixed.APPLICATION, "item-7", fixed.UPDATED_STATE))
    table = fixed.REQUIREMENT_TABLE if requirement else fixed.INCIDENT_TABLE
    return f"""
WITH a AS ({assigned})
, x AS (SELECT *, {s_strip('predicted_assigned_to')} AS who FROM a)
, u AS (SELECT upper({s_strip('nombre')}) AS sn, lower({s_strip('usuario')}) AS su, {s_strip('sys_id')} AS sid, ord
        FROM ({b.ORACLE_WITH} SELECT * FROM users) WHERE {s_strip('sys_id')} <> '')
, bn AS (SELECT sn, arg_max(sid, ord) AS sid_n FROM u WHERE sn <> '' GROUP BY sn)
, bu AS (SELECT su, arg_max(sid, ord) AS sid_u FROM u WHERE su <> '' GROUP BY su)
SELECT '{table}' AS record_table, number, who AS assigned_to, coalesce(sid_n, sid_u, '') AS assigned_to_id, {due} AS due_date, {app} AS application,
       {item} AS application_id, {state} AS state, 'https://desk.example/{table}.do?sysparm_query=number=' || number AS url
FROM x LEFT JOIN bn ON sn = upper(who) LEFT JOIN bu ON su = lower(who) WHERE who <> '' AND lower(who) <> 'nan'
"""


@register("update_records", _update_sql(_requirement_oracle(), True))
def q_update_records(spark, sf):
    """J14 over the requirements that a run committed."""
    store = CommittedStore(spark, _scratch(spark, "requirements"))
    _assign_requirements(spark, sf, store)
    a = store.read("assignments").select("number", "predicted_assigned_to", "fecha_resolucion")
    return up.update_records(a, b.users(spark, sf), BASE_URL, AS_OF, True, csvio.config_lookup(F.lit(ITEMS), fixed.APPLICATION), "predicted_assigned_to")


@register("update_records_incidents", _update_sql(_ROUTE_SQL + "SELECT number, assigned_to AS predicted_assigned_to FROM routed", False))
def q_update_records_incidents(spark, sf):
    """J14 over the incidents that a run committed."""
    store = CommittedStore(spark, _scratch(spark, "incidents"))
    jobs.assign_incidents(_export(spark, sf), _desk(spark, sf), store, RUN, training_columns=("number", "Categoría"))
    return up.update_records(store.read("assignments"), b.users(spark, sf), BASE_URL, AS_OF, False, assignee="predicted_assigned_to")


@register("write_summary_text", _ROUTE_SQL + f"""
, top5 AS (SELECT assigned_to, count(*) AS n FROM routed GROUP BY ALL ORDER BY n DESC, assigned_to LIMIT 5)
SELECT 1 AS pos, 'Incident Assignment Summary - {RUN}' AS line
UNION ALL SELECT 2, 'Incidents processed: ' || count(*) FROM routed
UNION ALL SELECT 3, 'Unique assignees predicted: ' || count(DISTINCT assigned_to) FROM routed
UNION ALL SELECT 4, 'Top 5 predicted assignees:'
UNION ALL SELECT CAST(4 + row_number() OVER (ORDER BY n DESC, assigned_to) AS INTEGER),
                 CASE WHEN length(assigned_to) >= 50 THEN assigned_to ELSE rpad(assigned_to, 50, ' ') END || ' ' || n FROM top5
""")
def q_write_summary_text(spark, sf):
    store = CommittedStore(spark, _scratch(spark, "summary"))
    jobs.assign_incidents(_export(spark, sf), _desk(spark, sf), store, RUN, training_columns=("number", "Categoría"))
    return store.read("summary").select("pos", "line")


# ------------------------------------------------------------- streaming
BATCHES = 3
_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stage_sql(k: int) -> str:
    """The routing of micro-batch k against the history and the batches before it."""
    past = "".join(f" UNION ALL SELECT assigned_to, 'Nuevo' AS state, CAST(NULL AS TIMESTAMP) AS resolved_at FROM s{i}" for i in range(k))
    sql = _ROUTE_SQL.replace("FROM history WHERE", f"FROM (SELECT assigned_to, state, resolved_at FROM history{past}) AS known WHERE")
    return sql.replace(_RT_CTE, _RT_CTE.rstrip().removesuffix(")") + f" WHERE t.ord % {BATCHES} = {k})\n") \
        + f"SELECT {k} AS batch, number, route, grp, assigned_to FROM routed"


_STREAM_SQL = "WITH " + ", ".join(f"s{k} AS ({_stage_sql(k)})" for k in range(BATCHES)) + " SELECT * FROM (" \
    + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(BATCHES)) + ")"


@register("stream_assign", _STREAM_SQL)
def q_stream_assign(spark, sf):
    """Three drops of an export, each a micro-batch that finds what the ones before it assigned."""
    t = written(routing_tickets(spark, sf).withColumn("sys_created_on", F.date_format("sys_created_on", _STAMP)), "drops")
    t = t.withColumn("state", F.lit("Nuevo"))
    store = CommittedStore(spark, _scratch(spark, "stream-store"))
    folder, checkpoint, desk = _scratch(spark, "stream-in"), _scratch(spark, "stream-ck"), _desk(spark, sf)

    def prepare(s):
        s = s.withColumn("rclass", F.coalesce("rclass", F.lit("")))      # the file has no empty texts, only nulls
        return s.withColumn("sys_created_on", F.to_timestamp_ntz("sys_created_on", F.lit(_STAMP)))

    for k in range(BATCHES):
        stream.drop_files(t.where(F.col("ord") % BATCHES == k), folder, parts=4)
        stream.stream_assign(spark, folder, t.schema, desk, store, checkpoint, prepare, class_col="rclass", training_columns=("number", "Categoría"))
    a = store.read("assignments").select("run", "number", "route", "grp")
    h = store.read("history").select("run", "number", "assigned_to")
    return a.join(h, ["run", "number"]).select(F.substring("run", -9, 9).cast("int").alias("batch"), "number", "route", "grp", "assigned_to")


@register("stream_workload", b.ORACLE_WITH + "SELECT assigned_to, count(*) AS n FROM history GROUP BY ALL")
def q_stream_workload(spark, sf):
    """T4: counters over three drops of the history."""
    h = b.history(spark, sf).select("ord", "assigned_to", "state")
    folder, out, checkpoint = (_scratch(spark, f"load-{n}") for n in ("in", "out", "ck"))
    for k in range(BATCHES):
        stream.drop_files(h.where(F.col("ord") % BATCHES == k), folder, parts=2)
        stream.stream_workload(spark, folder, h.schema, out, checkpoint)
    return stream.current_counts(spark.read.parquet(out)).select("assigned_to", "n")
