"""Registered queries: shifts, routing and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import fixed
from ..functions.text import sql_str
from ..operators import assign as asg
from ..operators import dimensions as dim
from ..operators import projections as pj
from ..operators import workload as wl
from ..session import written
from ..sources import bindings as b
from .catalog import register
from .q_profile import BASE_SQL
from .q_workload import AS_OF, WINDOW
from .sqlfrag import canonical_expr, s_group_key, s_singular, s_strip, users_ctes, workload_ctes


def routing_class(clase, ord_, lang):
    return (F.when(clase != fixed.UNCLASSIFIED, clase)
             .when(ord_ % 10 == 7, F.lit("otros temas"))
             .when(lang == "es", F.lit(""))
             .when(lang == "en", F.lit("reportes online"))
             .when(lang == "fr", F.lit("reporte batch"))
             .otherwise(F.lit("usuario final")))


_RCLASS_SQL = ("CASE WHEN clase <> 'sin_clasificar' THEN clase WHEN ord % 10 = 7 THEN 'otros temas' "
               "WHEN u_subcategory_2 = 'es' THEN '' WHEN u_subcategory_2 = 'en' THEN 'reportes online' "
               "WHEN u_subcategory_2 = 'fr' THEN 'reporte batch' ELSE 'usuario final' END")


def routing_tickets(spark, sf):
    clase = pj.repair_labels(F.col("clasificacion"))
    return b.tickets(spark, sf).select("ord", "number", "u_subcategory", "category", "contact_type", "sys_created_on", "u_subcategory_2",
                                       routing_class(clase, F.col("ord"), F.col("u_subcategory_2")).alias("rclass"))


_SEC = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
_WD = "(isodow(ts) - 1)"
_SHIFT = (f"CASE WHEN ts IS NULL THEN NULL WHEN {_WD} = 5 THEN (CASE WHEN {_SEC} < 21600 THEN 'Turno 3' WHEN {_SEC} < 50400 THEN 'Turno 4' ELSE 'Stand-by' END) "
          f"WHEN {_WD} = 6 THEN 'Stand-by' WHEN {_WD} = 0 AND {_SEC} < 21600 THEN 'Stand-by' "
          f"WHEN {_SEC} >= 21600 AND {_SEC} < 50400 THEN 'Turno 1' WHEN {_SEC} >= 50400 AND {_SEC} < 79200 THEN 'Turno 2' ELSE 'Turno 3' END")
_SDATE = f"CASE WHEN {_SEC} < 21600 AND {_WD} <> 6 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END"


@register("shift_band", "SELECT event_id, " + _SHIFT.replace("ts", "e.ts") + " AS shift, strftime(" + _SDATE.replace("ts", "e.ts")
          + ", '%Y-%m-%d') AS shift_date FROM events e")
def q_shift_band(spark, sf):
    e = b.read_table(spark, sf, "events")
    s, d = dt.shift_band(F.col("ts"))
    return e.select("event_id", s.alias("shift"), F.date_format(d, "yyyy-MM-dd").alias("shift_date"))


_CAL_CTES = f"""
, cal AS (SELECT shift_date AS cd, shift AS cs, first({s_strip('username')}) AS cu FROM shifts GROUP BY ALL)
, sb AS (SELECT cd AS sd, cu AS sbu FROM cal WHERE cs = 'Stand-by')
"""


def _shift_user_sql(src: str) -> str:
    j, can = canonical_expr("x", "su")
    return f"""
, band AS (SELECT s.*, {_SHIFT.replace('ts', 's.sys_created_on')} AS shift, {_SDATE.replace('ts', 's.sys_created_on')} AS sdate FROM {src} s)
, su0 AS (SELECT band.*, CASE WHEN c.cu IS NULL OR c.cu = '' THEN sb.sbu ELSE c.cu END AS u0
          FROM band LEFT JOIN cal c ON c.cd = band.sdate AND c.cs = band.shift LEFT JOIN sb ON sb.sd = band.sdate)
, su1 AS (SELECT su0.*, CASE WHEN u0 IS NULL OR {s_strip('u0')} = '' THEN NULL ELSE upper({s_strip('u0')}) END AS su FROM su0)
, shifted AS (SELECT x.*, CASE WHEN x.su IS NULL THEN NULL ELSE {can} END AS shift_user FROM su1 x {j})
"""


@register("shift_lookup", W_ := b.ORACLE_WITH + users_ctes() + _CAL_CTES + _shift_user_sql("tickets") + """
SELECT number, shift, strftime(sdate, '%Y-%m-%d') AS shift_date, shift_user FROM shifted
""")
def q_shift_lookup(spark, sf):
    t = b.tickets(spark, sf).select("number", "sys_created_on")
    s, d = dt.shift_band(F.col("sys_created_on"))
    t = t.withColumn("shift", s).withColumn("shift_date", d)
    r = asg.shift_lookup(t, "sys_created_on", b.shifts(spark, sf), dim.prepare_users(b.users(spark, sf)))
    return r.select("number", "shift", F.date_format("shift_date", "yyyy-MM-dd").alias("shift_date"), "shift_user")


_KEYS_CTES = f"""
, gk0 AS (SELECT DISTINCT grp, grp_order FROM group_members)
, gk1 AS (SELECT {s_group_key('grp')} AS key, grp, grp_order * 2 AS pos FROM gk0
          UNION ALL SELECT {s_singular(s_group_key('grp'))} AS key, grp, grp_order * 2 + 1 AS pos FROM gk0)
, keys AS (SELECT key, arg_max(grp, pos) AS grp, min(pos) AS first_pos FROM gk1 WHERE key <> '' GROUP BY key)
"""


def _cmap_sql(src: str, col: str) -> str:
    return f"""
, dc AS (SELECT DISTINCT {col} AS cls FROM {src} WHERE {col} IS NOT NULL)
, dcn AS (SELECT cls, {s_group_key('cls')} AS norm, {s_singular(s_group_key('cls'))} AS sing FROM dc)
, cont AS (SELECT d.cls, arg_min(k.grp, k.first_pos) AS g3 FROM dcn d JOIN keys k
           ON d.norm = k.key OR contains(k.key, d.norm) OR contains(d.norm, k.key) GROUP BY d.cls)
, cmap AS (SELECT d.cls, coalesce(k1.grp, k2.grp, cont.g3) AS grp FROM dcn d LEFT JOIN keys k1 ON k1.key = d.norm
           LEFT JOIN keys k2 ON k2.key = d.sing LEFT JOIN cont ON cont.cls = d.cls)
"""


_RT_CTE = BASE_SQL.replace(b.ORACLE_WITH, "") + f"""
, rt AS (SELECT t.ord, t.number, t.u_subcategory, t.category, t.contact_type, t.sys_created_on,
                {_RCLASS_SQL.replace('clase', 'x.clase').replace('ord %', 't.ord %').replace('u_subcategory_2', 'x.u_subcategory_2')} AS rclass
         FROM tickets t JOIN base x ON x.number = t.number)
"""


@register("class_to_group", b.ORACLE_WITH + _RT_CTE + _KEYS_CTES + _cmap_sql("rt", "rclass") + """
SELECT cls AS rclass, grp FROM cmap
""")
def q_class_to_group(spark, sf):
    t = routing_tickets(spark, sf).select("rclass").distinct().filter(F.col("rclass").isNotNull())
    return dim.class_to_group(t, "rclass", b.group_members(spark, sf))


_CAND_CTES = f"""
, memd AS (SELECT DISTINCT grp, member FROM group_members)
, mk AS (SELECT m.grp, m.member, {canonical_expr('m', 'member')[1]} AS member_key FROM memd m {canonical_expr('m', 'member')[0]})
, cand AS (SELECT mk.*, CASE WHEN NOT (SELECT a FROM anyact) THEN true ELSE coalesce(d.active, false) END AS is_active
           FROM mk LEFT JOIN udir d ON d.username = mk.member_key)
"""


@register("group_candidates", b.ORACLE_WITH + users_ctes() + _CAND_CTES + "SELECT grp, member, member_key, is_active FROM cand")
def q_group_candidates(spark, sf):
    c = dim.group_candidates(b.group_members(spark, sf), dim.prepare_users(b.users(spark, sf)))
    return c.select("grp", "member", "member_key", "is_active")


_RULE = (f"(coalesce({s_strip('r.category')} = {sql_str(fixed.SHIFT_RULE_CATEGORY)}, false) OR "
         f"coalesce({s_strip('r.u_subcategory')} = {sql_str(fixed.SHIFT_RULE_SUBCATEGORY)}, false) OR "
         f"coalesce({s_strip('r.contact_type')} = {sql_str(fixed.SHIFT_RULE_CONTACT)}, false))")

_ROUTE_SQL = (b.ORACLE_WITH + users_ctes() + workload_ctes(AS_OF, WINDOW) + _RT_CTE + _KEYS_CTES + _cmap_sql("rt", "rclass")
              + _CAL_CTES + _shift_user_sql("rt") + _CAND_CTES + f"""
, ncand AS (SELECT grp, count(*) AS nc FROM cand WHERE is_active GROUP BY grp)
, routed0 AS (
  SELECT r.number, r.sys_created_on, r.shift_user, cmap.grp,
         CASE WHEN {_RULE} THEN 'rule_shift'
              WHEN coalesce(r.rclass IN ('trickle feed', 'reporte batch'), false) THEN 'class_shift'
              WHEN r.rclass IS NULL OR {s_strip('r.rclass')} = '' THEN 'unclassified'
              WHEN cmap.grp IS NULL THEN 'no_group'
              WHEN coalesce(ncand.nc, 0) = 0 THEN 'no_members' ELSE 'balanced' END AS route,
         CASE WHEN {_RULE} THEN 'turno' ELSE r.rclass END AS rclass
  FROM shifted r LEFT JOIN cmap ON cmap.cls = r.rclass LEFT JOIN ncand ON ncand.grp = cmap.grp
)
, sadd AS (SELECT shift_user AS assignee, count(*) AS a FROM routed0 WHERE route IN ('rule_shift', 'class_shift')
           AND shift_user IS NOT NULL GROUP BY ALL)
, load2 AS (SELECT coalesce(w.assignee, s.assignee) AS assignee, coalesce(w.open, 0) + coalesce(s.a, 0) AS open,
                   coalesce(w.resolved, 0) AS resolved FROM wload w FULL OUTER JOIN sadd s ON s.assignee = w.assignee)
, candload AS (SELECT DISTINCT c.grp, c.member_key, coalesce(l.open, 0) + coalesce(l.resolved, 0) * {fixed.RESOLVED_WEIGHT} AS effective
               FROM cand c LEFT JOIN load2 l ON l.assignee = c.member_key WHERE c.is_active)
, bt AS (SELECT number, grp, row_number() OVER (PARTITION BY grp ORDER BY sys_created_on, number) AS k FROM routed0 WHERE route = 'balanced')
, nt AS (SELECT grp, count(*) AS n FROM bt GROUP BY grp)
, sl AS (SELECT c.grp, c.member_key, c.effective + unnest(range(nt.n)) AS v FROM candload c JOIN nt ON nt.grp = c.grp)
, slk AS (SELECT grp, member_key, row_number() OVER (PARTITION BY grp ORDER BY v, member_key) AS k FROM sl)
, bal AS (SELECT bt.number, slk.member_key FROM bt JOIN slk ON slk.grp = bt.grp AND slk.k = bt.k)
, routed AS (
  SELECT r.number, r.route, r.grp, r.rclass,
         CASE WHEN r.route IN ('rule_shift', 'class_shift') THEN coalesce(r.shift_user, '{fixed.TURNO}')
              WHEN r.route = 'unclassified' THEN '{fixed.SIN_CLASIFICACION}'
              WHEN r.route = 'no_group' THEN '{fixed.SIN_GRUPO}'
              WHEN r.route = 'no_members' THEN '{fixed.SIN_MIEMBROS}' ELSE bal.member_key END AS assigned_to
  FROM routed0 r LEFT JOIN bal ON bal.number = r.number
)
""")


def _routed(spark, sf):
    u = dim.prepare_users(b.users(spark, sf))
    return asg.route_tickets(routing_tickets(spark, sf), "rclass", b.group_members(spark, sf), u,
                             b.history(spark, sf), b.shifts(spark, sf), AS_OF, window_days=WINDOW)


@register("route_tickets", _ROUTE_SQL + "SELECT number, route, grp, rclass, assigned_to FROM routed")
def q_route_tickets(spark, sf):
    return _routed(spark, sf).select("number", "route", "grp", "rclass", "assigned_to")


@register("balance_fill", _ROUTE_SQL + "SELECT grp, assigned_to, count(*) AS n FROM routed WHERE route = 'balanced' GROUP BY ALL")
def q_balance_fill(spark, sf):
    r = _routed(spark, sf).filter(F.col("route") == "balanced")
    return r.groupBy("grp", "assigned_to").agg(F.count(F.lit(1)).alias("n"))


@register("least_loaded_member", b.ORACLE_WITH + users_ctes() + workload_ctes(AS_OF, WINDOW) + _CAND_CTES + f"""
, cl AS (SELECT DISTINCT c.grp, c.member_key, coalesce(w.open, 0) + coalesce(w.resolved, 0) * {fixed.RESOLVED_WEIGHT} AS effective
         FROM cand c LEFT JOIN wload w ON w.assignee = c.member_key WHERE c.is_active)
SELECT grp, member_key, effective FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY effective, member_key) AS r FROM cl) WHERE r = 1
""")
def q_least_loaded_member(spark, sf):
    from pyspark.sql.window import Window
    u = dim.prepare_users(b.users(spark, sf))
    cand = dim.group_candidates(b.group_members(spark, sf), u).filter("is_active")
    ml = wl.member_workload(cand, wl.workload(b.history(spark, sf), u, AS_OF, WINDOW)).select("grp", "member_key", "effective").distinct()
    w = Window.partitionBy("grp").orderBy("effective", "member_key")
    return ml.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@register("arrival_rank", b.ORACLE_WITH + """
SELECT number, row_number() OVER (PARTITION BY u_subcategory_2 ORDER BY sys_created_on, number) AS arrival FROM tickets
""")
def q_arrival_rank(spark, sf):
    t = b.tickets(spark, sf)
    return asg.arrival_rank(t, "u_subcategory_2", ["sys_created_on", "number"]).select("number", "arrival")


@register("run_summary", _ROUTE_SQL + """
SELECT 'total' AS kind, NULL AS assigned_to, count(*) AS n, count(DISTINCT assigned_to) AS assignees FROM routed
UNION ALL
SELECT 'top' AS kind, assigned_to, n, NULL AS assignees FROM (SELECT assigned_to, count(*) AS n FROM routed GROUP BY ALL ORDER BY n DESC, assigned_to LIMIT 5)
""")
def q_run_summary(spark, sf):
    r = written(_routed(spark, sf).select("assigned_to"), "routed")
    totals, top = asg.run_summary(r)
    a = totals.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("assigned_to"),
                      F.col("rows").alias("n"), F.col("assignees"))
    c = top.select(F.lit("top").alias("kind"), "assigned_to", "n", F.lit(None).cast("bigint").alias("assignees"))
    return a.unionByName(c)


# ----------------------------------------------------------------- dates
@register("parse_timestamp_multi", """
SELECT event_id, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d'),
                          try_strptime(s, '%d/%m/%Y %H:%M:%S')) AS parsed
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                                         WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS s
      FROM events)
""")
def q_parse_timestamp_multi(spark, sf):
    e = b.read_table(spark, sf, "events")
    s = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
          .when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
          .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select("event_id", dt.parse_timestamp_multi(s).alias("parsed"))


@register("parse_resolved_dayfirst", """
SELECT o_orderkey, coalesce(try_strptime(s, '%d/%m/%Y %H:%M:%S'), try_strptime(s, '%d/%m/%Y'),
                            try_strptime(s, '%Y-%m-%d')) AS resolved
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S')
            WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS s FROM orders)
""")
def q_parse_resolved(spark, sf):
    o = b.read_table(spark, sf, "orders")
    s = (F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
          .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
          .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
          .otherwise(F.lit("n/a")))
    return o.select("o_orderkey", dt.parse_resolved_dayfirst(s).alias("resolved"))


@register("parse_shift_date", b.ORACLE_WITH + """
SELECT strftime(shift_date, '%d/%m/%Y') AS fecha, strftime(shift_date, '%Y-%m-%d') AS shift_date FROM (SELECT DISTINCT shift_date FROM shifts)
""")
def q_parse_shift_date(spark, sf):
    s = b.shift_sheet(spark, sf)
    return s.select(F.col("Fecha").alias("fecha"), F.date_format(dt.parse_shift_date(F.col("Fecha"), "dd/MM/yyyy"), "yyyy-MM-dd").alias("shift_date"))


_RES_R = "(('0x' || substr(sha256('42|' || number), 1, 8))::BIGINT % 6)"


@register("resolution_date", b.ORACLE_WITH + f"""
, x AS (SELECT number, sys_created_on + INTERVAL 1 MONTH AS base, {_RES_R} AS r FROM tickets)
, y AS (SELECT number, base, base - r * INTERVAL 1 DAY AS calc FROM x)
, z AS (SELECT number, base, calc - greatest(isodow(calc) - 5, 0) * INTERVAL 1 DAY AS workday FROM y)
SELECT number, strftime(workday + CASE WHEN workday < base - INTERVAL 5 DAY THEN 3 ELSE 0 END * INTERVAL 1 DAY, '%d/%m/%Y %H:%M:%S') AS fecha_resolucion
FROM z
""")
def q_resolution_date(spark, sf):
    t = b.tickets(spark, sf)
    return t.select("number", dt.resolution_date(F.col("sys_created_on"), F.col("number")).alias("fecha_resolucion"))


@register("format_due_date", f"""
SELECT event_id, CASE WHEN s IS NULL OR trim(s) = '' THEN strftime(TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY, '%d/%m/%Y %H:%M:%S')
  ELSE coalesce(strftime(coalesce(try_strptime(trim(s), '%d/%m/%Y %H:%M:%S'), try_strptime(trim(s), '%d/%m/%Y'),
                try_strptime(trim(s), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(s), '%Y-%m-%d')), '%d/%m/%Y %H:%M:%S'), trim(s)) END AS due
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y')
      WHEN 2 THEN NULL WHEN 3 THEN ' pronto ' ELSE strftime(ts, '%Y-%m-%d') END AS s FROM events)
""")
def q_format_due_date(spark, sf):
    e = b.read_table(spark, sf, "events")
    s = (F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
          .when(F.col("event_id") % 5 == 1, F.date_format("ts", "dd/MM/yyyy"))
          .when(F.col("event_id") % 5 == 2, F.lit(None).cast("string"))
          .when(F.col("event_id") % 5 == 3, F.lit(" pronto "))
          .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select("event_id", dt.format_due_date(s, AS_OF).alias("due"))


@register("rolling_cutoff", f"""
SELECT count(*) AS n_recent FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
""")
def q_rolling_cutoff(spark, sf):
    o = b.read_table(spark, sf, "orders")
    return o.filter(F.col("o_orderdate") >= dt.rolling_cutoff(AS_OF, 7)).agg(F.count(F.lit(1)).alias("n_recent"))


@register("run_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def q_run_stamp(spark, sf):
    e = b.read_table(spark, sf, "events")
    return e.select("event_id", dt.run_stamp(F.col("ts")).alias("stamp"), dt.day_stamp(F.col("ts")).alias("day"))
