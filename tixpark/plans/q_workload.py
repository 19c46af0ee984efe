"""Registered queries: dimensions, workload and the group report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import sql_name_token_key
from ..operators import dimensions as dim
from ..operators import workload as wl
from ..sources import bindings as b
from .catalog import register
from .sqlfrag import (canonical_expr, pad_left, pad_right, s_strip, users_ctes, workload_ctes)

AS_OF = b.AS_OF
WINDOW = fixed.RESOLVED_DAYS_WINDOW
W = b.ORACLE_WITH


def _users(spark, sf):
    return dim.prepare_users(b.users(spark, sf))


# ---------------------------------------------------------------- A19 (flagship)
_REPORT_SQL = W + users_ctes() + workload_ctes(AS_OF, WINDOW) + f"""
, mem AS (SELECT DISTINCT grp, member FROM group_members)
, mem2 AS (
  SELECT m.grp, m.member, {canonical_expr('m', 'member')[1]} AS member_key
  FROM mem m {canonical_expr('m', 'member')[0]}
), mem3 AS (
  SELECT m.*, CASE WHEN NOT (SELECT a FROM anyact) THEN true ELSE coalesce(d.active, false) END AS is_active,
         coalesce(d.realname, m.member_key) AS display_name,
         CAST(coalesce(w.open, 0) AS BIGINT) AS tickets
  FROM mem2 m LEFT JOIN udir d ON d.username = m.member_key LEFT JOIN wload w ON w.assignee = m.member_key
), rep AS (
  SELECT grp, member, CASE WHEN grouping(member) = 1 THEN NULL ELSE first(display_name) END AS display_name,
         CASE WHEN grouping(member) = 1 THEN NULL ELSE first(is_active) END AS is_active,
         CAST(sum(tickets) AS BIGINT) AS tickets, count(*) AS users, CAST(grouping(member) AS INTEGER) AS is_total
  FROM mem3 GROUP BY GROUPING SETS ((grp, member), (grp))
)
SELECT grp, member, display_name, is_active, tickets, users, is_total,
       CASE WHEN is_total = 1 THEN 'Total Users in Group: ' || CAST(users AS VARCHAR) || ' | Total Tickets in Group: ' || CAST(tickets AS VARCHAR)
            ELSE {pad_right('display_name', 50)} || ' ' || {pad_left('CAST(tickets AS VARCHAR)', 3)} || ' tickets'
                 || CASE WHEN is_active THEN '' ELSE ' {fixed.INACTIVE_TAG}' END END AS line
FROM rep ORDER BY grp, is_total, tickets DESC, member
"""


@register("group_workload_report", _REPORT_SQL)
def q_group_workload_report(spark, sf):
    return wl.group_workload_report(b.group_members(spark, sf), _users(spark, sf), b.history(spark, sf), AS_OF, WINDOW)


# ---------------------------------------------------------------- A13-A15
_LOAD_SQL = W + users_ctes() + workload_ctes(AS_OF, WINDOW) + """
SELECT assignee, open, resolved, effective FROM wload
"""


@register("effective_workload", _LOAD_SQL)
def q_effective_workload(spark, sf):
    return wl.workload(b.history(spark, sf), _users(spark, sf), AS_OF, WINDOW)


@register("open_workload", W + users_ctes() + workload_ctes(AS_OF, WINDOW) + "SELECT assignee, open FROM wload WHERE open > 0")
def q_open_workload(spark, sf):
    return wl.workload(b.history(spark, sf), _users(spark, sf), AS_OF, WINDOW).filter("open > 0").select("assignee", "open")


@register("resolved_workload", W + users_ctes() + workload_ctes(AS_OF, WINDOW) + "SELECT assignee, resolved FROM wload WHERE resolved > 0")
def q_resolved_workload(spark, sf):
    return (wl.workload(b.history(spark, sf), _users(spark, sf), AS_OF, WINDOW)
            .filter("resolved > 0").select("assignee", "resolved"))


@register("union_histories", W + """
SELECT 'incident' AS ticket_type, number, assigned_to, state FROM history
UNION ALL
SELECT 'requirement' AS ticket_type, number, assigned_to, NULL AS state FROM history WHERE ord % 2 = 0
""")
def q_union_histories(spark, sf):
    h = b.history(spark, sf)
    inc = h.select(F.lit("incident").alias("ticket_type"), "number", "assigned_to", "state")
    req = h.filter(F.col("ord") % 2 == 0).select(F.lit("requirement").alias("ticket_type"), "number", "assigned_to")
    return wl.union_histories(inc, req)


# ---------------------------------------------------------------- A16
_MEAN_SQL = W + users_ctes() + workload_ctes(AS_OF, WINDOW) + f"""
, mem AS (SELECT DISTINCT grp, member FROM group_members)
, mem2 AS (SELECT m.grp, m.member, {canonical_expr('m', 'member')[1]} AS member_key FROM mem m {canonical_expr('m', 'member')[0]})
, mem3 AS (
  SELECT m.*, CASE WHEN NOT (SELECT a FROM anyact) THEN true ELSE coalesce(d.active, false) END AS is_active,
         coalesce(w.open, 0) + coalesce(w.resolved, 0) * {fixed.RESOLVED_WEIGHT} AS effective
  FROM mem2 m LEFT JOIN udir d ON d.username = m.member_key LEFT JOIN wload w ON w.assignee = m.member_key
)
SELECT grp, avg(effective) AS group_mean, avg(effective) + {fixed.OVERLOAD_MARGIN} AS threshold, count(*) AS n_active
FROM mem3 WHERE is_active GROUP BY grp
"""


@register("group_mean_threshold", _MEAN_SQL)
def q_group_mean_threshold(spark, sf):
    u = _users(spark, sf)
    cand = dim.group_candidates(b.group_members(spark, sf), u)
    ml = wl.member_workload(cand, wl.workload(b.history(spark, sf), u, AS_OF, WINDOW))
    return wl.group_mean_threshold(ml)


# ---------------------------------------------------------------- A18
_LIST_SQL = W + users_ctes() + workload_ctes(AS_OF, WINDOW) + f"""
, mem AS (SELECT DISTINCT member FROM group_members)
, memk AS (SELECT DISTINCT {canonical_expr('m', 'member')[1]} AS assignee FROM mem m {canonical_expr('m', 'member')[0]})
, allk AS (SELECT assignee FROM wload UNION SELECT assignee FROM memk)
, x AS (
  SELECT a.assignee, coalesce(w.open, 0) AS open, coalesce(w.resolved, 0) AS resolved,
         coalesce(w.open, 0) + coalesce(w.resolved, 0) * {fixed.RESOLVED_WEIGHT} AS effective,
         CASE WHEN NOT (SELECT a FROM anyact) THEN true ELSE coalesce(d.active, false) END AS is_active,
         coalesce(d.realname, a.assignee) AS display_name
  FROM allk a LEFT JOIN wload w ON w.assignee = a.assignee LEFT JOIN udir d ON d.username = a.assignee
)
SELECT assignee, open, resolved, effective, is_active, display_name,
       {pad_right('display_name', 50)} || ' ' || {pad_left('CAST(open AS VARCHAR)', 3)} || ' tickets'
       || CASE WHEN is_active THEN '' ELSE ' {fixed.INACTIVE_TAG}' END AS line
FROM x
"""


@register("workload_listing", _LIST_SQL)
def q_workload_listing(spark, sf):
    return wl.workload_listing(b.group_members(spark, sf), _users(spark, sf), b.history(spark, sf), AS_OF, WINDOW)


# ---------------------------------------------------------------- J1
_UNPIVOT_SQL = W + """
, sheet AS (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY member) AS r FROM group_members)
SELECT grp, g.grp_order, member, 1 AS level
FROM sheet JOIN (SELECT DISTINCT grp, grp_order FROM group_members) g USING (grp)
"""


@register("unpivot_groups", W + "SELECT grp, grp_order, member, 1 AS level FROM group_members")
def q_unpivot_groups(spark, sf):
    sheet = b.group_sheet(spark, sf)
    return dim.unpivot_groups(sheet)


# ---------------------------------------------------------------- J5
_CANON_SQL = W + users_ctes() + f"""
, names AS (SELECT DISTINCT assigned_to FROM history)
SELECT n.assigned_to, {canonical_expr('n', 'assigned_to')[1]} AS canonical
FROM names n {canonical_expr('n', 'assigned_to')[0]}
"""


@register("canonical_assignee", _CANON_SQL)
def q_canonical_assignee(spark, sf):
    names = b.history(spark, sf).select("assigned_to").distinct()
    return dim.canonical_assignee(names, "assigned_to", _users(spark, sf))


# ---------------------------------------------------------------- J6 + J7
_ACTIVE_SQL = W + users_ctes() + f"""
, names AS (SELECT DISTINCT assigned_to FROM history)
, c AS (SELECT n.assigned_to, {canonical_expr('n', 'assigned_to')[1]} AS canonical FROM names n {canonical_expr('n', 'assigned_to')[0]})
SELECT c.assigned_to, c.canonical,
       CASE WHEN NOT (SELECT a FROM anyact) THEN true ELSE coalesce(d.active, false) END AS is_active,
       coalesce(d.realname, c.canonical) AS display_name
FROM c LEFT JOIN udir d ON d.username = c.canonical
"""


@register("active_display_name", _ACTIVE_SQL)
def q_active_display(spark, sf):
    u = _users(spark, sf)
    names = b.history(spark, sf).select("assigned_to").distinct()
    c = dim.canonical_assignee(names, "assigned_to", u)
    return dim.display_name(dim.active_filter(c, "canonical", u), "canonical", u)


# ---------------------------------------------------------------- J9
_PRIMARY_SQL = W + f"""
, pg AS (
  SELECT upper({s_strip('nombre')}) AS name,
         arg_max(CASE WHEN sys_id IS NULL THEN '{fixed.NO_GROUP_FOUND}' ELSE 'G-' || substr(sys_id, 4) END, ord) AS g
  FROM users GROUP BY 1
), names AS (SELECT DISTINCT assigned_to FROM history)
SELECT n.assigned_to,
       CASE WHEN n.assigned_to IS NULL THEN '{fixed.NO_GROUP_FOUND}'
            WHEN upper({s_strip('n.assigned_to')}) = '{fixed.TURNO}' THEN '{fixed.TURNO}'
            ELSE coalesce(pg.g, '{fixed.NO_GROUP_FOUND}') END AS predicted_assignment_group
FROM names n LEFT JOIN pg ON pg.name = upper({s_strip('n.assigned_to')})
"""


@register("primary_group", _PRIMARY_SQL)
def q_primary_group(spark, sf):
    u = b.users(spark, sf)
    groups = u.select(F.col("nombre").alias("NOMBRE"),
                      F.when(F.col("sys_id").isNull(), F.lit(None))
                       .otherwise(F.concat(F.lit("G-"), F.expr("substr(sys_id, 4)"))).alias("GRUPO 1"),
                      "ord")
    names = b.history(spark, sf).select("assigned_to").distinct()
    return dim.primary_group(names, "assigned_to", groups, order_col="ord")


# ---------------------------------------------------------------- J10
_SYSID_SQL = W + f"""
, u AS (SELECT upper({s_strip('nombre')}) AS sn, lower({s_strip('usuario')}) AS su, {s_strip('sys_id')} AS sid, ord FROM users
        WHERE sys_id IS NOT NULL AND {s_strip('sys_id')} <> '' AND lower({s_strip('sys_id')}) <> 'nan')
, bn AS (SELECT sn, arg_max(sid, ord) AS sid_n FROM u WHERE sn <> '' GROUP BY sn)
, bu AS (SELECT su, arg_max(sid, ord) AS sid_u FROM u WHERE su <> '' GROUP BY su)
, names AS (SELECT DISTINCT assigned_to FROM history)
SELECT n.assigned_to, coalesce(bn.sid_n, bu.sid_u, '') AS sys_id
FROM names n LEFT JOIN bn ON bn.sn = upper({s_strip('n.assigned_to')}) LEFT JOIN bu ON bu.su = lower({s_strip('n.assigned_to')})
"""


@register("assignee_sys_id", _SYSID_SQL)
def q_assignee_sys_id(spark, sf):
    names = b.history(spark, sf).select("assigned_to").distinct()
    return dim.assignee_sys_id(names, "assigned_to", b.users(spark, sf))
