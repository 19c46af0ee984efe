"""DuckDB SQL fragments for the oracle side of ``oracle_sql()``.

They restate, in SQL, what the Spark operators compute, so the driver can
check each query against an engine that shares no code with Spark.
"""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import (GROUP_KEY_STEPS, WS, sql_name_token_key, sql_str, strip, to_sql)


def s_strip(e: str) -> str:
    return to_sql(e, [strip()])


def s_group_key(e: str) -> str:
    return to_sql(f"coalesce(cast({e} AS varchar), '')", GROUP_KEY_STEPS)


def s_singular(e: str) -> str:
    return f"regexp_replace({e}, 's( |$)', '\\1', 'g')"


def s_list(vals) -> str:
    return "(" + ", ".join(sql_str(v) for v in vals) + ")"


def s_closed(e: str) -> str:
    # title-case test == lower-case test for single words in the list
    return f"coalesce(lower({s_strip(e)}) IN {s_list([v.lower() for v in fixed.CLOSED_STATES])}, false)"


def users_ctes() -> str:
    return f"""
, up AS (
  SELECT upper({s_strip('usuario')}) AS username, upper({s_strip('nombre')}) AS realname, ord AS uord,
         {sql_name_token_key(f"upper({s_strip('nombre')})")} AS token_key,
         (estado IS NULL OR {s_strip('estado')} = '1') AS active
  FROM users
  WHERE usuario IS NOT NULL AND nombre IS NOT NULL AND {s_strip('usuario')} <> '' AND {s_strip('nombre')} <> ''
), udir AS (
  SELECT username, arg_max(realname, uord) AS realname, bool_or(active) AS active FROM up GROUP BY username
), tdir AS (
  SELECT token_key, arg_max(username, uord) AS tk_username FROM up WHERE token_key <> '' GROUP BY token_key
), anyact AS (
  SELECT coalesce(bool_or(active), false) AS a FROM up
)"""


def canonical_expr(alias: str, col: str) -> tuple[str, str]:
    """Returns (join clause, canonical expression) for ``alias.col``."""
    up = f"upper({s_strip(f'{alias}.{col}')})"
    j = (f" LEFT JOIN udir cu_{alias} ON cu_{alias}.username = {up}"
         f" LEFT JOIN tdir ct_{alias} ON ct_{alias}.token_key = {sql_name_token_key(up)}")
    return j, f"coalesce(cu_{alias}.username, ct_{alias}.tk_username, {up})"


def workload_ctes(as_of: str, window_days: int | None, weight: float = fixed.RESOLVED_WEIGHT) -> str:
    closed = s_closed("state")
    if window_days is None:
        resolved = closed
    else:
        resolved = (f"{closed} AND coalesce(resolved_at >= TIMESTAMP '{as_of}' - INTERVAL {window_days} DAY, false)")
    j, can = canonical_expr("r", "assigned_to")
    return f"""
, rawload AS (
  SELECT assigned_to, count(*) FILTER (WHERE NOT ({closed})) AS open_n,
         count(*) FILTER (WHERE {resolved}) AS resolved_n
  FROM history WHERE assigned_to IS NOT NULL GROUP BY assigned_to
), canonload AS (
  SELECT r.*, {can} AS assignee FROM rawload r {j}
), wload AS (
  SELECT assignee, CAST(sum(open_n) AS BIGINT) AS open, CAST(sum(resolved_n) AS BIGINT) AS resolved,
         sum(open_n) + sum(resolved_n) * {weight} AS effective
  FROM canonload GROUP BY assignee
)"""


def pad_right(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) >= {n} THEN {e} ELSE rpad({e}, {n}, ' ') END"


def pad_left(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) >= {n} THEN {e} ELSE lpad({e}, {n}, ' ') END"
