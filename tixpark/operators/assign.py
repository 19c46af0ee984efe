"""Shift lookup, routing and load balancing.

B2 replaces the reference's row loop ("give the next ticket to the least
loaded member, +1") by its set form: member m with effective load L offers
slots L, L+1, L+2, ...; ordering all slots of a group by (value, member) and
giving the k-th ticket (arrival order) the k-th slot is exactly the greedy
result.  Only slots up to the group's water level are generated (at most
N + 2 * members per group), so the work is linear in tickets, not
tickets x members.  Shift tickets raise their shift user's load first
(policy stated in the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.dates import shift_band
from ..session import written
from . import dimensions as dim
from . import workload as wl
from .dimensions import pystrip
from .projections import shift_class_flag, shift_rule_flag
from .ranking import two_level_rank


SHIFTS = ("Turno 1", "Turno 2", "Turno 3", "Turno 4", fixed.STANDBY)


def shift_lookup(tickets: DataFrame, ts_col: str, calendar: DataFrame, users_prepared: DataFrame,
                 out: str = "shift_user") -> DataFrame:
    """On-shift user at the ticket's timestamp; empty cell -> the date's Stand-by;
    the name is canonicalised (J5); null when the calendar has no such date."""
    shift, sdate = shift_band(F.col(ts_col))
    cal = calendar.select(F.col("shift_date").alias("_cd"), F.col("shift").alias("_cs"),
                          pystrip(F.col("username")).alias("_cu"))
    cal = cal.groupBy("_cd", "_cs").agg(F.min("_cu").alias("_cu"))   # one row per date and shift; a repeated one: the first by name
    # names are resolved on the calendar (five rows a date), so a ticket joins it once
    every = cal.groupBy("_cd").agg(F.max(F.when(F.col("_cs") == fixed.STANDBY, F.col("_cu"))).alias("_sb"))
    every = every.withColumn("_cs", F.explode(F.array(*[F.lit(s) for s in SHIFTS]))).join(cal, ["_cd", "_cs"], "left")
    user = pystrip(F.when(F.col("_cu").isNull() | (F.col("_cu") == ""), F.col("_sb")).otherwise(F.col("_cu")))
    every = every.withColumn("_su", F.when(user != "", F.upper(user))).select("_cd", "_cs", "_su")
    every = dim.canonical_assignee(every, "_su", users_prepared, out=out).filter(F.col("_su").isNotNull()).select("_cd", "_cs", out)
    t = tickets.withColumn("_shift", shift).withColumn("_sdate", sdate)
    t = t.join(every, (F.col("_sdate") == F.col("_cd")) & (F.col("_shift") == F.col("_cs")), "left")
    return t.drop("_cd", "_cs", "_shift", "_sdate")


def arrival_rank(df: DataFrame, group_col: str, order_cols, out: str = "arrival") -> DataFrame:
    """Order of tickets within their group; the first order column is a timestamp, bucketed by hour."""
    hour = F.coalesce(F.unix_timestamp(F.col(order_cols[0]).cast("timestamp")), F.lit(-(1 << 60))) / 3600
    return two_level_rank(df, [group_col], list(order_cols), F.floor(hour), out)


def balance_fill(tickets: DataFrame, member_loads: DataFrame, group_col: str = "grp",
                 order_cols=("sys_created_on", "number"), out: str = "assigned_to") -> DataFrame:
    """B2: least-loaded assignment of a batch as a set (see module doc).

    ``member_loads``: (grp, member_key, effective) of active candidates.
    ``tickets``: rows to balance with a ``grp`` column.
    """
    t = arrival_rank(tickets, group_col, list(order_cols), "_k")
    n = t.groupBy(group_col).agg(F.count(F.lit(1)).alias("_N"))
    m = member_loads.select(F.col("grp").alias(group_col), "member_key", F.col("effective").alias("_L")).dropDuplicates([group_col, "member_key"])
    m = m.join(n, group_col)
    w = Window.partitionBy(group_col).orderBy("_L", "member_key")
    wn = w.rowsBetween(1, 1)
    m = (m.withColumn("_i", F.row_number().over(w))
          .withColumn("_P", F.sum("_L").over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_next", F.first("_L").over(wn)))
    m = m.withColumn("_lam", (F.col("_N") + F.col("_P")) / F.col("_i"))
    level = (m.filter(F.col("_next").isNull() | (F.col("_lam") <= F.col("_next")))
              .groupBy(group_col).agg(F.min_by("_lam", "_i").alias("_level")))
    m = m.join(level, group_col).filter(F.col("_L") <= F.col("_level"))
    slots = m.select(group_col, "member_key", "_L",
                     F.explode(F.sequence(F.lit(0), F.ceil(F.col("_level") - F.col("_L")).cast("int"))).alias("_j"))
    slots = slots.withColumn("_v", F.col("_L") + F.col("_j"))
    slots = two_level_rank(slots, [group_col], ["_v", "member_key"], F.floor("_v"), "_k")
    slots = slots.select(group_col, "_k", F.col("member_key").alias(out))
    return t.join(slots, [group_col, "_k"], "left").drop("_k")


def route_tickets(tickets: DataFrame, class_col: str, members: DataFrame, users_prepared: DataFrame,
                  history: DataFrame, calendar: DataFrame, as_of: str, ts_col: str = "sys_created_on",
                  window_days: int | None = fixed.RESOLVED_DAYS_WINDOW, out: str = "assigned_to") -> DataFrame:
    """B1 + B2 (+ B4 level 1): route every ticket, balance the rest per group.

    Output adds ``route`` (rule_shift / class_shift / unclassified / no_group /
    no_members / balanced), ``grp``, the final class and ``assigned_to``.
    """
    rule = shift_rule_flag(tickets)
    t = tickets.withColumn("_rule", rule).withColumn("_cls_shift", shift_class_flag(F.col(class_col)))
    t = shift_lookup(t, ts_col, calendar, users_prepared, out="_shift_user")
    t = dim.class_to_group(t, class_col, members, out="grp")
    cand = dim.group_candidates(members, users_prepared).filter("is_active")
    n_cand = cand.groupBy(F.col("grp").alias("_cg")).agg(F.count(F.lit(1)).alias("_nc"))
    t = t.join(n_cand, t["grp"] == n_cand["_cg"], "left").drop("_cg")
    blank = F.col(class_col).isNull() | (pystrip(F.col(class_col)) == "")
    route = (F.when(F.col("_rule"), F.lit("rule_shift"))
              .when(F.col("_cls_shift"), F.lit("class_shift"))
              .when(blank, F.lit("unclassified"))
              .when(F.col("grp").isNull(), F.lit("no_group"))
              .when(F.coalesce(F.col("_nc"), F.lit(0)) == 0, F.lit("no_members"))
              .otherwise(F.lit("balanced")))
    # everything below reads the routed tickets several times: cut the lineage in the shared scratch folder
    t = written(t.withColumn("route", route), "routed")
    t = t.withColumn(class_col, F.when(F.col("_rule"), F.lit(fixed.TURNO_CLASS)).otherwise(F.col(class_col)))
    # loads: history + shift tickets of this batch, then the balanced batch
    load = wl.workload(history, users_prepared, as_of, window_days)
    shift_add = (t.filter(F.col("route").isin("rule_shift", "class_shift") & F.col("_shift_user").isNotNull())
                  .groupBy(F.col("_shift_user").alias("assignee")).agg(F.count(F.lit(1)).alias("_add")))
    load = (load.join(shift_add, "assignee", "full")
                .select("assignee", (F.coalesce("open", F.lit(0)) + F.coalesce("_add", F.lit(0))).alias("open"),
                        F.coalesce("resolved", F.lit(0)).alias("resolved")))
    ml = written(wl.member_workload(cand, load), "member-load")
    bal = balance_fill(t.filter(F.col("route") == "balanced"), ml, "grp", [ts_col, "number"], out="_bal")
    bal = bal.select("number", "_bal")
    t = t.join(bal, "number", "left")
    assigned = (F.when(F.col("route").isin("rule_shift", "class_shift"),
                       F.coalesce(F.col("_shift_user"), F.lit(fixed.TURNO)))
                 .when(F.col("route") == "unclassified", F.lit(fixed.SIN_CLASIFICACION))
                 .when(F.col("route") == "no_group", F.lit(fixed.SIN_GRUPO))
                 .when(F.col("route") == "no_members", F.lit(fixed.SIN_MIEMBROS))
                 .otherwise(F.col("_bal")))
    return t.withColumn(out, assigned).drop("_rule", "_cls_shift", "_shift_user", "_nc", "_bal")


def run_summary(assigned: DataFrame, col: str = "assigned_to", top: int = 5):
    """(rows, distinct assignees) and the top assignees."""
    totals = assigned.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(col).alias("assignees"))
    top_df = (assigned.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
                      .orderBy(F.desc("n"), F.asc(col)).limit(top))
    return totals, top_df
