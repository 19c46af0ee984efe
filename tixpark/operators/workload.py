"""Workload from the assigned history and the per-group report.

History is the large fact table.  It is reduced map-side to one row per
distinct raw assignee spelling (partial aggregation in the scan stage), so a
single assignee holding a third of all rows costs one row per task, and only
those distinct names are canonicalised against the user directory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import parse_resolved_dayfirst
from ..session import written
from .dimensions import (active_filter, canonical_assignee, display_name, pystrip)


def union_histories(*histories: DataFrame) -> DataFrame:
    """Incident and requirement histories, aligned by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)


def is_closed(state: Column, closed=fixed.CLOSED_STATES) -> Column:
    """Title-cased stripped state in the closed list; null is *not* closed."""
    return F.coalesce(F.initcap(pystrip(state)).isin(list(closed)), F.lit(False))


def _cutoff(as_of: str, days: int) -> Column:
    return F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))


def raw_load_counts(history: DataFrame, as_of: str, window_days: int | None = fixed.RESOLVED_DAYS_WINDOW,
                    closed=fixed.CLOSED_STATES) -> DataFrame:
    """Per raw assignee spelling: open rows and resolved rows inside the window."""
    h = history.filter(F.col("assigned_to").isNotNull())
    closed_c = is_closed(F.col("state"), closed)
    resolved = closed_c
    if window_days is not None and "resolved_at" in history.columns:
        ts = parse_resolved_dayfirst(F.col("resolved_at"))
        resolved = resolved & F.coalesce(ts >= _cutoff(as_of, window_days), F.lit(False))
    return h.groupBy("assigned_to").agg(
        F.count_if(~closed_c).alias("open_n"),
        F.count_if(resolved).alias("resolved_n"))


def workload(history: DataFrame, users_prepared: DataFrame, as_of: str,
             window_days: int | None = fixed.RESOLVED_DAYS_WINDOW,
             weight: float = fixed.RESOLVED_WEIGHT) -> DataFrame:
    """A13 + A14 + A15: (assignee, open, resolved, effective) by canonical name."""
    raw = written(raw_load_counts(history, as_of, window_days), "load-counts")      # read twice: the history is counted once
    can = canonical_assignee(raw, "assigned_to", users_prepared, out="assignee")
    agg = can.groupBy("assignee").agg(F.sum("open_n").cast("bigint").alias("open"),
                                     F.sum("resolved_n").cast("bigint").alias("resolved"))
    return agg.withColumn("effective", F.col("open") + F.col("resolved") * F.lit(weight))


def member_workload(candidates: DataFrame, load: DataFrame, weight: float = fixed.RESOLVED_WEIGHT) -> DataFrame:
    """Members start at 0: left join of the candidates to the load table."""
    l = load.select(F.col("assignee").alias("_la"), "open", "resolved")
    j = candidates.join(l, candidates["member_key"] == l["_la"], "left").drop("_la")
    j = j.fillna(0, subset=["open", "resolved"])
    return j.withColumn("effective", F.col("open") + F.col("resolved") * F.lit(weight))


def group_mean_threshold(member_loads: DataFrame, margin: float = fixed.OVERLOAD_MARGIN) -> DataFrame:
    """Mean effective load of the distinct active candidates per group, plus margin."""
    act = member_loads.filter("is_active").dropDuplicates(["grp", "member"])
    return act.groupBy("grp").agg(F.avg("effective").alias("group_mean"),
                                  (F.avg("effective") + F.lit(margin)).alias("threshold"),
                                  F.count(F.lit(1)).alias("n_active"))


def pad_right(c: Column, n: int) -> Column:
    """Python ``ljust``: pad, never truncate."""
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def pad_left(c: Column, n: int) -> Column:
    """Python ``rjust`` / ``{:>n}``: pad, never truncate."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " "))


def group_workload_report(members: DataFrame, users_prepared: DataFrame, history: DataFrame,
                          as_of: str, window_days: int | None = fixed.RESOLVED_DAYS_WINDOW) -> DataFrame:
    """Per group, the distinct members with open tickets, display name and
    active flag, sorted by tickets desc then name; one total line per group
    (users, tickets) through GROUPING SETS ((grp, member), (grp))."""
    m = members.select("grp", "member").dropDuplicates(["grp", "member"])
    m = canonical_assignee(m, "member", users_prepared, out="member_key")
    m = active_filter(m, "member_key", users_prepared)
    m = display_name(m, "member_key", users_prepared)
    load = workload(history, users_prepared, as_of, window_days).select(F.col("assignee").alias("_wa"), "open")
    m = m.join(load, m["member_key"] == load["_wa"], "left").drop("_wa")
    m = m.withColumn("tickets", F.coalesce("open", F.lit(0)).cast("bigint"))
    rep = m.groupingSets([["grp", "member"], ["grp"]], "grp", "member").agg(
        F.first("display_name").alias("display_name"),
        F.first("is_active").alias("is_active"),
        F.sum("tickets").cast("bigint").alias("tickets"),
        F.count(F.lit(1)).alias("users"),
        F.grouping("member").alias("is_total"))
    line = F.when(F.col("is_total") == 1,
                  F.concat(F.lit("Total Users in Group: "), F.col("users").cast("string"),
                           F.lit(" | Total Tickets in Group: "), F.col("tickets").cast("string")))\
            .otherwise(F.concat(pad_right(F.col("display_name"), 50), F.lit(" "),
                                pad_left(F.col("tickets").cast("string"), 3), F.lit(" tickets"),
                                F.when(F.col("is_active"), F.lit("")).otherwise(F.lit(" " + fixed.INACTIVE_TAG))))
    tot = F.col("is_total") == 1
    rep = (rep.withColumn("display_name", F.when(tot, F.lit(None)).otherwise(F.col("display_name")))
              .withColumn("is_active", F.when(tot, F.lit(None)).otherwise(F.col("is_active"))))
    return (rep.withColumn("line", line)
               .select("grp", "member", "display_name", "is_active", "tickets", "users",
                       F.col("is_total").cast("int").alias("is_total"), "line")
               .orderBy("grp", "is_total", F.desc("tickets"), "member"))


def workload_listing(members: DataFrame, users_prepared: DataFrame, history: DataFrame, as_of: str,
                     window_days: int | None = fixed.RESOLVED_DAYS_WINDOW) -> DataFrame:
    """Every assignee with load (members at 0 included), display name, inactive tag."""
    load = workload(history, users_prepared, as_of, window_days)
    mem = canonical_assignee(members.select("member").distinct(), "member", users_prepared, out="assignee")
    mem = mem.select("assignee").distinct()
    allk = load.select("assignee").unionByName(mem).distinct()
    x = allk.join(load, "assignee", "left").fillna(0, subset=["open", "resolved"])
    x = x.withColumn("effective", F.col("open") + F.col("resolved") * F.lit(fixed.RESOLVED_WEIGHT))
    x = active_filter(x, "assignee", users_prepared)
    x = display_name(x, "assignee", users_prepared)
    return (x.withColumn("line", F.concat(pad_right(F.col("display_name"), 50), F.lit(" "),
                                          pad_left(F.col("open").cast("string"), 3), F.lit(" tickets"),
                                          F.when(F.col("is_active"), F.lit("")).otherwise(F.lit(" " + fixed.INACTIVE_TAG))))
             .orderBy(F.desc("open"), "display_name"))
