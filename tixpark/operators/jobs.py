"""The end-to-end jobs: score, route, balance, and write four tables that belong together.

``assignments`` (S9), ``history`` (S10: the export's own columns with assignee
and group overwritten), ``training`` (S11) and ``summary`` (S14) of a run are
one commit of a :class:`CommittedStore`: a run done again replaces all or none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.dates import resolution_date
from ..session import written
from ..sources.committed import CommittedStore
from ..sources.csvio import append_aligned
from . import assign as asg
from . import workload as wl
from .projections import align_output_columns

#: A scorer adds the class column to an export.
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Desk:
    """What a batch is assigned against."""

    members: DataFrame
    users: DataFrame          # prepared (dimensions.prepare_users)
    history: DataFrame
    calendar: DataFrame
    as_of: str
    window_days: int | None = fixed.RESOLVED_DAYS_WINDOW


def summary_lines(assigned: DataFrame, title: str, noun: str, top: int = 5) -> DataFrame:
    """``pos, line`` of the run's summary: rows, distinct assignees, the most frequent ones."""
    totals, best = asg.run_summary(assigned, "predicted_assigned_to", top)
    head = totals.select(F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit(title).alias("line")),
        F.struct(F.lit(2).alias("pos"), F.concat(F.lit(f"{noun} processed: "), F.col("rows").cast("string")).alias("line")),
        F.struct(F.lit(3).alias("pos"), F.concat(F.lit("Unique assignees predicted: "), F.col("assignees").cast("string")).alias("line")),
        F.struct(F.lit(4).alias("pos"), F.lit(f"Top {top} predicted assignees:").alias("line")))).alias("x")).select("x.*")
    order = Window.orderBy(F.desc("n"), "predicted_assigned_to")      # at most ``top`` rows
    listed = best.select((F.row_number().over(order) + 4).alias("pos"),
                         F.concat(wl.pad_right(F.col("predicted_assigned_to"), 50), F.lit(" "), F.col("n").cast("string")).alias("line"))
    return head.unionByName(listed)


def assigned_batch(tickets: DataFrame, desk: Desk, class_col: str, ts_col: str = "sys_created_on") -> DataFrame:
    """Routed and balanced tickets with the predicted_* columns; a written table."""
    routed = asg.route_tickets(tickets.drop("assigned_to"), class_col, desk.members, desk.users, desk.history, desk.calendar, desk.as_of,
                               ts_col=ts_col, window_days=desk.window_days)
    return written(align_output_columns(routed, class_col), "assigned")


def outputs(export: DataFrame, assigned: DataFrame, class_col: str, training_columns: list[str], title: str, noun: str) -> dict[str, DataFrame]:
    """The four tables of a run."""
    over = {"assigned_to": F.col("predicted_assigned_to"), "assignment_group": F.col("predicted_assignment_group")}
    history = assigned.select(*[(over[c].alias(c) if c in over else F.col(f"`{c}`")) for c in
                                dict.fromkeys([*export.columns, "assigned_to", "assignment_group"])])
    training = append_aligned(training_columns, assigned.withColumnRenamed(class_col, "Clasificación"))
    return {"assignments": assigned, "history": history, "training": training, "summary": summary_lines(assigned, title, noun)}


def assign_incidents(export: DataFrame, desk: Desk, store: CommittedStore, run: str, scorer: Scorer | None = None,
                     class_col: str = "Clasificación", training_columns=("number", "short_description", "Categoría"),
                     ts_col: str = "sys_created_on") -> None:
    """One run of the incident export, committed as a whole."""
    scored = scorer(export) if scorer else export
    assigned = assigned_batch(scored, desk, class_col, ts_col)
    store.write(run, outputs(export, assigned, class_col, list(training_columns), f"Incident Assignment Summary - {run}", "Incidents"))


def assign_requirements(export: DataFrame, desk: Desk, store: CommittedStore, run: str, scorer: Scorer | None = None,
                        class_col: str = "Clasificación", training_columns=("number", "short_description", "clasificacion", "fecha_asignacion"),
                        ts_col: str = "opened_at") -> None:
    """As B5 with the requirements' parameters; assignments also carry the resolution date."""
    scored = scorer(export) if scorer else export
    assigned = assigned_batch(scored, desk, class_col, ts_col)
    assigned = assigned.withColumn("fecha_resolucion", resolution_date(F.col(ts_col), F.col("number")))
    store.write(run, outputs(export, assigned, class_col, list(training_columns), f"Requirement Assignment Summary - {run}", "Requirements"))


def with_history(desk: Desk, store: CommittedStore, run: str) -> Desk:
    """The desk as run ``run`` finds it: the given history and what all other committed runs assigned.
    An earlier attempt of the same run does not count, so a retry decides as the first try did."""
    columns = ["assigned_to", "state", "resolved_at"]
    start = desk.history.select(*columns)
    more = store.read("history", like=start, except_run=run)
    for c in columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit(None).cast(start.schema[c].dataType))
    history = start.unionByName(more.select(*[F.col(c).cast(start.schema[c].dataType) for c in columns]))
    return Desk(desk.members, desk.users, history, desk.calendar, desk.as_of, desk.window_days)
