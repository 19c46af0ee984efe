"""Assignments as rows that update the ticket system (J14): what is to be set on each record, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import format_due_date
from ..functions.text import strip, to_column
from .dimensions import assignee_sys_id
from .projections import col_or, first_available_column, record_url, require_columns


def update_records(assignments: DataFrame, users: DataFrame, base_url: str, as_of: str, requirement: bool, item_id: Column | str = "",
                   assignee: str = "assigned_to", due: str = "fecha_resolucion", short_date: str = "dd/MM/yyyy") -> DataFrame:
    """``record_table, number, assigned_to, assigned_to_id, due_date, application, application_id, state, url`` of every
    ticket with a number and an assignee (null, blank and ``nan`` are none); a repeated ticket gives a row each time.

    The id is the users' external id (J10), else ''.  Requirements get a due date (F24; without one, ``as_of`` and thirty
    days), the application and its id, and the state; for incidents these are null.  The first of the columns
    ``number``, ``Number``, ``id`` that exists is the ticket's number; without one, or without the assignee, it is an error.
    """
    number = first_available_column(assignments, fixed.NUMBER_COLUMNS)
    require_columns(assignments, [number or fixed.NUMBER_COLUMNS[0], assignee])
    x = assignments.select(F.col(f"`{number}`").cast("string").alias("number"), to_column(F.col(f"`{assignee}`"), [strip()]).alias("assigned_to"),
                           col_or(assignments, due).cast("string").alias("_due"))
    x = x.filter(F.col("number").isNotNull() & (F.col("assigned_to") != "") & (F.lower("assigned_to") != "nan"))
    x = assignee_sys_id(x, "assigned_to", users, out="assigned_to_id")
    table = fixed.REQUIREMENT_TABLE if requirement else fixed.INCIDENT_TABLE

    def only_requirement(c: Column) -> Column:
        return c if requirement else F.lit(None).cast("string")

    return x.select(F.lit(table).alias("record_table"), "number", "assigned_to", "assigned_to_id",
                    only_requirement(format_due_date(F.col("_due"), as_of, short_date)).alias("due_date"),
                    only_requirement(F.lit(fixed.APPLICATION)).alias("application"),
                    only_requirement(F.lit(item_id) if isinstance(item_id, str) else item_id).alias("application_id"),
                    only_requirement(F.lit(fixed.UPDATED_STATE)).alias("state"),
                    record_url(F.lit(base_url), table, F.col("number")).alias("url"))
