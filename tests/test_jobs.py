"""Committed runs, the assignment jobs end to end, and the stream after a failure between its sinks."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tixpark.functions import fixed
from tixpark.operators import dimensions as dim
from tixpark.operators import jobs
from tixpark.operators import workload as wl
from tixpark.session import scratch_path
from tixpark.sources import committed
from tixpark.sources.committed import CommittedStore
from tixpark.streaming import stream

EXPORT = "number string, short_description string, category string, contact_type string, u_subcategory string, sys_created_on timestamp_ntz, assigned_to string, state string"


def folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def export(spark, numbers, first_hour=8):
    rows = [(n, "cheque rechazado" if i % 2 else "cuenta nueva", "Aplicaciones", "Portal", "x", dt.datetime(2024, 1, 3, first_hour, i), "zz", "Nuevo")
            for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, EXPORT)


@pytest.fixture(scope="module")
def desk(spark):
    users = spark.createDataFrame([(i, f"U{i}", f"Ana {c}", "1", None) for i, c in enumerate("ABCDE")],
                                  "ord long, usuario string, nombre string, estado string, sys_id string")
    members = spark.createDataFrame([("CHEQUE", 0, "U0", 1), ("CHEQUE", 0, "U1", 1), ("CUENTAS", 1, "U2", 1), ("CUENTAS", 1, "U3", 1)],
                                    "grp string, grp_order int, member string, level int")
    history = spark.createDataFrame([("U0", "En curso", None), ("U0", "En curso", None), ("U3", "Cerrado", None)],
                                    "assigned_to string, state string, resolved_at timestamp_ntz")
    calendar = spark.createDataFrame([(dt.date(2024, 1, 3), "Turno 1", "U4")], "shift_date date, shift string, username string")
    return jobs.Desk(members, dim.prepare_users(users), history, calendar, "2024-01-03 00:00:00", 7)


def scorer(df):
    return df.withColumn("Clasificación", F.when(F.col("short_description").startswith("cheque"), "cheques").otherwise("cuentas"))


def test_half_written_runs_are_not_seen_and_reruns_replace(spark, monkeypatch):
    store = CommittedStore(spark, folder(spark, "store"))
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    assert store.read("x", like=one).count() == 0
    store.write("2024-01-01", {"x": one, "y": one})
    write, calls = committed.write_table, []

    def fails(df, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk")
        write(df, path)

    monkeypatch.setattr(committed, "write_table", fails)
    two = spark.createDataFrame([("b", 2)], "k string, v int")
    with pytest.raises(OSError):
        store.write("2024-01-01", {"x": two, "y": two})
    with pytest.raises(OSError):
        calls.clear()
        store.write("2024-01-02", {"x": two, "y": two})
    monkeypatch.setattr(committed, "write_table", write)
    assert [tuple(r) for r in store.read("x").select("run", "k").collect()] == [("2024-01-01", "a")]
    store.write("2024-01-01", {"x": two, "y": two})
    for name in ("x", "y"):
        assert [tuple(r) for r in store.read(name).select("run", "k", "v").collect()] == [("2024-01-01", "b", 2)]


def test_incident_job_overwrites_and_balances(spark, desk):
    store = CommittedStore(spark, folder(spark, "job"))
    batch = export(spark, [f"N{i}" for i in range(8)])
    for _ in range(2):      # a rerun replaces the first run
        jobs.assign_incidents(batch, jobs.with_history(desk, store, "r1"), store, "r1", scorer, training_columns=("number", "Categoría"))
    got = {r.number: (r.assigned_to, r.assignment_group) for r in store.read("history").collect()}
    assert len(got) == 8 and store.read("history").count() == 8
    # cheques: U0 starts with two open tickets, so U1 gets the first three of four
    cheques = sorted(v[0] for n, v in got.items() if v[1] == "cheques")
    cuentas = sorted(v[0] for n, v in got.items() if v[1] == "cuentas")
    assert cheques == ["U0", "U1", "U1", "U1"] and cuentas == ["U2", "U2", "U3", "U3"]
    assert {r["Categoría"] for r in store.read("training").collect()} == {"cheques", "cuentas"}
    lines = [r.line for r in store.read("summary").orderBy("pos").collect()]
    assert lines[1:4] == ["Incidents processed: 8", "Unique assignees predicted: 4", "Top 5 predicted assignees:"] and len(lines) == 8


def test_requirement_job_has_due_dates(spark, desk):
    store = CommittedStore(spark, folder(spark, "req"))
    batch = export(spark, ["R1", "R2"]).withColumnRenamed("sys_created_on", "opened_at")
    jobs.assign_requirements(batch, desk, store, "r1", scorer, training_columns=("number", "clasificacion", "fecha_asignacion"))
    rows = store.read("assignments").collect()
    assert all(r.fecha_resolucion and r.predicted_assigned_to for r in rows) and len(rows) == 2
    assert all(r.fecha_asignacion.startswith("2024-01-03") for r in store.read("training").collect())


def test_stream_retries_a_batch_that_failed_between_its_sinks(spark, desk, monkeypatch):
    """T5: the restarted stream loses and doubles nothing, and decides as an undisturbed one."""
    def run(store, checkpoint, inbox):
        stream.stream_assign(spark, inbox, EXPORT, desk, store, checkpoint, scorer=scorer, training_columns=("number",))

    def result(store):
        return sorted(tuple(r) for r in store.read("history").select("run", "number", "assigned_to").collect())

    drops = [export(spark, [f"{p}{i}" for i in range(6)], 8 + k) for k, p in enumerate("AB")]
    calm = (CommittedStore(spark, folder(spark, "calm")), folder(spark, "calm-ck"), folder(spark, "calm-in"))
    for d in drops:
        stream.drop_files(d, calm[2], parts=1)
        run(*calm)
    store, checkpoint, inbox = CommittedStore(spark, folder(spark, "shaky")), folder(spark, "shaky-ck"), folder(spark, "shaky-in")
    stream.drop_files(drops[0], inbox, parts=1)
    run(store, checkpoint, inbox)
    write, calls = committed.write_table, []

    def fails(df, path):
        calls.append(path)
        if "/training/" in path:
            raise OSError("between the sinks")
        write(df, path)

    monkeypatch.setattr(committed, "write_table", fails)
    stream.drop_files(drops[1], inbox, parts=1)
    with pytest.raises(Exception):
        run(store, checkpoint, inbox)
    assert any("/history/" in c for c in calls)
    assert store.read("history").count() == 6      # the failed batch left nothing to see
    monkeypatch.setattr(committed, "write_table", write)
    run(store, checkpoint, inbox)
    assert result(store) == result(calm[0]) and len(result(store)) == 12


def test_running_counters_survive_a_restart(spark):
    inbox, out, checkpoint = folder(spark, "c-in"), folder(spark, "c-out"), folder(spark, "c-ck")
    schema = "n int, assigned_to string"
    for k in range(3):
        stream.drop_files(spark.createDataFrame([(i, f"u{i % (k + 1)}") for i in range(5)], schema), inbox, parts=1)
        stream.stream_workload(spark, inbox, schema, out, checkpoint)
    got = {r.assigned_to: r.n for r in stream.current_counts(spark.read.parquet(out)).collect()}
    assert got == {"u0": 5 + 3 + 2, "u1": 2 + 2, "u2": 1}


def test_history_is_counted_once(spark):
    """The loads are read twice, the history is not."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(x):
        seen.add(1)
        return x

    users = dim.prepare_users(spark.createDataFrame([("u1", "Ana Paz", "1", 1)], "usuario string, nombre string, estado string, ord int"))
    history = spark.createDataFrame([("u1", "Nuevo"), ("PAZ ana", "Nuevo"), ("u1", "Cerrado")], "assigned_to string, state string")
    history = history.withColumn("assigned_to", name.asNondeterministic()("assigned_to"))
    assert [(r.assignee, r.open, r.resolved) for r in wl.workload(history, users, "2024-01-01", None).collect()] == [("U1", 2, 1)]
    assert seen.value == 3


def test_requirement_texts_are_chosen_once(spark, monkeypatch):
    """The reviewed classes are a written table: the job that reads them twice runs no text step again."""
    from tixpark.plans import q_jobs

    got = {}
    rows = [("A", "una descripcion bastante larga de prueba", "corto"), ("B", "", None)]
    monkeypatch.setattr(q_jobs.b, "tickets", lambda spark, sf: spark.createDataFrame(rows, "number string, description string, short_description string"))
    monkeypatch.setattr(q_jobs, "_export", lambda spark, sf: spark.createDataFrame([("A", "x"), ("B", "x")], "number string, `Clasificación` string"))
    monkeypatch.setattr(q_jobs, "_desk", lambda spark, sf: None)
    monkeypatch.setattr(q_jobs.jobs, "assign_requirements", lambda export, desk, store, run, review, **more: got.update(x=review(export)))
    q_jobs._assign_requirements(spark, "", None)
    assert "EvalPython" not in got["x"]._jdf.queryExecution().executedPlan().toString()
    assert {r["number"]: r["Clasificación"] for r in got["x"].collect()} == {"A": "x", "B": fixed.REVIEW_CLASS}
