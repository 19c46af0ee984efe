"""Update rows of assigned tickets."""

import pytest
from pyspark.sql import functions as F

from tixpark.operators.updates import update_records

URL, NOW = "https://desk.example", "2024-01-03 10:00:00"


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(0, "u0", "Ana Paz", "sid0"), (1, "u1", "Luz Rey", " "), (2, "u2", "Ana Paz", "sid2"), (3, "u3", None, "sid3")],
                                 "ord long, usuario string, nombre string, sys_id string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_requirements(spark, users):
    a = spark.createDataFrame([("R1", " ana paz ", "2024-02-01"), ("R2", "U3", "01/03/2024 07:05:09"), ("R3", "Luz Rey", " pronto "), ("R4", "Otra", None),
                               ("R5", "nan", None), ("R6", " ", None), ("R7", None, None), (None, "u0", None), ("R2", "U3", " ")],
                              "number string, assigned_to string, fecha_resolucion string")
    u = update_records(a, users, URL + "/", NOW, True, F.lit("item"))
    assert rows(u, "number", "assigned_to", "assigned_to_id", "due_date") == [
        ("R1", "ana paz", "sid2", "01/02/2024 00:00:00"), ("R2", "U3", "sid3", "01/03/2024 07:05:09"), ("R2", "U3", "sid3", "02/02/2024 10:00:00"),
        ("R3", "Luz Rey", "", "pronto"), ("R4", "Otra", "", "02/02/2024 10:00:00")]
    assert rows(u.filter("number = 'R1'"), "record_table", "application", "application_id", "state", "url") == [
        ("sc_req_item", "Bancs", "item", "2", "https://desk.example/sc_req_item.do?sysparm_query=number=R1")]


def test_incidents_have_no_due_date_and_any_number_column(spark, users):
    a = spark.createDataFrame([("I1", "u0")], "id string, assigned_to string")
    assert [tuple(r) for r in update_records(a, users, URL, NOW, False, "item").collect()] == [
        ("incident", "I1", "u0", "sid0", None, None, None, None, "https://desk.example/incident.do?sysparm_query=number=I1")]
    assert update_records(a.limit(0), users, URL, NOW, True).collect() == []


def test_missing_columns_are_an_error(spark, users):
    for bad in (spark.createDataFrame([("u0",)], "assigned_to string"), spark.createDataFrame([("I1",)], "number string")):
        with pytest.raises(ValueError, match="missing required"):
            update_records(bad, users, URL, NOW, False)
