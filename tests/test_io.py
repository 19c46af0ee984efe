"""CSV width rule and the file stream."""

import os
import uuid

from tixpark.session import scratch_path
from tixpark.sources import csvio
from tixpark.streaming import stream


def test_scan_width_rule(spark):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w", encoding="latin-1", newline="") as f:
        f.write('a;b;c\r\n1;2;3\r\n4;5\r\n6;7;8;9\r\n"x\r\ny";"q""z";NA\r\n1;2;3;\r\n')
    rows = [tuple(r) for r in csvio.repair_quoted_newlines(csvio.scan_tickets(spark, path, multiline=True)).collect()]
    assert sorted(rows, key=str) == sorted([("1", "2", "3"), ("4", "5", None), ("x y", 'q"z', None)], key=str)


def test_stream_available_now(spark):
    df = spark.createDataFrame([(f"N{i}", "c") for i in range(20)], "number string, category string")
    src = scratch_path(spark, f"in-{uuid.uuid4().hex[:8]}")
    out = scratch_path(spark, f"out-{uuid.uuid4().hex[:8]}")
    ck = scratch_path(spark, f"ck-{uuid.uuid4().hex[:8]}")
    stream.drop_files(df, src, 3)
    stream.run_available(spark, src, df.schema, out, ck)
    assert spark.read.parquet(out).count() == 20
    stream.run_available(spark, src, df.schema, out, ck)     # same files are not read twice
    assert spark.read.parquet(out).count() == 20


def _file(spark, data, encoding):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w", encoding=encoding, newline="") as f:
        f.write(data)
    return path


def test_headers_encodings_and_null_markers(spark):
    data = "número;Categoría;c\n1;Operación;#NA\n2;x;<NA>\n3;-nan;ok\n"
    want = [("1", "Operación", None), ("2", "x", None), ("3", None, "ok")]
    for encoding in ("latin-1", "utf-8", "utf-8-sig"):
        df = csvio.scan_tickets(spark, _file(spark, data, encoding), encoding=None)
        assert df.columns == ["número", "Categoría", "c"] and sorted(map(tuple, df.collect())) == want
    assert csvio.scan_tickets(spark, _file(spark, data, "latin-1")).columns == ["número", "Categoría", "c"]


def test_fallback_separator(spark):
    path = _file(spark, 'a,"b,b",c\n1,"2,2",3\n4,5,6,\n', "latin-1")
    assert csvio.sniff_delimiter(spark, path) == (",", ["a", "b,b", "c"])
    assert [tuple(r) for r in csvio.scan_tickets(spark, path).collect()] == [("1", "2,2", "3")]


def test_history_runs_are_retry_safe(spark):
    path = scratch_path(spark, f"runs-{uuid.uuid4().hex[:8]}")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "number string, n int")
    csvio.append_history(one, path, ["number"], "2024-01-01_08-00-00")
    for _ in range(2):  # the second run is tried twice
        csvio.append_history(one.filter("n = 2"), path, ["number"], "2024-01-01_09-00-00")
    runs = spark.read.parquet(path)
    assert runs.count() == 3 and [r.number for r in csvio.latest_run(runs).collect()] == ["b"]


def test_latest_version_by_number_by_time_and_since(spark):
    path = scratch_path(spark, f"versions-{uuid.uuid4().hex[:8]}")
    os.makedirs(os.path.join(path, "set_V3.csv"))
    for i, name in enumerate(["a_v2.csv", "b_v10.csv", "set_V3.csv/part-0.csv", "plain.csv", "c_v99.txt"]):
        with open(os.path.join(path, name), "w") as f:
            f.write("x\n")
        os.utime(os.path.join(path, name), (1_700_000_000 + i * 60,) * 2)

    def newest(**how):
        return [(os.path.basename(r["path"]), r["version"]) for r in csvio.latest_version(spark, path, **how).collect()]

    assert newest() == [("b_v10.csv", 10)]
    assert newest(by_version=False) == [("plain.csv", 0)]
    assert newest(since="2023-11-14 22:15:00") == [("set_V3.csv", 3)]      # the third file is from 22:15:20
    assert newest(since="2030-01-01 00:00:00") == []
