"""Records over line breaks, found in small splits, against a character loop; the cleaning job file to file."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tixpark.session import scratch_path
from tixpark.sources import csvio, records


def folder(spark, files, encoding="utf-8"):
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}")
    os.makedirs(path)
    for name, text in files.items():
        with open(os.path.join(path, name), "w", encoding=encoding, newline="") as f:
            f.write(text)
    return path


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def by_character(text, replacement=" ", sep=None):
    """Records of a text, one character at a time."""
    out, record, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\r" and text[i + 1:i + 2] == "\n":
            i += 1
        if c == '"':
            quoted = not quoted
        if c in "\r\n":
            if quoted:
                record += replacement
            else:
                out.append(record)
                record = ""
        else:
            record += sep if sep and c == "," and not quoted else c
        i += 1
    return out + [record] if record or quoted else out


def found(df):
    rows = df.select("header", "record", "file", "block", "pos").orderBy("file", "block", "pos").collect()
    return [r["record"] for r in rows], [r["header"] for r in rows]


def test_records_equal_a_character_loop_in_any_split(spark, tiny_splits):
    rnd = random.Random(5)
    for trial in range(6):
        cells = ["".join(rnd.choice(['a', 'ñ', ',', ';', '""', "\n", "\r\n", "\r", " ", ""]) for _ in range(rnd.randint(0, 9))) for _ in range(90)]
        text = "id,text\n" + "".join(f'{i},"{c}"' + rnd.choice(["\n", "\r\n"]) for i, c in enumerate(cells))
        path = folder(spark, {"a.csv": text if trial % 2 else text.rstrip("\r\n")})
        got, header = found(records.logical_records(spark, path))
        assert got == by_character(text)
        assert header == [True] + [False] * (len(got) - 1)


def test_a_record_over_many_splits_and_several_files(spark, tiny_splits):
    long = 'k,"' + "\n".join(f"line {i}" for i in range(200)) + '"\nlast,"x\ny"\n'
    path = folder(spark, {"a.csv": "h,t\n" + long, "b.csv": "h,t\n1,2\n", "c.csv": ""})
    got, header = found(records.logical_records(spark, path, replacement="$1"))
    assert got == by_character("h,t\n" + long, "$1") + ["h,t", "1,2"]
    assert sum(header) == 2


def test_open_quote_ends_with_the_file_or_is_an_error(spark):
    path = folder(spark, {"a.csv": 'h\n"a\nb\nc\n'})
    assert found(records.logical_records(spark, path))[0] == ["h", '"a b c']
    with pytest.raises(Exception, match="open quote"):
        records.logical_records(spark, path, max_lines=2).collect()


def test_job_keeps_records_of_any_width(spark, tiny_splits):
    text = 'number,description,x\n1,"a, ""b""\nc",ñ\n2\n  3 , # ,4,5\n\\,"",\n#5,\'t,z\n'
    for encoding in ("ISO-8859-1", "UTF-8"):
        source, target = folder(spark, {"in.csv": text}, encoding), scratch_path(spark, f"clean-{uuid.uuid4().hex[:8]}")
        records.clean_csv_job(spark, source, target, encoding)
        parts = [open(os.path.join(target, f), encoding=encoding, newline="").read().splitlines() for f in os.listdir(target) if f.endswith(".csv")]
        expected = by_character(text, sep=";")
        assert {p[0] for p in parts if p} == {expected[0]}
        assert sorted(line for p in parts for line in p[1:]) == sorted(expected[1:])
        rows = csvio.scan_tickets(spark, target, encoding=encoding).collect()
        assert ("1", 'a, "b" c', "ñ") in [tuple(r) for r in rows]
    kept = scratch_path(spark, f"clean-{uuid.uuid4().hex[:8]}")
    records.clean_csv_job(spark, source, kept, change_separator=False, replacement="|")
    assert any('1,"a, ""b""|c",ñ' in open(os.path.join(kept, f), encoding="utf-8").read() for f in os.listdir(kept) if f.endswith(".csv"))


def test_job_refuses_mixed_headers_and_other_encodings(spark):
    path = folder(spark, {"a.csv": "a,b\n1,2\n", "b.csv": "a,c\n1,2\n"})
    with pytest.raises(ValueError, match="different headers"):
        records.clean_csv_job(spark, path, scratch_path(spark, "never"))
    with pytest.raises(ValueError, match="UTF-16"):
        records.logical_records(spark, path, "UTF-16")


def test_text_form(spark):
    texts = ['a,"b\r\nc,d",e\nf,g', '"x""\n"",y",z', "", 'open "a\n,b']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    got = [r["c"] for r in df.select("i", records.clean_csv_text(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ['a;"b c,d";e\nf;g', '"x"" "",y";z', "", 'open "a ,b', None]


def test_scan_over_line_breaks_does_not_depend_on_splits(spark):
    rnd = random.Random(9)
    cells = ["".join(rnd.choice(["a", ";", '""', "\n", "\r\n", " ", "ñ"]) for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    text = "n;t;u\n" + "".join(f'{i};"{c}"' + rnd.choice(["\n", ";x\n", ';"y\nz"\n', ";x;\n", ";NA\n", "\n\n"]) for i, c in enumerate(cells))
    path, seen = folder(spark, {"a.csv": text, "b.csv": "n;t;u\n900;b;\n"}, "latin-1"), []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("24", "100", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            seen.append(sorted((tuple(r) for r in csvio.scan_tickets(spark, path, multiline=True).collect()), key=lambda r: int(r[0])))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = []
    for record in by_character(text, "\n")[1:]:
        fields, quoted = [""], False
        for c in record:
            quoted ^= c == '"'
            if c == ";" and not quoted:
                fields.append("")
            else:
                fields[-1] += c
        if record and len(fields) <= 3:
            values = [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in fields] + [None] * (3 - len(fields))
            expected.append(tuple(None if v in csvio.NULL_TOKENS else v for v in values))
    assert seen[0] == seen[1] == seen[2] == expected + [("900", "b", None)]


def test_lines_stay_in_their_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h,t\n" + "".join(f'{i},"one\ntwo ""{i}""\n"\n{i},plain\n' for i in range(50)))
    (tmp_path / "b.csv").write_text("h,t\n1,last")
    df = records.logical_records(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # nothing is dealt out by split: only what goes over two of them is, by file
    assert "MapInArrow" in plan and re.search(r"hashpartitioning\(file#\d+, block#", plan) is None
    got = sorted(r["record"] for r in df.filter("NOT header").collect())
    assert got == sorted([f'{i},"one two ""{i}"" "' for i in range(50)] + [f"{i},plain" for i in range(50)] + ["1,last"])
