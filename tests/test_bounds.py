"""What a task holds or reads is bounded, whatever the table's size."""

import glob
import random

from tixpark.operators import neighbours as nn
from tixpark.streaming import stream


def test_scores_of_a_task_are_bounded(spark, monkeypatch):
    r = random.Random(1)
    df = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)], i % 3, i % 5) for i in range(60)], "id long, v array<double>, l int, g int")
    model = nn.fit_rows(df, "id", "v", "l", "g")
    whole = nn.nearest(df.coalesce(1), model, "id", "v", "g", k=4).orderBy("id", "rank").collect()
    monkeypatch.setattr(nn, "CELLS", 120)
    blocks = nn.nearest(df.coalesce(1), model, "id", "v", "g", k=4).orderBy("id", "rank").collect()
    assert blocks == whole and len(whole) == 240
    assert nn.MAX_FIT * 8 * max(1, (1 << 21) // nn.MAX_FIT) <= 1 << 24      # 16 MB of scores at most


def test_dropped_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "FILE_ROWS", 10)
    df = spark.createDataFrame([(i, f"a\n{i}") for i in range(95)], "id long, t string")
    stream.drop_files(df, str(tmp_path / "in"), parts=4)
    assert len(glob.glob(str(tmp_path / "in" / "*.csv"))) == 10
    back = stream.run_available(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "ck"), multiline=True)
    assert back is not None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "t").collect())) == sorted(map(tuple, df.collect()))
