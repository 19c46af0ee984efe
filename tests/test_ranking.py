"""Two-level ranks equal one window; neighbours equal plain numpy."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tixpark.operators import neighbours as nn
from tixpark.operators.ranking import two_level_rank


def test_two_level_rank_equals_row_number(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = two_level_rank(df, ["g"], ["v", "id"], F.floor(F.col("v") / 7), "r", "n")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert sorted(map(str, got.select("id", "g", "r", "n").collect())) == sorted(map(str, want.select("id", "g", "r", "n").collect()))
    whole = two_level_rank(df, [], ["v", "id"], F.floor(F.col("v") / 7), "r")
    assert [r.id for r in whole.orderBy("r").collect()] == [r.id for r in df.orderBy("v", "id").collect()]
    assert two_level_rank(df.limit(0), ["g"], ["v"], F.col("v"), "r").count() == 0


def test_neighbours_and_votes(spark):
    rng = np.random.default_rng(0)
    v, labels = rng.normal(size=(60, 4)).round(3), [int(i % 3) for i in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], labels[i]) for i in range(60)], "id long, v array<double>, l int")
    model = nn.fit_rows(df.filter("id >= 20"), "id", "v", "l")
    near = nn.nearest(df.filter("id < 20"), model, "id", "v", k=5)
    got = {(r.id, r["rank"]): r.label for r in near.collect()}
    votes = {r.id: r.pred for r in nn.vote(near, 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(20):
        order = np.argsort(-np.round(u[20:] @ u[q], 9), kind="stable")[:5] + 20
        near_labels = [labels[j] for j in order]
        assert [got[q, k] for k in range(1, 6)] == near_labels
        assert votes[q] == min(set(near_labels), key=lambda x: (-near_labels.count(x), x))
    assert len(nn.fit_rows(df, "id", "v", "l", max_fit=7)["ids"]) == 7
