"""Splits, resampling and evaluation from counts.

Metrics are computed from the (true, predicted) count table -- never from
collected rows -- so they cost one aggregation regardless of data size.
Randomness is a SHA-256 of (seed | id), so every split and resample is
reproducible and has an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from .ranking import two_level_rank


def seeded_rank_key(id_col: str, seed: int = fixed.SEED) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256)


def hash_rank(df: DataFrame, label: str, id_col: str, seed: int, out: str, total: str | None = None) -> DataFrame:
    """Rank by seeded hash inside each class; the first hex digits of the hash bucket a large class."""
    h = df.withColumn("_h", seeded_rank_key(id_col, seed))
    return two_level_rank(h, [label], ["_h", id_col], F.substring("_h", 1, 3), out, total).drop("_h")


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     seed: int = fixed.SEED, out: str = "split") -> DataFrame:
    """Per class, the first round(test_size * n_c) rows by seeded hash are test;
    classes with one row go to train."""
    x = hash_rank(df, label, id_col, seed, "_rn", "_n")
    test = (F.col("_n") >= 2) & (F.col("_rn") <= F.round(F.col("_n") * test_size))
    return x.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_rn", "_n")


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = fixed.SEED,
                     out: str = "fold") -> DataFrame:
    """fold = (rank within class - 1) mod k."""
    x = hash_rank(df, label, id_col, seed, "_rn")
    return x.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def label_encode(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """M6: label -> index in sorted label order (``StringIndexer`` alphabetAsc)."""
    labels = df.select(label).distinct()
    idx = labels.withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("double"))
    return df.join(F.broadcast(idx), label, "left")


def oversample_copies(df: DataFrame, label: str, id_col: str, seed: int = fixed.SEED, out: str = "copies") -> DataFrame:
    """M13 as a weight: how often :func:`random_oversample` takes each row (at least once)."""
    target = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")).select(F.max("_nc")).scalar()
    x = hash_rank(df, label, id_col, seed, "_rank", "_nc")
    x = x.withColumn("_q", F.floor(target / F.col("_nc")).cast("int")).withColumn("_r", F.pmod(F.lit(target), F.col("_nc")))
    return x.withColumn(out, F.col("_q") + F.when(F.col("_rank") <= F.col("_r"), 1).otherwise(0)).drop("_nc", "_q", "_r", "_rank")


def random_oversample(df: DataFrame, label: str, id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """Every class up to the majority count: whole copies plus a hash-ranked remainder."""
    x = oversample_copies(df, label, id_col, seed, "_copies")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def class_weights_balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """N / (classes * n_c)."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.select(F.count(F.lit(1))).scalar()
    k = cnt.select(F.count(F.lit(1))).scalar()
    return cnt.withColumn(out, tot / (k * F.col("n_c")))


def confusion_counts(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    return pred.groupBy(F.col(y).alias("y"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """M16 rows: precision, recall, F1, support per label (zero division -> 0)."""
    tp = counts.filter(F.col("y") == F.col("pred")).groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("tp"))
    sup = counts.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    pc = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    labels = sup.select("label").union(pc.select("label")).distinct()
    x = labels.join(tp, "label", "left").join(sup, "label", "left").join(pc, "label", "left").fillna(0)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    x = x.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return x.withColumn("f1", f1)


def classification_report(counts: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` per class, then accuracy, macro and weighted averages."""
    pcs = per_class(counts).select("label", "precision", "recall", "f1", "support", "tp")
    scores = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = pcs.agg(*[F.round(F.avg(c), 6).alias(c) for c in scores], total).select(F.lit("macro avg").alias("label"), *scores, "support")
    weighted = pcs.agg(*[F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in scores], total)
    accuracy = F.round(F.sum("tp") / F.sum("support"), 6)
    overall = pcs.agg(*[accuracy.alias(c) for c in scores], total).select(F.lit("accuracy").alias("label"), *scores, "support")
    return (pcs.drop("tp").withColumns({c: F.round(c, 6) for c in scores}).unionByName(overall).unionByName(macro)
            .unionByName(weighted.select(F.lit("weighted avg").alias("label"), *scores, "support")))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, macro/micro/weighted F1, weighted precision and recall."""
    pcs = per_class(counts)
    return pcs.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        (F.sum("tp") / F.sum("support")).alias("f1_micro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """M17 long form: count and row-normalised share."""
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def error_table(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Misclassified rows with both labels."""
    return pred.filter(~F.col(y).eqNullSafe(F.col(p)))


def confusion_pairs(pred: DataFrame, y: str = "y", p: str = "pred", top: int | None = None) -> DataFrame:
    """Errors per (true, predicted), most frequent first."""
    x = error_table(pred, y, p).groupBy(F.col(y).alias("y"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    x = x.orderBy(F.desc("n"), "y", "pred")
    return x.limit(top) if top else x


def error_rate(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Errors, rate, 1 - rate."""
    err = (~F.col(y).eqNullSafe(F.col(p))).cast("int")
    return pred.agg(F.sum(err).cast("bigint").alias("errors"), F.avg(err).alias("error_rate"),
                    (F.lit(1.0) - F.avg(err)).alias("accuracy"))


def softmax_confidence(scores: Column) -> Column:
    """stable softmax of a score array; returns its maximum."""
    m = F.array_max(scores)
    ex = F.transform(scores, lambda s: F.exp(s - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.array_max(F.transform(ex, lambda v: v / tot))


def confidence_summary(df: DataFrame, conf: str, threshold: float, bins: int = 20) -> DataFrame:
    """Low-confidence count and share, and a histogram over [0, 1]."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    low = df.select(F.count_if(F.col(conf) < threshold)).scalar()
    share = df.select(F.avg((F.col(conf) < threshold).cast("double"))).scalar()
    return (df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("low", low).withColumn("low_share", share))


def label_union_distinct(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """U4: sorted distinct labels of truth and prediction."""
    return pred.select(F.col(y).alias("label")).union(pred.select(F.col(p).alias("label"))).distinct().orderBy("label")


def arg_best(scores: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """O3: best by score, first (lowest ``order``) on ties."""
    return scores.agg(F.max_by(F.col(name), F.struct(F.col(score), -F.col(order))).alias("best"))


def cluster_diagnostics(df: DataFrame, cluster: str) -> DataFrame:
    """Size of each cluster, with the number of clusters (noise, -1, apart) and of noise rows."""
    sizes = df.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()          # one row per cluster
    return sizes.withColumn("clusters", F.sum((F.col("cluster_id") >= 0).cast("bigint")).over(every)) \
        .withColumn("noise", F.sum(F.when(F.col("cluster_id") == -1, F.col("n")).otherwise(F.lit(0))).over(every))
