"""Registered queries: training, comparison, relabelling, neighbours and the model store.

Predictions depend on optimiser details.  The oracles hold what is exact: which
rows are scored, that predictions are known labels, that confidences are in
[0, 1] and that the review flag follows from them.  Neighbours are exact.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chain as ch
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import labels as lb
from ..operators import models as md
from ..operators import neighbours as nn
from ..session import scratch_path, written
from ..sources import bindings as b
from .catalog import register
from .q_features import _CLEAN_DOCS_SQL, _vocabulary_5000, clean_docs


def _prepared(spark, sf):
    """(vectors of every ticket, labelled rows with their part): repaired, one row per text, split.

    Both are checkpointed: every model reads the same frame."""
    return _prepared_over(spark, sf)[:2]


def _prepared_over(spark, sf):
    """As :func:`_prepared`, and the vocabulary that the vectors are over."""
    symbols, vocab, c = _vocabulary_5000(spark, sf)
    x = fe.vectors(symbols, vocab)
    vectors = written(c.select("number", "clase").join(x.select(F.col("doc").alias("number"), "features"), "number"), "vectors")
    lab = lb.repair_ambiguous(c.filter(F.col("clase") != fixed.UNCLASSIFIED), "ctext", "clase", "ord")
    lab = lb.dedup_keep_first(lab.select("number", "ord", "clase", "ctext"), "ctext", "ord")
    parts = ev.stratified_split(lab, "clase", "number", 0.2, 42, "part").select("number", "clase", "part")
    rows = written(ev.label_encode(parts.join(vectors.select("number", "features"), "number"), "clase"), "labelled")
    return vectors, rows, vocab


def _fitted(rows, which: str):
    """The model on the training part (oversampled; the SVM takes class weights instead) and its label texts."""
    labels = [r[0] for r in rows.select("clase").distinct().orderBy("clase").collect()]     # the label domain
    train = rows.filter("part = 'train'")
    if which == "svm":
        train = written(train.join(ev.class_weights_balanced(train, "clase").select("clase", "weight"), "clase"), "weighted")
        return md.svm_ovr_balanced(train.count(), max_iter=200).fit(md.packed(train)), labels
    if which == "lr":
        return md.fit_oversampled_lr(train, "clase", "number"), labels
    return md.random_forest().fit(written(ev.random_oversample(train, "clase", "number", 42), "oversampled")), labels


def _held_out(spark, sf, which: str):
    _, rows = _prepared(spark, sf)
    model, labels = _fitted(rows, which)
    threshold = fixed.SOFTMAX_REVIEW_THRESHOLD if which == "svm" else fixed.PROBA_REVIEW_THRESHOLD
    p = md.predict_with_confidence(model, rows.filter("part = 'test'"), labels, threshold, which)
    ok = F.col("pred").isin(labels) & F.col("Confianza").between(0, 1)
    flag = F.col("Requiere_revision") == (F.col("Confianza") < threshold)
    return p.select("number", F.col("clase").alias("y"), ok.alias("valid"), flag.alias("flag_follows"))


_TRAIN_SQL = _CLEAN_DOCS_SQL + """
, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctext ORDER BY ord) AS r FROM lab) WHERE r = 1)
, parted AS (SELECT *, row_number() OVER (PARTITION BY clase ORDER BY sha256('42|' || number), number) AS rn, count(*) OVER (PARTITION BY clase) AS nc FROM once)
"""
_HELD_SQL = _TRAIN_SQL + "SELECT number, clase AS y, true AS valid, true AS flag_follows FROM parted WHERE nc >= 2 AND rn <= round(nc * 0.2)"


@register("logistic_regression", _HELD_SQL)
def q_logistic_regression(spark, sf):
    return _held_out(spark, sf, "lr")


@register("random_forest", _HELD_SQL)
def q_random_forest(spark, sf):
    return _held_out(spark, sf, "rf")


@register("svm_ovr_balanced", _HELD_SQL)
def q_svm_ovr(spark, sf):
    return _held_out(spark, sf, "svm")


def best_k(rows, seed: int = fixed.SEED, folds: int = 5, max_k: int = nn.MAX_K) -> int:
    """M12 on tickets: the k of best mean weighted F1 over the folds of the training rows, from one neighbour pass."""
    train = written(ev.stratified_kfold(rows, "clase", "number", folds, seed, "g").select("number", "clase", "features", "g"), "knn-folds")
    near = nn.nearest_sparse(train, nn.fit_index(train, "number", "features", "clase", group="g"), "number", "features", group="g", k=max_k)
    votes = nn.vote_all(near, max_k).join(train.select(F.col("number").alias("id"), F.col("clase").alias("y"), "g"), "id")
    counts = written(votes.groupBy("k", "g", "y", "pred").agg(F.count(F.lit(1)).alias("n")), "knn-votes")
    tp = counts.filter("y = pred").groupBy("k", "g", F.col("y").alias("l")).agg(F.sum("n").alias("tp"))
    sup = counts.groupBy("k", "g", F.col("y").alias("l")).agg(F.sum("n").alias("sup"))
    pr = counts.groupBy("k", "g", F.col("pred").alias("l")).agg(F.sum("n").alias("pr"))
    f = sup.join(tp, ["k", "g", "l"], "left").join(pr, ["k", "g", "l"], "left").fillna(0)
    f1 = F.col("sup") * 2.0 * F.col("tp") / (F.col("sup") + F.col("pr"))
    mean = f.groupBy("k", "g").agg((F.sum(f1) / F.sum("sup")).alias("f")).groupBy("k").agg(F.round(F.avg("f"), 9).alias("f"))
    best = mean.orderBy(F.desc("f"), "k").first()
    return int(best["k"]) if best else 1


def knn_predict(rows, k: int, train):
    """M11 on sparse ticket vectors: prediction, share of the votes as confidence, review flag."""
    near = nn.nearest_sparse(rows, nn.fit_index(train, "number", "features", "clase"), "number", "features", k=k)
    p = rows.join(nn.vote_share(near, k).withColumnRenamed("id", "number"), "number")
    return p.withColumn("Confianza", F.round("share", 4)).withColumn("Requiere_revision", F.col("share") < fixed.PROBA_REVIEW_THRESHOLD) \
        .withColumn("Modelo_usado", F.lit("knn"))


def _compared(rows):
    """Metrics of kNN, random forest and logistic regression on one held-out part, and a scorer for each."""
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    k = best_k(train)
    scorers = {"knn": lambda df: knn_predict(df, k, train)}
    for name in ("rf", "lr"):
        model, labels = _fitted(rows, name)
        scorers[name] = lambda df, model=model, labels=labels, name=name: md.predict_with_confidence(model, df, labels, model_name=name)
    out = None
    for name, score in scorers.items():
        m = ev.classification_metrics(ev.confusion_counts(score(test).select(F.col("clase").alias("y"), "pred"))).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return written(out, "comparison"), scorers


@register("model_comparison")
def q_model_comparison(spark, sf):
    return _compared(_prepared(spark, sf)[1])[0]


@register("relabel_unclassified", _CLEAN_DOCS_SQL + """
SELECT number, true AS valid, true AS flag_follows FROM cdocs WHERE clase = 'sin_clasificar'
""")
def q_relabel(spark, sf):
    vectors, rows = _prepared(spark, sf)
    scores, scorers = _compared(rows)
    best = scores.orderBy(F.desc("f1_weighted"), "model").first()["model"]
    threshold = fixed.PROBA_REVIEW_THRESHOLD
    labels = [r[0] for r in rows.select("clase").distinct().collect()]      # the label domain
    r = scorers[best](vectors.filter(F.col("clase") == fixed.UNCLASSIFIED))
    return r.select("number", (F.col("pred").isin(labels) & F.col("Confianza").between(0, 1)).alias("valid"),
                    (F.col("Requiere_revision") == (F.col("Confianza") < threshold)).alias("flag_follows"))


@register("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sq_norm_before, "
          "CASE WHEN list_max(list_transform(embedding, lambda x: abs(x))) > 0 THEN 1.0 ELSE 0.0 END AS sq_norm FROM embeddings")
def q_l2_normalize(spark, sf):
    from pyspark.ml.functions import array_to_vector
    e = b.read_table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))

    def squares(c):
        return F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda s, v: s + v * v)

    n = md.l2_normalize(e)
    return n.select("vec_id", F.round(squares("features"), 4).alias("sq_norm_before"), F.round(squares("features_l2"), 6).alias("sq_norm"))


@register("model_store", _HELD_SQL.replace("true AS valid, true AS flag_follows", "true AS same"))
def q_model_store(spark, sf):
    """The whole chain (text steps, features, model, label names), saved and reloaded, scores raw tickets as the one in memory."""
    _, rows, vocab = _prepared_over(spark, sf)
    model, labels = _fitted(rows, "lr")
    chain = ch.whole_chain(ch.TicketText(fixed.INCIDENT_FIELDS_FILL, "filled"), ch.vector_stages([vocab]), model, labels)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    md.save_model(chain.stages, path)
    raw = b.tickets(spark, sf).select("number", *fixed.INCIDENT_FIELDS_FILL).dropDuplicates(["number"])
    test = written(rows.filter("part = 'test'").select("number", F.col("clase").alias("y")).join(raw, "number"), "held-out")
    a = chain.transform(test).select("number", "y", F.col("Clasificación").alias("p"))
    again = md.load_model(path).transform(test).select("number", F.col("Clasificación").alias("q"))
    return a.join(again, "number").select("number", "y", (F.col("p") == F.col("q")).alias("same"))


# ------------------------------------------------------------- neighbours (embeddings)
_EMB_SQL = """
WITH e AS (SELECT vec_id AS id, label, embedding AS v, CAST(row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || vec_id), vec_id) - 1 AS BIGINT) %% 5 AS g FROM embeddings)
, u AS (SELECT id, label, g, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM e)
, pairs AS (SELECT q.id, q.g, q.label AS y, t.label, t.id AS tid, round(list_cosine_similarity(q.v, t.v), 9) AS s FROM u q JOIN u t ON %s)
, near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, tid) AS rank FROM pairs)
"""


def _folds(spark, sf):
    e = b.read_table(spark, sf, "embeddings")
    return written(ev.stratified_kfold(e, "label", "vec_id", 5, 42, "g"), "folds")


@register("knn_classify", _EMB_SQL % "q.g = 0 AND t.g <> 0" + """
, votes AS (SELECT id, y, label, count(*) AS n FROM near WHERE rank <= 5 GROUP BY ALL)
SELECT id, y, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1
""")
def q_knn_classify(spark, sf):
    """Fold 0 is scored by its 5 nearest rows of the other folds."""
    e = _folds(spark, sf)
    model = nn.fit_rows(e.filter("g <> 0"), "vec_id", "embedding", "label")
    test = e.filter("g = 0")
    pred = nn.vote(nn.nearest(test, model, "vec_id", "embedding", k=5), 5)
    return pred.join(test.select(F.col("vec_id").alias("id"), F.col("label").alias("y")), "id").select("id", "y", "pred")


@register("knn_search_k", _EMB_SQL % "q.g <> t.g" + """
, ks AS (SELECT unnest(range(1, 16)) AS k)
, votes AS (SELECT id, g, y, k, label, count(*) AS n FROM near JOIN ks ON rank <= k GROUP BY ALL)
, pred AS (SELECT id, g, y, k, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1)
, lab AS (SELECT DISTINCT k, g, y AS l FROM pred)
, f AS (SELECT lab.k, lab.g, l, (SELECT count(*) FROM pred p WHERE p.k = lab.k AND p.g = lab.g AND p.y = l AND p.pred = l) AS tp,
               (SELECT count(*) FROM pred p WHERE p.k = lab.k AND p.g = lab.g AND p.y = l) AS sup,
               (SELECT count(*) FROM pred p WHERE p.k = lab.k AND p.g = lab.g AND p.pred = l) AS pr FROM lab)
, w AS (SELECT k, g, sum(sup * CASE WHEN sup + pr > 0 THEN 2.0 * tp / (sup + pr) ELSE 0 END) / sum(sup) AS f1 FROM f GROUP BY k, g)
SELECT k, round(avg(f1), 6) AS f1_weighted FROM w GROUP BY k
""")
def q_knn_search_k(spark, sf):
    """Weighted F1 for k = 1..15, mean over 5 folds, from one neighbour pass."""
    e = _folds(spark, sf)
    model = nn.fit_rows(e, "vec_id", "embedding", "label", group="g")
    votes = nn.vote_all(nn.nearest(e, model, "vec_id", "embedding", group="g"))
    p = written(votes.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("y"), "g"), "id"), "votes")
    tp = p.filter("y = pred").groupBy("k", "g", F.col("y").alias("l")).agg(F.count(F.lit(1)).alias("tp"))
    sup = p.groupBy("k", "g", F.col("y").alias("l")).agg(F.count(F.lit(1)).alias("sup"))
    pr = p.groupBy("k", "g", F.col("pred").alias("l")).agg(F.count(F.lit(1)).alias("pr"))
    f = sup.join(tp, ["k", "g", "l"], "left").join(pr, ["k", "g", "l"], "left").fillna(0)
    f1 = F.col("sup") * 2.0 * F.col("tp") / (F.col("sup") + F.col("pr"))
    return f.groupBy("k", "g").agg((F.sum(f1) / F.sum("sup")).alias("f")).groupBy("k").agg(F.round(F.avg("f"), 6).alias("f1_weighted"))


# ------------------------------------------------------------- clusters (given labels) and coverage
@register("cluster_diagnostics", "SELECT label AS cluster_id, count(*) AS n, (SELECT count(DISTINCT label) FROM embeddings WHERE label >= 0) AS clusters, "
          "(SELECT count(*) FROM embeddings WHERE label = -1) AS noise FROM embeddings GROUP BY label")
def q_cluster_diagnostics(spark, sf):
    """Clusters without noise, noise rows, size per cluster, over given labels."""
    return ev.cluster_diagnostics(b.read_table(spark, sf, "embeddings"), "label")


@register("text_coverage", _CLEAN_DOCS_SQL + "SELECT count(*) AS n_rows, count(*) FILTER (trim(ctext) <> '') AS with_text FROM cdocs")
def q_text_coverage(spark, sf):
    """Tickets with non-empty cleaned text."""
    return clean_docs(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim("ctext") != "").alias("with_text"))
