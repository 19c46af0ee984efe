"""Registered queries: TF-IDF, splits, resampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import WS, sql_clean_text, sql_str
from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import projections as pj
from ..sources import bindings as b
from ..session import written
from .catalog import register
from .q_profile import BASE_SQL, base

W = b.ORACLE_WITH
_TEXT_SQL = "concat_ws(' ', coalesce(short_description, ''), coalesce(description, ''), coalesce(u_subcategory, ''), coalesce(u_subcategory_2, ''))"


def docs(spark, sf):
    """Training documents: every ticket, its repaired class and the unified text."""
    x = base(spark, sf)
    return pj.unify_text_fill(x, fixed.INCIDENT_FIELDS_FILL, out="text", raw_copy=None).select("number", "ord", "clase", "u_subcategory_2", "text")


DOCS_SQL = BASE_SQL + f"""
, docs AS (SELECT number, ord, clase, u_subcategory_2, {_TEXT_SQL} AS text FROM base)
"""


def _sql_word_tf(src: str, text_expr: str, strip_accents: bool):
    t = f"lower(coalesce({text_expr}, ''))"
    if strip_accents:
        t = fe.sql_strip_accents(t)
    return f"""
, toks AS (SELECT number, regexp_extract_all({t}, '{fe.TOKEN_RE_SQL}') AS tk FROM {src})
, grams AS (SELECT number, unnest(tk) AS term FROM toks
            UNION ALL
            SELECT number, tk[i] || ' ' || tk[i + 1] AS term FROM (SELECT number, tk, unnest(range(1, len(tk))) AS i FROM toks))
, tf AS (SELECT number AS doc, term, count(*) AS tf FROM grams GROUP BY ALL)
"""


def _sql_char_tf(src: str, text_expr: str, n_min=3, n_max=5):
    t = f"regexp_replace(lower(coalesce({text_expr}, '')), {sql_str(WS + '{2,}')}, ' ', 'g')"
    parts = " UNION ALL ".join(
        f"SELECT number, substr(t, i, {n}) AS term FROM (SELECT number, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM ct)"
        for n in range(n_min, n_max + 1))
    return f"""
, ct AS (SELECT number, {t} AS t FROM {src})
, grams AS ({parts})
, tf AS (SELECT number AS doc, term, count(*) AS tf FROM grams GROUP BY ALL)
"""


def _sql_tfidf(n_docs_sql: str, min_df: int, max_features, sublinear: bool):
    lim = f"ORDER BY cnt DESC, term LIMIT {max_features}" if max_features else ""
    w = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
, vocab0 AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term HAVING count(*) >= {min_df} {lim})
, vocab AS (SELECT term, df, cnt, ln((1 + {n_docs_sql}) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab0)
, w0 AS (SELECT tf.doc, tf.term, vocab.idx, {w} * vocab.idf AS w FROM tf JOIN vocab USING (term))
, wts AS (SELECT doc, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM w0)
"""


@register("tfidf_word", DOCS_SQL + _sql_word_tf("docs", "text", True)
          + _sql_tfidf("(SELECT count(*) FROM docs)", 3, 150000, True)
          + "SELECT doc AS number, term, round(weight, 6) AS weight FROM wts")
def q_tfidf_word(spark, sf):
    d = docs(spark, sf)
    w, v = fe.tfidf(d, "number", "text", "word", (1, 2), 3, 150000, sublinear=True, strip_accents=True)
    return fe.with_terms(w, v).select(F.col("doc").alias("number"), "term", F.round("weight", 6).alias("weight"))


@register("tfidf_char", DOCS_SQL + _sql_char_tf("docs", "text")
          + _sql_tfidf("(SELECT count(*) FROM docs)", 3, 100000, False)
          + "SELECT doc AS number, term, round(weight, 6) AS weight FROM wts")
def q_tfidf_char(spark, sf):
    w, v = fe.tfidf(docs(spark, sf), "number", "text", "char", (3, 5), 3, 100000)
    return fe.with_terms(w, v).select(F.col("doc").alias("number"), "term", F.round("weight", 6).alias("weight"))


_WORD_BLOCK = _sql_word_tf("docs", "text", True) + _sql_tfidf("(SELECT count(*) FROM docs)", 3, 150000, True)
_CHAR_BLOCK = _sql_char_tf("docs", "text") + _sql_tfidf("(SELECT count(*) FROM docs)", 3, 100000, False)


@register("feature_union", DOCS_SQL + _WORD_BLOCK + """
, word_wts AS (SELECT doc, idx, weight FROM wts), word_size AS (SELECT count(*) AS n FROM vocab)
, char_wts AS (WITH none AS (SELECT 1)""" + _CHAR_BLOCK + """SELECT doc, idx, weight FROM wts)
SELECT doc AS number, idx, round(weight, 6) AS weight FROM word_wts
UNION ALL SELECT doc, idx + (SELECT n FROM word_size), round(weight, 6) FROM char_wts
""")
def q_feature_union(spark, sf):
    d = docs(spark, sf)
    w, v = fe.tfidf(d, "number", "text", "word", (1, 2), 3, 150000, sublinear=True, strip_accents=True)
    c, _ = fe.tfidf(d, "number", "text", "char", (3, 5), 3, 100000)
    return fe.feature_union(w, c, v.count()).select(F.col("doc").alias("number"), "idx", F.round("weight", 6).alias("weight"))


_CLEAN_DOCS_SQL = DOCS_SQL + f"""
, cdocs AS (SELECT number, ord, clase, {sql_clean_text('text')} AS ctext FROM docs)
, lab AS (SELECT * FROM cdocs WHERE clase <> 'sin_clasificar')
"""


def clean_docs(spark, sf):
    d = docs(spark, sf)
    return d.select("number", "ord", "clase", tx.clean_text(F.col("text")).alias("ctext"))


@register("tfidf_5000", _CLEAN_DOCS_SQL + _sql_word_tf("lab", "ctext", False)
          + _sql_tfidf("(SELECT count(*) FROM lab)", 1, 5000, False).replace("FROM tf JOIN vocab", "FROM tf_all AS tf JOIN vocab")
          .replace(", w0 AS", _sql_word_tf("cdocs", "ctext", False).replace("toks", "toks2").replace("grams", "grams2")
                   .replace(", tf AS", ", tf_all AS") + ", w0 AS")
          + "SELECT doc AS number, term, round(weight, 6) AS weight FROM wts")
def q_tfidf_5000(spark, sf):
    symbols, vocab, _ = _vocabulary_5000(spark, sf)
    w = fe.transform_tfidf(symbols, vocab)
    return fe.with_terms(w, vocab).select(F.col("doc").alias("number"), "term", F.round("weight", 6).alias("weight"))


def _vocabulary_5000(spark, sf):
    """Tokens of every cleaned ticket, the 5,000 terms fitted on the labelled ones, and the cleaned tickets."""
    c = written(clean_docs(spark, sf), "cleaned")     # cleaned once
    lab = c.filter(F.col("clase") != fixed.UNCLASSIFIED)
    vocab = fe.fit_vocabulary(fe.term_counts(fe.terms_frame(lab, "number", "ctext", "cleaned")), lab.count(), 1, 5000)
    return fe.terms_frame(c, "number", "ctext", "cleaned"), vocab, c


@register("vocabulary_listing", _CLEAN_DOCS_SQL + _sql_word_tf("lab", "ctext", False)
          + _sql_tfidf("(SELECT count(*) FROM lab)", 1, 5000, False)
          + "SELECT idx, term, df, cnt, round(idf, 6) AS idf FROM vocab")
def q_vocabulary_listing(spark, sf):
    _, v, _ = _vocabulary_5000(spark, sf)
    return v.select("idx", "term", "df", "cnt", F.round("idf", 6).alias("idf")).orderBy("term")


# ------------------------------------------------------------- splits
_LAB_SQL = BASE_SQL + """
, lab AS (SELECT * FROM base WHERE clase <> 'sin_clasificar')
, ranked AS (SELECT *, row_number() OVER (PARTITION BY clase ORDER BY sha256('42|' || number), number) AS rn,
                    count(*) OVER (PARTITION BY clase) AS nc FROM lab)
, split AS (SELECT *, CASE WHEN nc >= 2 AND rn <= round(nc * 0.2) THEN 'test' ELSE 'train' END AS part FROM ranked)
"""


def labelled(spark, sf):
    return base(spark, sf).filter(F.col("clase") != fixed.UNCLASSIFIED)


def split(spark, sf):
    return ev.stratified_split(labelled(spark, sf), "clase", "number", 0.2, 42, "part")


@register("stratified_split", _LAB_SQL + "SELECT number, clase, part FROM split")
def q_stratified_split(spark, sf):
    return split(spark, sf).select("number", "clase", "part")


@register("stratified_kfold", _LAB_SQL + "SELECT number, clase, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM split WHERE part = 'train'")
def q_stratified_kfold(spark, sf):
    tr = split(spark, sf).filter("part = 'train'")
    return ev.stratified_kfold(tr, "clase", "number", 5, 42).select("number", "clase", "fold")


@register("label_encode", _LAB_SQL + "SELECT number, clase, CAST(dense_rank() OVER (ORDER BY clase) - 1 AS DOUBLE) AS label_idx FROM lab")
def q_label_encode(spark, sf):
    return ev.label_encode(labelled(spark, sf), "clase").select("number", "clase", "label_idx")


_OVERS_SQL = _LAB_SQL + """
, tr AS (SELECT * FROM split WHERE part = 'train')
, cnt AS (SELECT clase, count(*) AS nc2 FROM tr GROUP BY clase)
, tgt AS (SELECT max(nc2) AS t FROM cnt)
, x AS (SELECT tr.number, tr.clase, cnt.nc2, row_number() OVER (PARTITION BY tr.clase ORDER BY sha256('42|' || tr.number), tr.number) AS rk
        FROM tr JOIN cnt USING (clase))
, over AS (SELECT number, clase, unnest(range(1, CAST(floor((SELECT t FROM tgt) / nc2) AS BIGINT) + (CASE WHEN rk <= (SELECT t FROM tgt) % nc2 THEN 1 ELSE 0 END) + 1)) AS copy FROM x)
"""


def oversampled(spark, sf):
    tr = split(spark, sf).filter("part = 'train'").drop("part")
    return ev.random_oversample(tr, "clase", "number", 42)


@register("random_oversample", _OVERS_SQL + "SELECT number, clase, copy FROM over")
def q_random_oversample(spark, sf):
    return oversampled(spark, sf).select("number", "clase", F.col("copy").cast("bigint").alias("copy"))


@register("class_balance_before_after", _OVERS_SQL + """
SELECT 'before' AS stage, clase, count(*) AS n FROM tr GROUP BY clase
UNION ALL SELECT 'after' AS stage, clase, count(*) AS n FROM over GROUP BY clase
""")
def q_class_balance(spark, sf):
    tr = split(spark, sf).filter("part = 'train'")
    o = oversampled(spark, sf)
    return (tr.groupBy(F.lit("before").alias("stage"), "clase").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(o.groupBy(F.lit("after").alias("stage"), "clase").agg(F.count(F.lit(1)).alias("n"))))


@register("class_weights_balanced", _LAB_SQL + """
SELECT clase, count(*) AS n_c, (SELECT count(*) FROM lab) / ((SELECT count(DISTINCT clase) FROM lab) * count(*)) AS weight
FROM lab GROUP BY clase
""")
def q_class_weights(spark, sf):
    return ev.class_weights_balanced(labelled(spark, sf), "clase")


@register("union_train_singletons", _LAB_SQL + "SELECT number, clase FROM split WHERE part = 'train' AND nc >= 2 UNION ALL SELECT number, clase FROM split WHERE nc < 2")
def q_union_train_singletons(spark, sf):
    s = split(spark, sf)
    n = s.groupBy("clase").agg(F.count(F.lit(1)).alias("nc"))
    s = s.join(n, "clase")
    return (s.filter("part = 'train' AND nc >= 2").select("number", "clase")
            .unionByName(s.filter("nc < 2").select("number", "clase")))


# ------------------------------------------------------------- baseline predictions + metrics
_PRED_SQL = _LAB_SQL + """
, trn AS (SELECT * FROM split WHERE part = 'train')
, m0 AS (SELECT u_subcategory_2 AS src, clase, count(*) AS n FROM trn GROUP BY ALL)
, m1 AS (SELECT src, clase AS maj FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, clase) AS r FROM m0) WHERE r = 1)
, g AS (SELECT clase AS gmaj FROM trn GROUP BY clase ORDER BY count(*) DESC, clase LIMIT 1)
, pred AS (SELECT s.number, s.clase AS y, coalesce(m1.maj, (SELECT gmaj FROM g)) AS pred, s.u_subcategory_2
           FROM split s LEFT JOIN m1 ON m1.src = s.u_subcategory_2 WHERE s.part = 'test')
, cc AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL)
, labels AS (SELECT y AS label FROM cc UNION SELECT pred FROM cc)
, pcs0 AS (SELECT l.label,
                 coalesce((SELECT sum(n) FROM cc WHERE cc.y = l.label AND cc.pred = l.label), 0) AS tp,
                 coalesce((SELECT sum(n) FROM cc WHERE cc.y = l.label), 0) AS support,
                 coalesce((SELECT sum(n) FROM cc WHERE cc.pred = l.label), 0) AS predicted FROM labels l)
, pcs1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                     CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pcs0)
, pcs AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pcs1)
"""


def predictions(spark, sf):
    """Baseline classifier: majority class of the ticket's language on the train
    split (ties to the smaller class), global majority otherwise."""
    s = written(split(spark, sf).select("number", "clase", "u_subcategory_2", "part"), "split")      # read four times
    trn = s.filter("part = 'train'")
    m0 = trn.groupBy(F.col("u_subcategory_2").alias("src"), "clase").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "clase")
    m1 = m0.withColumn("r", F.row_number().over(w)).filter("r = 1").select("src", F.col("clase").alias("maj"))
    gmaj = (trn.groupBy("clase").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "clase").limit(1).select("clase"))
    t = s.filter("part = 'test'")
    t = t.join(m1, t["u_subcategory_2"] == m1["src"], "left")
    t = t.withColumn("pred", F.coalesce(F.col("maj"), gmaj.select(F.first("clase")).scalar()))
    return t.select("number", F.col("clase").alias("y"), "pred", "u_subcategory_2")


@register("classification_metrics", _PRED_SQL + """
SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(tp) / sum(support) AS f1_micro,
       sum(f1 * support) / sum(support) AS f1_weighted, sum(precision * support) / sum(support) AS precision_weighted,
       sum(recall * support) / sum(support) AS recall_weighted FROM pcs
""")
def q_classification_metrics(spark, sf):
    return ev.classification_metrics(ev.confusion_counts(predictions(spark, sf)))


@register("classification_report", _PRED_SQL + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pcs
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support) FROM pcs
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM pcs
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), sum(support) FROM pcs
""")
def q_classification_report(spark, sf):
    return ev.classification_report(ev.confusion_counts(predictions(spark, sf)))


@register("confusion_matrix", _PRED_SQL + "SELECT y, pred, n, n / sum(n) OVER (PARTITION BY y) AS row_share FROM cc")
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(ev.confusion_counts(predictions(spark, sf)))


@register("error_table", _PRED_SQL + "SELECT number, y, pred FROM pred WHERE y IS DISTINCT FROM pred")
def q_error_table(spark, sf):
    return ev.error_table(predictions(spark, sf)).select("number", "y", "pred")


@register("confusion_pairs", _PRED_SQL + "SELECT y, pred, count(*) AS n FROM pred WHERE y IS DISTINCT FROM pred GROUP BY ALL ORDER BY n DESC, y, pred LIMIT 15")
def q_confusion_pairs(spark, sf):
    return ev.confusion_pairs(predictions(spark, sf), top=15)


@register("confusion_tickets", _PRED_SQL + """
SELECT y, pred, count(*) AS n, string_agg(CASE WHEN r <= 30 THEN number END, ', ' ORDER BY number) AS tickets
FROM (SELECT *, row_number() OVER (PARTITION BY y, pred ORDER BY number) AS r FROM pred WHERE y IS DISTINCT FROM pred) GROUP BY ALL
""")
def q_confusion_tickets(spark, sf):
    from ..operators.labels import first_n_per_group
    e = ev.error_table(predictions(spark, sf)).withColumn("pair", F.concat_ws("\u0001", "y", "pred"))
    cnt = e.groupBy("pair", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    ids = first_n_per_group(e, "pair", "number", 30, "number", "tickets")
    return cnt.join(ids, "pair").drop("pair")


@register("error_rate", _PRED_SQL + """
SELECT CAST(sum(CASE WHEN y IS DISTINCT FROM pred THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       avg(CASE WHEN y IS DISTINCT FROM pred THEN 1.0 ELSE 0.0 END) AS error_rate,
       1.0 - avg(CASE WHEN y IS DISTINCT FROM pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred
""")
def q_error_rate(spark, sf):
    return ev.error_rate(predictions(spark, sf))


@register("label_union_distinct", _PRED_SQL + "SELECT y AS label FROM pred UNION SELECT pred FROM pred")
def q_label_union_distinct(spark, sf):
    return ev.label_union_distinct(predictions(spark, sf))


@register("join_predictions_back", _PRED_SQL + "SELECT b.number, b.short_description, p.y, p.pred FROM base b JOIN pred p USING (number)")
def q_join_predictions_back(spark, sf):
    p = predictions(spark, sf)
    return base(spark, sf).join(p, "number").select("number", "short_description", "y", "pred")


_SOFT = """
, sc AS (SELECT number, [length(short_description) / 80.0, coalesce(n_chars, 0) / 20000.0, coalesce(value, 0) / 100.0] AS s FROM base)
, sm AS (SELECT number, list_max(list_transform(s, lambda v: exp(v - list_max(s)))) / list_sum(list_transform(s, lambda v: exp(v - list_max(s)))) AS conf FROM sc)
"""


def _scores(spark, sf):
    x = base(spark, sf)
    return x.select("number", F.array(F.length("short_description") / 80.0, F.coalesce("n_chars", F.lit(0)) / 20000.0,
                                      F.coalesce("value", F.lit(0.0)) / 100.0).alias("s"))


@register("softmax_confidence", BASE_SQL + _SOFT + "SELECT number, round(conf, 6) AS conf, conf < 0.1 AS needs_review FROM sm")
def q_softmax_confidence(spark, sf):
    s = _scores(spark, sf).select("number", ev.softmax_confidence(F.col("s")).alias("conf"))
    return s.select("number", F.round("conf", 6).alias("conf"), (F.col("conf") < fixed.SOFTMAX_REVIEW_THRESHOLD).alias("needs_review"))


@register("confidence_summary", BASE_SQL + _SOFT + """
SELECT CAST(least(floor(conf * 20), 19) AS INTEGER) AS bin, count(*) AS n,
       (SELECT count(*) FROM sm WHERE conf < 0.1) AS low, (SELECT avg(CASE WHEN conf < 0.1 THEN 1.0 ELSE 0.0 END) FROM sm) AS low_share
FROM sm GROUP BY 1
""")
def q_confidence_summary(spark, sf):
    s = _scores(spark, sf).select("number", ev.softmax_confidence(F.col("s")).alias("conf"))
    return ev.confidence_summary(s, "conf", fixed.SOFTMAX_REVIEW_THRESHOLD)


# twelve classes: tickets whose scores are equal are sure of none, 1/12 each
_CLASSES = [f"clase {k:02d}" for k in range(12)]
_MANY_SQL = BASE_SQL + f"""
, many AS (SELECT number, ord, clase, [{", ".join(f"((ord * {k + 3}) % 13) * (ord % 4) / 13.0" for k in range(12))}] AS s FROM base)
, ex AS (SELECT *, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM many)
, sm AS (SELECT number, clase, list_max(e) / list_sum(e) AS conf, list_position(s, list_max(s)) AS best FROM ex)
"""


def _many_scores(spark, sf):
    score = [(F.col("ord") * (k + 3)) % 13 * (F.col("ord") % 4) / 13.0 for k in range(12)]
    return base(spark, sf).select("number", "clase", F.array(*score).alias("s")).withColumn("conf", ev.softmax_confidence(F.col("s")))


@register("softmax_confidence_many", _MANY_SQL + "SELECT number, round(conf, 6) AS conf, conf < 0.1 AS needs_review FROM sm")
def q_softmax_confidence_many(spark, sf):
    return _many_scores(spark, sf).select("number", F.round("conf", 6).alias("conf"), (F.col("conf") < fixed.SOFTMAX_REVIEW_THRESHOLD).alias("needs_review"))


@register("confidence_summary_many", _MANY_SQL + """
SELECT CAST(least(floor(conf * 20), 19) AS INTEGER) AS bin, count(*) AS n,
       (SELECT count(*) FROM sm WHERE conf < 0.1) AS low, (SELECT avg(CASE WHEN conf < 0.1 THEN 1.0 ELSE 0.0 END) FROM sm) AS low_share
FROM sm GROUP BY 1
""")
def q_confidence_summary_many(spark, sf):
    return ev.confidence_summary(_many_scores(spark, sf), "conf", fixed.SOFTMAX_REVIEW_THRESHOLD)


@register("tag_source_confidence", _MANY_SQL + """
SELECT number, clase AS "Clasificación", 'Original_Clasificado' AS "Fuente", 1.0::DOUBLE AS "Confianza", NULL::VARCHAR AS "Modelo_usado"
FROM sm WHERE clase <> 'sin_clasificar'
UNION ALL SELECT number, 'clase ' || lpad(CAST(best - 1 AS VARCHAR), 2, '0'), 'Reclasificado_IA', round(conf, 4), 'softmax' FROM sm WHERE clase = 'sin_clasificar'
""")
def q_tag_source_confidence(spark, sf):
    """The complete set, each row with where its class is from."""
    x = _many_scores(spark, sf).withColumnRenamed("clase", "Categoría")
    x = pj.rename_class_column(x)
    known = pj.tag_source_confidence(x.filter(F.col("Clasificación") != fixed.UNCLASSIFIED), "Original_Clasificado", 1.0)
    best = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), F.array_position("s", F.array_max("s")).cast("int"))
    given = x.filter(F.col("Clasificación") == fixed.UNCLASSIFIED).withColumn("Clasificación", best)
    given = pj.tag_source_confidence(given, "Reclasificado_IA", F.round("conf", 4), "softmax")
    return known.unionByName(given, allowMissingColumns=True).drop("s", "conf")


@register("arg_best", _PRED_SQL + """
, sc2 AS (SELECT 'source_majority' AS model, 0 AS ord, sum(f1) / count(*) AS f1 FROM pcs
          UNION ALL SELECT 'label_' || label, 1 + row_number() OVER (ORDER BY label), f1 FROM pcs)
SELECT arg_max(model, f1 * 1e9 - ord) AS best FROM (SELECT model, ord, round(f1, 9) AS f1 FROM sc2)
""")
def q_arg_best(spark, sf):
    pcs = ev.per_class(ev.confusion_counts(predictions(spark, sf)))
    macro = pcs.agg(F.avg("f1").alias("f1")).select(F.lit("source_majority").alias("model"), F.lit(0).alias("ord"), "f1")
    per = pcs.select(F.concat(F.lit("label_"), "label").alias("model"),
                     (F.row_number().over(Window.orderBy("label")) + 1).alias("ord"), "f1")
    allm = macro.unionByName(per).withColumn("f1", F.round("f1", 9))
    return ev.arg_best(allm, "model", "f1", "ord")


@register("top_k", BASE_SQL + "SELECT number, n_chars FROM base ORDER BY n_chars DESC, number LIMIT 20")
def q_top_k(spark, sf):
    return base(spark, sf).select("number", "n_chars").orderBy(F.desc("n_chars"), "number").limit(20)


@register("sort_multi_key", BASE_SQL + "SELECT clase, u_subcategory_2, number FROM base ORDER BY clase DESC, u_subcategory_2, number")
def q_sort_multi_key(spark, sf):
    return base(spark, sf).select("clase", "u_subcategory_2", "number").orderBy(F.desc("clase"), "u_subcategory_2", "number")


@register("union_complete_set", _PRED_SQL + """
SELECT number, y AS "Clasificación", 'original' AS "Fuente", NULL AS "Clasificación_predicha" FROM pred
UNION ALL
SELECT number, NULL, 'reclasificado', clase FROM base WHERE clase = 'sin_clasificar'
""")
def q_union_complete_set(spark, sf):
    p = predictions(spark, sf).select("number", F.col("y").alias("Clasificación"), F.lit("original").alias("Fuente"))
    r = (base(spark, sf).filter(F.col("clase") == fixed.UNCLASSIFIED)
         .select("number", F.lit("reclasificado").alias("Fuente"), F.col("clase").alias("Clasificación_predicha")))
    return p.unionByName(r, allowMissingColumns=True)
