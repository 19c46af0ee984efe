"""Registered queries: profiling and label repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import labels as lb
from ..operators import profile as pf
from ..operators import projections as pj
from ..sources import bindings as b
from .catalog import register
from .q_text import _REPAIRED

W = b.ORACLE_WITH
TEXT_FIELDS = ("short_description", "description")
_TRAW = "concat_ws(' ', coalesce(short_description, ''), coalesce(description, ''))"
BASE_SQL = W + f"""
, base AS (
  SELECT t.ord, t.number, t.short_description, t.description, t.u_subcategory, t.u_subcategory_2, t.category,
         t.contact_type, t.n_chars, t.value, {_REPAIRED.replace('clasificacion', 't.clasificacion')} AS clase,
         {_TRAW} AS traw
  FROM tickets_num t
)"""


def base(spark, sf):
    t = b.tickets_with_numbers(spark, sf)
    t = t.withColumn("clase", pj.repair_labels(F.col("clasificacion")))
    t = pj.unify_text_fill(t, TEXT_FIELDS, out="traw", raw_copy=None)
    return t.select("ord", "number", "short_description", "description", "u_subcategory", "u_subcategory_2",
                    "category", "contact_type", "n_chars", "value", "clase", "traw")


@register("class_distribution", BASE_SQL + """
SELECT clase, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM base), 4) AS pct FROM base GROUP BY clase
""")
def q_class_distribution(spark, sf):
    return pf.class_distribution(base(spark, sf), "clase")


_PROFILE_COLS = ["ord", "number", "short_description", "description", "u_subcategory", "u_subcategory_2",
                 "category", "contact_type", "sys_created_on", "clasificacion", "n_chars", "value"]
_DTYPES = {"ord": "bigint", "sys_created_on": "timestamp_ntz", "n_chars": "bigint", "value": "double"}


def _profile_frame(spark, sf):
    return b.tickets_with_numbers(spark, sf).select(*_PROFILE_COLS)


def _unpivot_sql(exprs, names):
    return " UNION ALL ".join(f"SELECT '{c}' AS {names[0]}, CAST({e} AS BIGINT) AS {names[1]} FROM tickets_num"
                              for c, e in exprs)


@register("null_profile", W + f"""
SELECT "column", nulls, round(nulls * 100.0 / greatest((SELECT count(*) FROM tickets_num), 1), 4) AS null_pct
FROM ({_unpivot_sql([(c, f'count(*) FILTER (WHERE {c} IS NULL)') for c in _PROFILE_COLS], ('"column"', 'nulls'))})
ORDER BY nulls DESC, "column" LIMIT 15
""")
def q_null_profile(spark, sf):
    return pf.null_profile(_profile_frame(spark, sf), 15)


@register("distinct_profile", W + _unpivot_sql([(c, f"count(DISTINCT {c})") for c in _PROFILE_COLS], ('"column"', 'n_distinct')))
def q_distinct_profile(spark, sf):
    return pf.distinct_profile(_profile_frame(spark, sf))


@register("non_null_types", W + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS non_null, '{_DTYPES.get(c, 'string')}' AS dtype FROM tickets_num"
    for c in _PROFILE_COLS))
def q_non_null_types(spark, sf):
    return pf.non_null_types(_profile_frame(spark, sf))


@register("informative_columns", W + f"""
SELECT "column", n_distinct, "column" IN ('ord', 'n_chars', 'value') AS is_numeric,
       n_distinct > 1 AND n_distinct < (SELECT count(*) FROM tickets_num) * 0.9 AND NOT starts_with(lower("column"), 'id') AS informative
FROM ({_unpivot_sql([(c, f"count(DISTINCT {c})") for c in _PROFILE_COLS], ('"column"', 'n_distinct'))})
""")
def q_informative_columns(spark, sf):
    return pf.informative_columns(_profile_frame(spark, sf))


_DUP_COLS = ["short_description", "description", "u_subcategory_2", "clasificacion"]


@register("duplicate_rows", W + f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) AS repeated_groups
FROM (SELECT {', '.join(_DUP_COLS)}, count(*) AS n FROM tickets GROUP BY ALL HAVING count(*) > 1)
""")
def q_duplicate_rows(spark, sf):
    return pf.duplicate_rows(b.tickets(spark, sf), _DUP_COLS)


_CT_COLS = ["contact_type", "u_subcategory", "u_subcategory_2", "category", "number"]
_CT_SQL = BASE_SQL + ", nd AS (SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in _CT_COLS) + " FROM base)\n" + \
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, clase, count(*) AS n FROM base "
        f"WHERE (SELECT {c} FROM nd) BETWEEN 2 AND 24 GROUP BY ALL" for c in _CT_COLS)


@register("crosstab", _CT_SQL)
def q_crosstab(spark, sf):
    return pf.crosstab_long(base(spark, sf), _CT_COLS, "clase")


@register("numeric_by_class", BASE_SQL + """
SELECT clase, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS min,
       quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3,
       CAST(max(n_chars) AS DOUBLE) AS max
FROM base GROUP BY clase
""")
def q_numeric_by_class(spark, sf):
    return pf.numeric_by_class(base(spark, sf), "clase", "n_chars")


@register("anova_by_class", BASE_SQL + """
, g AS (SELECT clase, count(n_chars) AS n, sum(n_chars) AS s, avg(n_chars) AS m FROM base WHERE n_chars IS NOT NULL
        GROUP BY clase HAVING count(n_chars) > 1)
, tot AS (SELECT sum(n) AS "N", count(*) AS k, sum(s) / sum(n) AS gm FROM g)
, w AS (SELECT sum((b.n_chars - g.m) * (b.n_chars - g.m)) AS ssw FROM base b JOIN g USING (clase) WHERE b.n_chars IS NOT NULL)
, bt AS (SELECT sum(n * (m - (SELECT gm FROM tot)) * (m - (SELECT gm FROM tot))) AS ssb FROM g)
SELECT 'n_chars' AS "column", k AS n_classes, "N" AS n_rows,
       CASE WHEN k > 1 AND "N" > k AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / ("N" - k)) END AS f_stat
FROM tot, w, bt
""".replace("SELECT 'n_chars' AS", ", fs AS (SELECT 'n_chars' AS") + """)
, beta AS (SELECT *, ("n_rows" - n_classes) / 2.0 AS a, (n_classes - 1) / 2.0 AS b,
                  ("n_rows" - n_classes) / ("n_rows" - n_classes + (n_classes - 1) * f_stat) AS x FROM fs)
, tail AS (SELECT sum(exp(a * ln(x) + b * ln(1 - x) - ln(a) + lgamma(a + b + n) - lgamma(b) - lgamma(a)
                          + lgamma(a + 1) - lgamma(a + 1 + n) + n * ln(x))) AS p
           FROM beta, (SELECT unnest(range(0, 1000000)) AS n))
SELECT "column", n_classes, n_rows, f_stat, round(p, 6) AS p_value FROM fs, tail
""")
def q_anova_by_class(spark, sf):
    """A8; the oracle sums the tail as a power series, the operator as a continued fraction."""
    return pf.anova_by_class(base(spark, sf), "clase", "n_chars").withColumn("p_value", F.round("p_value", 6))


_SUMMARY_SQL = BASE_SQL + """
, grp AS (SELECT traw, count(*) AS n_tickets, array_to_string(list_sort(list_distinct(list(clase))), ', ') AS clasificaciones,
                 count(DISTINCT clase) AS n_clases FROM base GROUP BY traw HAVING count(*) > 1)
, ex AS (SELECT traw, string_agg(number, ', ' ORDER BY ord) AS ejemplos
         FROM (SELECT traw, number, ord, row_number() OVER (PARTITION BY traw ORDER BY ord) AS r FROM base) WHERE r <= 4 GROUP BY traw)
, summ AS (SELECT grp.*, ex.ejemplos FROM grp JOIN ex USING (traw))
"""


def _summary(spark, sf):
    return lb.duplicate_text_summary(base(spark, sf), "traw", "clase", "number", "ord")


@register("duplicate_text_summary", _SUMMARY_SQL + "SELECT traw, n_tickets, clasificaciones, n_clases, ejemplos FROM summ")
def q_duplicate_text_summary(spark, sf):
    return _summary(spark, sf).drop("text_key")


@register("ambiguous_texts", _SUMMARY_SQL + """
SELECT traw, n_tickets, clasificaciones, n_clases, ejemplos,
       NOT regexp_matches(clasificaciones, '\\bsin_clasificar\\b') AS is_real
FROM summ WHERE n_clases > 1
""")
def q_ambiguous_texts(spark, sf):
    s = _summary(spark, sf)
    allamb = lb.ambiguous_texts(s, exclude_unclassified=False)
    real = lb.ambiguous_texts(s).select("text_key", F.lit(True).alias("is_real"))
    return (allamb.join(real, "text_key", "left").withColumn("is_real", F.coalesce("is_real", F.lit(False)))
            .drop("text_key"))


_AMB_REAL = _SUMMARY_SQL + """
, amb AS (SELECT traw FROM summ WHERE n_clases > 1 AND NOT regexp_matches(clasificaciones, '\\bsin_clasificar\\b'))
, cnt AS (SELECT traw, clase, count(*) AS n, min(ord) AS f FROM base WHERE traw IN (SELECT traw FROM amb) GROUP BY ALL)
, maj AS (SELECT traw, clase AS majority FROM (SELECT *, row_number() OVER (PARTITION BY traw ORDER BY n DESC, f ASC) AS r FROM cnt) WHERE r = 1)
, repaired AS (SELECT b.*, coalesce(maj.majority, b.clase) AS clase2 FROM base b LEFT JOIN maj USING (traw))
"""


@register("majority_label", _AMB_REAL + "SELECT traw, majority FROM maj")
def q_majority_label(spark, sf):
    x = base(spark, sf)
    s = _summary(spark, sf)
    rows = lb.semi_ambiguous_texts(x, "traw", lb.ambiguous_texts(s))
    m = lb.majority_label(rows, "clase", "ord")
    keyed = lb.with_text_key(x, "traw").select("text_key", "traw").dropDuplicates(["text_key"])
    return m.join(keyed, "text_key").select("traw", "majority")


@register("apply_majority_label", _AMB_REAL + "SELECT number, clase2 AS clase FROM repaired")
def q_apply_majority_label(spark, sf):
    return lb.repair_ambiguous(base(spark, sf), "traw", "clase", "ord").select("number", "clase")


@register("verify_single_class", _AMB_REAL + """
SELECT traw, count(DISTINCT clase2) AS n_clases, array_to_string(list_sort(list_distinct(list(clase2))), ', ') AS clasificaciones
FROM repaired GROUP BY traw HAVING count(DISTINCT clase2) > 1
""")
def q_verify_single_class(spark, sf):
    r = lb.repair_ambiguous(base(spark, sf), "traw", "clase", "ord")
    v = lb.verify_single_class(r, "traw", "clase")
    keyed = lb.with_text_key(r, "traw").select("text_key", "traw").dropDuplicates(["text_key"])
    return v.join(keyed, "text_key").select("traw", "n_clases", "clasificaciones")


@register("dedup_keep_first", _AMB_REAL + """
SELECT number, clase2 AS clase FROM (SELECT *, row_number() OVER (PARTITION BY traw ORDER BY ord) AS r FROM repaired) WHERE r = 1
""")
def q_dedup_keep_first(spark, sf):
    r = lb.repair_ambiguous(base(spark, sf), "traw", "clase", "ord")
    return lb.dedup_keep_first(r, "traw", "ord").select("number", "clase")


@register("flag_duplicates", BASE_SQL + """
SELECT number, count(*) OVER (PARTITION BY traw) > 1 AS is_dup FROM base
""")
def q_flag_duplicates(spark, sf):
    return lb.flag_duplicates(base(spark, sf), "traw").select("number", "is_dup")


@register("duplicate_share", BASE_SQL + """
, g AS (SELECT traw, count(*) AS n FROM base GROUP BY traw)
SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS dup_rows,
       round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS dup_share,
       count(*) FILTER (WHERE n > 1) AS repeated_texts FROM g
""")
def q_duplicate_share(spark, sf):
    return lb.duplicate_share(base(spark, sf), "traw")


@register("first_n_per_group", BASE_SQL + """
SELECT clase, string_agg(number, ', ' ORDER BY ord) AS first_ids
FROM (SELECT clase, number, ord, row_number() OVER (PARTITION BY clase ORDER BY ord) AS r FROM base) WHERE r <= 30 GROUP BY clase
""")
def q_first_n_per_group(spark, sf):
    return lb.first_n_per_group(base(spark, sf), "clase", "ord", 30, "number", "first_ids")


@register("semi_ambiguous_texts", _AMB_REAL + "SELECT number FROM base WHERE traw IN (SELECT traw FROM amb)")
def q_semi_ambiguous(spark, sf):
    x = base(spark, sf)
    return lb.semi_ambiguous_texts(x, "traw", lb.ambiguous_texts(_summary(spark, sf))).select("number")


@register("review_listing", _AMB_REAL + """
SELECT number, traw, clase, short_description, description, category FROM base
WHERE traw IN (SELECT traw FROM amb) ORDER BY number
""")
def q_review_listing(spark, sf):
    x = base(spark, sf)
    return lb.review_listing(x, "traw", "clase", "number", lb.ambiguous_texts(_summary(spark, sf)))


# ------------------------------------------------------------- labels that disagree
# The labels of the given tables agree inside a repeated text.  Here every ticket is labelled by its number, so copies of a
# text disagree (also in ties); some are unclassified, which leaves their group alone (Q16).
_BY_NUMBER = "CASE WHEN ord % 50 = 7 THEN 'sin_clasificar' WHEN ord % 3 = 0 THEN 'cheques' WHEN ord % 3 = 1 THEN 'cuentas' ELSE 'garantias' END"
_DISAGREEING_SQL = _AMB_REAL.replace(BASE_SQL, BASE_SQL.replace(", base AS (", ", base_given AS (")
                                     + f", base AS (SELECT * REPLACE ({_BY_NUMBER} AS clase) FROM base_given)")


def _disagreeing(spark, sf):
    """The tickets labelled by number, their summary of repeated texts and the texts that are ambiguous."""
    x = base(spark, sf).withColumn("clase", F.expr(_BY_NUMBER))
    return x, lb.ambiguous_texts(lb.duplicate_text_summary(x, "traw", "clase", "number", "ord"))


@register("ambiguous_texts_disagreeing", _DISAGREEING_SQL + """
SELECT traw, n_tickets, clasificaciones, n_clases, ejemplos FROM summ JOIN amb USING (traw)
""")
def q_ambiguous_disagreeing(spark, sf):
    return _disagreeing(spark, sf)[1].drop("text_key")


@register("majority_label_disagreeing", _DISAGREEING_SQL + "SELECT traw, majority FROM maj")
def q_majority_disagreeing(spark, sf):
    x, ambiguous = _disagreeing(spark, sf)
    majority = lb.majority_label(lb.semi_ambiguous_texts(x, "traw", ambiguous), "clase", "ord")
    return ambiguous.select("text_key", "traw").join(majority, "text_key").select("traw", "majority")


@register("apply_majority_label_disagreeing", _DISAGREEING_SQL + "SELECT number, clase AS given, clase2 AS clase FROM repaired")
def q_apply_majority_disagreeing(spark, sf):
    x = _disagreeing(spark, sf)[0].withColumn("given", F.col("clase"))
    return lb.repair_ambiguous(x, "traw", "clase", "ord").select("number", "given", "clase")


@register("semi_ambiguous_texts_disagreeing", _DISAGREEING_SQL + "SELECT number, clase FROM base WHERE traw IN (SELECT traw FROM amb)")
def q_semi_ambiguous_disagreeing(spark, sf):
    x, ambiguous = _disagreeing(spark, sf)
    return lb.semi_ambiguous_texts(x, "traw", ambiguous).select("number", "clase")


@register("review_listing_disagreeing", _DISAGREEING_SQL + """
SELECT number, traw, clase, short_description, description, category FROM base
WHERE traw IN (SELECT traw FROM amb) ORDER BY number
""")
def q_review_disagreeing(spark, sf):
    x, ambiguous = _disagreeing(spark, sf)
    return lb.review_listing(x, "traw", "clase", "number", ambiguous)


@register("verify_single_class_disagreeing", _DISAGREEING_SQL + """
SELECT traw, count(DISTINCT clase2) AS n_clases, array_to_string(list_sort(list_distinct(list(clase2))), ', ') AS clasificaciones
FROM repaired GROUP BY traw HAVING count(DISTINCT clase2) > 1
""")
def q_verify_disagreeing(spark, sf):
    r = lb.repair_ambiguous(_disagreeing(spark, sf)[0], "traw", "clase", "ord")
    v = lb.verify_single_class(r, "traw", "clase")
    texts = lb.with_text_key(r, "traw").select("text_key", "traw").dropDuplicates(["text_key"])
    return v.join(texts, "text_key").select("traw", "n_clases", "clasificaciones")
