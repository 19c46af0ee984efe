"""Registered queries: text functions and ticket projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.text import sql_str, to_sql
from ..operators import projections as pj
from ..sources import bindings as b
from .catalog import register
from .sqlfrag import s_list, s_strip, s_group_key, s_singular

W = b.ORACLE_WITH


def _t(spark, sf):
    return b.tickets(spark, sf)


# F1 + P1 -------------------------------------------------------------------
_P1_FIELDS = [f for f in fixed.INCIDENT_FIELDS_SKIPNULL]
_P1_SQL_PARTS = ", ".join(
    (f"coalesce({f}, '')" if f in ("u_subcategory_2", "short_description", "description") else "''")
    for f in _P1_FIELDS)


@register("unify_text_skipnull", W + f"""
SELECT number, {to_sql(f"concat_ws(' ', {_P1_SQL_PARTS})", tx.NFKC_STEPS)} AS text FROM tickets
""")
def q_unify_text_skipnull(spark, sf):
    return pj.unify_text_skipnull(_t(spark, sf)).select("number", "text")


@register("normalize_nfkc", W + f"""
SELECT number, {to_sql("coalesce(description, '')", tx.NFKC_STEPS)} AS nfkc FROM tickets
""")
def q_normalize_nfkc(spark, sf):
    return _t(spark, sf).select("number", tx.normalize_nfkc(F.col("description")).alias("nfkc"))


@register("fold_ascii", W + f"""
SELECT number, {to_sql("description", tx.FOLD_STEPS)} AS folded FROM tickets
""")
def q_fold_ascii(spark, sf):
    return _t(spark, sf).select("number", tx.fold_ascii(F.col("description")).alias("folded"))


# P2 + F5 + F11 ---------------------------------------------------------------
_P2_SQL = "concat_ws(' ', coalesce(short_description, ''), coalesce(description, ''), coalesce(u_subcategory, ''), coalesce(u_subcategory_2, ''))"


@register("unify_text_fill", W + f"SELECT number, {_P2_SQL} AS texto_unificado, {_P2_SQL} AS texto_unificado_raw FROM tickets")
def q_unify_text_fill(spark, sf):
    return pj.unify_text_fill(_t(spark, sf)).select("number", "texto_unificado", "texto_unificado_raw")


@register("clean_text", W + f"SELECT number, {tx.sql_clean_text(_P2_SQL)} AS texto_unificado FROM tickets")
def q_clean_text(spark, sf):
    t = pj.unify_text_fill(_t(spark, sf), raw_copy=None)
    return t.select("number", tx.clean_text(F.col("texto_unificado")).alias("texto_unificado"))


@register("stopword_filter", W + f"""
SELECT number, {tx.sql_remove_stopwords(tx.to_sql(tx.sql_mask_entities('description'), tx.BOILER_STEPS), tx.requirement_stopwords())} AS tokens_kept
FROM tickets
""")
def q_stopword_filter(spark, sf):
    t = _t(spark, sf)
    core = tx.strip_boilerplate(tx.mask_entities(F.col("description")))
    return t.select("number", tx.remove_stopwords(core, tx.requirement_stopwords()).alias("tokens_kept"))


# F3, F4, F9, F10 -----------------------------------------------------------
@register("normalize_group_key", W + f"""
SELECT number, {s_group_key('u_subcategory')} AS grp_key, {s_singular(s_group_key('u_subcategory'))} AS grp_key_singular,
       {s_group_key('category')} AS cat_key FROM tickets
""")
def q_normalize_group_key(spark, sf):
    t = _t(spark, sf)
    k = tx.normalize_group_key(F.col("u_subcategory"))
    return t.select("number", k.alias("grp_key"), tx.singularize_phrase(k).alias("grp_key_singular"),
                    tx.normalize_group_key(F.col("category")).alias("cat_key"))


@register("normalize_class", W + f"""
SELECT number, {tx.sql_normalize_class('clasificacion')} AS clase FROM tickets
""")
def q_normalize_class(spark, sf):
    return _t(spark, sf).select("number", tx.normalize_class(F.col("clasificacion")).alias("clase"))


@register("singularize_phrase", W + f"""
SELECT DISTINCT {s_group_key('grp')} AS key, {s_singular(s_group_key('grp'))} AS singular FROM group_members
""")
def q_singularize(spark, sf):
    g = b.group_members(spark, sf).select("grp").distinct()
    k = tx.normalize_group_key(F.col("grp"))
    return g.select(k.alias("key"), tx.singularize_phrase(k).alias("singular")).distinct()


@register("name_token_key", W + f"""
SELECT ord, {tx.sql_name_token_key('nombre')} AS token_key FROM users
""")
def q_name_token_key(spark, sf):
    return b.users(spark, sf).select("ord", tx.name_token_key(F.col("nombre")).alias("token_key"))


# F6, F7, F8, F14, P14 --------------------------------------------------------
@register("mask_entities", W + f"SELECT number, {tx.sql_mask_entities('description')} AS desc_norm FROM tickets")
def q_mask_entities(spark, sf):
    return _t(spark, sf).select("number", tx.mask_entities(F.col("description")).alias("desc_norm"))


@register("strip_boilerplate", W + f"""
SELECT number, {to_sql(tx.sql_mask_entities('description'), tx.BOILER_STEPS)} AS desc_core FROM tickets
""")
def q_strip_boilerplate(spark, sf):
    return _t(spark, sf).select("number", tx.strip_boilerplate(tx.mask_entities(F.col("description"))).alias("desc_core"))


_DCORE = to_sql(tx.sql_mask_entities('description'), tx.BOILER_STEPS)
_SCORE = to_sql(tx.sql_mask_entities('short_description'), tx.BOILER_STEPS)


@register("choose_text", W + f"""
SELECT number, {tx.sql_tokens_count(_DCORE)} AS desc_tokens, {tx.sql_tokens_count(_SCORE)} AS short_tokens,
       {tx.sql_choose_text(_DCORE, _SCORE)} AS final_text
FROM tickets
""")
def q_choose_text(spark, sf):
    t = _t(spark, sf)
    d = tx.strip_boilerplate(tx.mask_entities(F.col("description")))
    s = tx.strip_boilerplate(tx.mask_entities(F.col("short_description")))
    return (t.select("number", d.alias("d"), s.alias("s"))
             .select("number", tx.tokens_count(F.col("d")).alias("desc_tokens"),
                     tx.tokens_count(F.col("s")).alias("short_tokens"),
                     tx.choose_text(F.col("d"), F.col("s")).alias("final_text")))


@register("empty_text_to_review", W + f"""
SELECT number, CASE WHEN coalesce(ft, '') = '' THEN 'revision' ELSE coalesce(clasificacion, 'sin_clasificar') END AS clase
FROM (SELECT number, clasificacion, {tx.sql_choose_text(_DCORE, _SCORE)} AS ft FROM tickets)
""")
def q_empty_text_to_review(spark, sf):
    t = _t(spark, sf)
    d = tx.strip_boilerplate(tx.mask_entities(F.col("description")))
    s = tx.strip_boilerplate(tx.mask_entities(F.col("short_description")))
    ft = tx.choose_text(d, s)
    return t.select("number", pj.empty_text_to_review(ft, F.coalesce("clasificacion", F.lit("sin_clasificar"))).alias("clase"))


# P3, P4, P5, P8, P9, P10 -----------------------------------------------------
_LABEL_SQL = ("CASE WHEN lbl IS NULL OR lbl IN " + s_list(fixed.PLACEHOLDER_CLASSES) + " THEN 'sin_clasificar' ELSE lbl END")


def _plural_sql(e):
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in fixed.PLURAL_TO_SINGULAR.items())
    return f"CASE {e} {cases} ELSE {e} END"


_REPAIRED = _LABEL_SQL.replace("lbl", f"({_plural_sql(tx.sql_normalize_class('clasificacion'))})")


@register("repair_labels", W + f"SELECT number, {_REPAIRED} AS clase FROM tickets")
def q_repair_labels(spark, sf):
    return _t(spark, sf).select("number", pj.repair_labels(F.col("clasificacion")).alias("clase"))


@register("drop_classes", W + f"""
SELECT number, clase FROM (SELECT number, {_REPAIRED} AS clase FROM tickets)
WHERE NOT coalesce(clase IN ('cheque', 'garantia'), false)
""")
def q_drop_classes(spark, sf):
    t = _t(spark, sf).select("number", pj.repair_labels(F.col("clasificacion")).alias("clase"))
    return pj.drop_classes(t, "clase", ("cheque", "garantia"))


@register("split_labelled", W + f"""
SELECT CASE WHEN clase <> 'sin_clasificar' THEN 'labelled' ELSE 'unlabelled' END AS part, count(*) AS n
FROM (SELECT {_REPAIRED} AS clase FROM tickets) GROUP BY 1
""")
def q_split_labelled(spark, sf):
    t = _t(spark, sf).select(pj.repair_labels(F.col("clasificacion")).alias("clase"))
    lab, unl = pj.split_labelled(t, "clase")
    return (lab.select(F.lit("labelled").alias("part")).unionByName(unl.select(F.lit("unlabelled").alias("part")))
            .groupBy("part").agg(F.count(F.lit(1)).alias("n")))


@register("filter_min_length", W + f"""
SELECT number, text, lbl FROM (
  SELECT number, {to_sql(f"concat_ws(' ', {_P1_SQL_PARTS})", tx.NFKC_STEPS)} AS text,
         {s_strip(f"coalesce(clasificacion, '{fixed.UNKNOWN_LABEL}')")} AS lbl FROM tickets)
WHERE length(text) > 3 AND length(lbl) > 0
""")
def q_filter_min_length(spark, sf):
    t = pj.unify_text_skipnull(_t(spark, sf)).withColumn("lbl", pj.default_label(F.col("clasificacion")))
    return pj.filter_min_length(t, "text", "lbl", 3).select("number", "text", "lbl")


@register("fill_from_other_column", W + "SELECT number, coalesce(clasificacion, u_subcategory) AS app FROM tickets")
def q_fill_from_other(spark, sf):
    t = _t(spark, sf)
    return t.select("number", pj.fill_from_other_column(F.col("clasificacion"), F.col("u_subcategory")).alias("app"))


# P11, P15-P17, A20 -------------------------------------------------------------
@register("drop_null_keys", W + f"""
SELECT number, assigned_to FROM history
WHERE number IS NOT NULL AND assigned_to IS NOT NULL AND {s_strip('assigned_to')} <> '' AND lower({s_strip('assigned_to')}) <> 'nan'
""")
def q_drop_null_keys(spark, sf):
    return pj.drop_null_keys(b.history(spark, sf), "number", "assigned_to").select("number", "assigned_to")


_RULE_SQL = (f"(coalesce({s_strip('category')} = {sql_str(fixed.SHIFT_RULE_CATEGORY)}, false) OR "
             f"coalesce({s_strip('u_subcategory')} = {sql_str(fixed.SHIFT_RULE_SUBCATEGORY)}, false) OR "
             f"coalesce({s_strip('contact_type')} = {sql_str(fixed.SHIFT_RULE_CONTACT)}, false))")


@register("shift_rule_flag", W + f"""
SELECT number, {_RULE_SQL} AS is_shift_rule,
       coalesce(clasificacion IN {s_list(fixed.SHIFT_CLASSES)}, false) AS is_shift_class,
       CASE WHEN {_RULE_SQL} THEN 'turno' ELSE clasificacion END AS clase
FROM tickets
""")
def q_shift_rule_flag(spark, sf):
    t = _t(spark, sf)
    flag = pj.shift_rule_flag(t)
    return t.select("number", flag.alias("is_shift_rule"),
                    pj.shift_class_flag(F.col("clasificacion")).alias("is_shift_class"),
                    pj.overwrite_class_turno(flag, F.col("clasificacion")).alias("clase"))


@register("shift_rule_counts", W + f"""
SELECT count(*) FILTER (WHERE coalesce({s_strip('category')} = {sql_str(fixed.SHIFT_RULE_CATEGORY)}, false)) AS by_category,
       count(*) FILTER (WHERE coalesce({s_strip('u_subcategory')} = {sql_str(fixed.SHIFT_RULE_SUBCATEGORY)}, false)) AS by_subcategory,
       count(*) FILTER (WHERE coalesce({s_strip('contact_type')} = {sql_str(fixed.SHIFT_RULE_CONTACT)}, false)) AS by_contact,
       count(*) FILTER (WHERE {_RULE_SQL}) AS any_rule, count(*) AS total
FROM tickets
""")
def q_shift_rule_counts(spark, sf):
    t = _t(spark, sf)
    st = lambda c: tx.to_column(F.col(c), [tx.strip()])
    return t.agg(
        F.count_if(F.coalesce(st("category") == fixed.SHIFT_RULE_CATEGORY, F.lit(False))).alias("by_category"),
        F.count_if(F.coalesce(st("u_subcategory") == fixed.SHIFT_RULE_SUBCATEGORY, F.lit(False))).alias("by_subcategory"),
        F.count_if(F.coalesce(st("contact_type") == fixed.SHIFT_RULE_CONTACT, F.lit(False))).alias("by_contact"),
        F.count_if(pj.shift_rule_flag(t)).alias("any_rule"),
        F.count(F.lit(1)).alias("total"))


# P12, P18, P19, P22, P24, F12, F13, F15, F16, F27-F30 ----------------------------
@register("align_output_columns", W + """
SELECT number, clasificacion AS "Clasificación", u_subcategory AS assigned_to,
       u_subcategory AS predicted_assigned_to, clasificacion AS predicted_assignment_group FROM tickets
""")
def q_align_output(spark, sf):
    t = _t(spark, sf).select("number", F.col("clasificacion").alias("Clasificación"),
                             F.col("u_subcategory").alias("assigned_to"), F.col("description").alias("desc_norm"))
    t = pj.prune_columns_by_pattern(t)
    return pj.align_output_columns(t, "Clasificación")


@register("sample_n", W + """
SELECT number FROM tickets ORDER BY sha256('42|' || CAST(ord AS VARCHAR)), ord LIMIT 25
""")
def q_sample_n(spark, sf):
    return pj.sample_n(_t(spark, sf).select("number", "ord"), 25, "ord").select("number")


@register("synthesize_id", W + """
SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS VARCHAR) AS number, u_subcategory FROM tickets
""")
def q_synthesize_id(spark, sf):
    return pj.synthesize_id(_t(spark, sf).select("ord", "u_subcategory"), ["ord"]).select("number", "u_subcategory")


@register("case_trim_state", W + f"""
SELECT number, array_to_string(list_transform(string_split({s_strip('state')}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS state_title,
       upper({s_strip('assigned_to')}) AS key_upper,
       lower({s_strip('assigned_to')}) AS key_lower FROM history
""")
def q_case_trim_state(spark, sf):
    h = b.history(spark, sf)
    st = pj.case_trim_state(F.col("state"))
    a = tx.to_column(F.col("assigned_to"), [tx.strip()])
    return h.select("number", st.alias("state_title"), F.upper(a).alias("key_upper"), F.lower(a).alias("key_lower"))


@register("format_report_line", W + """
SELECT number, CASE WHEN length(substr(short_description, 1, 60)) >= 60 THEN substr(short_description, 1, 60)
                    ELSE rpad(substr(short_description, 1, 60), 60, ' ') END AS desc60,
       CASE WHEN length(CAST(ord AS VARCHAR)) >= 5 THEN CAST(ord AS VARCHAR) ELSE lpad(CAST(ord AS VARCHAR), 5, ' ') END AS ord5
FROM tickets
""")
def q_format_report_line(spark, sf):
    t = _t(spark, sf)
    return t.select("number", pj.format_report_line(F.col("short_description"), 60, truncate=60).alias("desc60"),
                    pj.format_report_line(F.col("ord").cast("string"), 5, right=True).alias("ord5"))


@register("extract_version", W + """
SELECT url, CASE WHEN regexp_extract(url, '(?i)_v(\\d+)\\.csv$', 1) = '' THEN 0
                 ELSE CAST(regexp_extract(url, '(?i)_v(\\d+)\\.csv$', 1) AS BIGINT) END AS version
FROM (SELECT page_id, url || '_v' || CAST(page_id % 7 AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.CSV' ELSE '.txt' END AS url FROM pages)
""")
def q_extract_version(spark, sf):
    p = b.read_table(spark, sf, "pages")
    u = F.concat(F.col("url"), F.lit("_v"), (F.col("page_id") % 7).cast("string"),
                 F.when(F.col("page_id") % 2 == 0, F.lit(".CSV")).otherwise(F.lit(".txt")))
    return p.select(u.alias("url")).select("url", pj.extract_version(F.col("url")).alias("version"))


_BASE = "https://tickets.example.org"


@register("build_export_url", W + f"""
SELECT page_id, CASE WHEN u IS NULL OR u = '' THEN NULL
  WHEN upper(f) LIKE '%CSV%' THEN f
  WHEN f LIKE '%?%' AND f LIKE '%&' THEN f || 'CSV'
  WHEN f LIKE '%?%' THEN f || '&CSV' ELSE f || '?CSV' END AS export_url
FROM (SELECT page_id, u, CASE WHEN starts_with(u, 'http') THEN u ELSE '{_BASE}/' || regexp_replace(u, '^/+', '') END AS f
      FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/incident_list.do?sysparm_query=active' ELSE 'sc_req_item_list.do' END AS u FROM pages))
""")
def q_build_export_url(spark, sf):
    p = b.read_table(spark, sf, "pages")
    u = (F.when(F.col("page_id") % 3 == 0, F.col("url"))
          .when(F.col("page_id") % 3 == 1, F.lit("/incident_list.do?sysparm_query=active"))
          .otherwise(F.lit("sc_req_item_list.do")))
    return p.select("page_id", pj.build_export_url(u, _BASE).alias("export_url"))


@register("regex_flag", W + """
SELECT number, regexp_matches(coalesce(clasificacion, 'sin_clasificar') || ', x', '\\bsin_clasificar\\b') AS has_unclassified FROM tickets
""")
def q_regex_flag(spark, sf):
    t = _t(spark, sf)
    return t.select("number", F.concat(F.coalesce("clasificacion", F.lit("sin_clasificar")), F.lit(", x"))
                    .rlike(r"\bsin_clasificar\b").alias("has_unclassified"))


@register("map_lookup_default", W + f"""
SELECT number, CASE u_subcategory_2 WHEN 'es' THEN 'Español' WHEN 'en' THEN 'Inglés' ELSE 'otro' END AS idioma FROM tickets
""")
def q_map_lookup_default(spark, sf):
    m = F.create_map(F.lit("es"), F.lit("Español"), F.lit("en"), F.lit("Inglés"))
    t = _t(spark, sf)
    return t.select("number", F.coalesce(F.element_at(m, F.col("u_subcategory_2")), F.lit("otro")).alias("idioma"))
