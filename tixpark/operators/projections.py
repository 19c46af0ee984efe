"""Projections, filters and predicates over ticket frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from .ranking import two_level_rank
from ..functions.text import normalize_class, normalize_nfkc, to_column, strip


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """A missing column reads as ``default``."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default).cast("string")


def first_available_column(df: DataFrame, candidates) -> str | None:
    """First candidate name that exists (resolved on the schema, Q9)."""
    return next((c for c in candidates if c in df.columns), None)


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Fail before planning when needed columns are absent."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def unify_text_skipnull(df: DataFrame, fields=fixed.INCIDENT_FIELDS_SKIPNULL, out: str = "text") -> DataFrame:
    """Join fields with blanks, nulls skipped, then F1."""
    parts = [col_or(df, f, "") for f in fields]
    return df.withColumn(out, normalize_nfkc(F.concat_ws(" ", *parts)))


def unify_text_fill(df: DataFrame, fields=fixed.INCIDENT_FIELDS_FILL, out: str = "texto_unificado",
                    raw_copy: str | None = "texto_unificado_raw") -> DataFrame:
    """Join fields with blanks, null -> ''; optional raw copy."""
    x = df.withColumn(out, F.concat_ws(" ", *[F.coalesce(col_or(df, f), F.lit("")) for f in fields]))
    return x.withColumn(raw_copy, F.col(out)) if raw_copy else x


def filter_min_length(df: DataFrame, text: str, label: str | None = None, min_len: int = 3) -> DataFrame:
    """``len(text) > min_len`` and, when given, ``len(label) > 0``."""
    cond = F.coalesce(F.length(text), F.lit(0)) > min_len
    if label:
        cond = cond & (F.coalesce(F.length(label), F.lit(0)) > 0)
    return df.filter(cond)


def default_label(c: Column, default: str = fixed.UNKNOWN_LABEL) -> Column:
    """Null -> default, then Python-strip."""
    return to_column(F.coalesce(c, F.lit(default)), [strip()])


def fill_from_other_column(a: Column, b: Column) -> Column:
    """P5: intended fill of a null column from another (decision Q3)."""
    return F.coalesce(a, b)


def rename_class_column(df: DataFrame, target: str = "Clasificación",
                        sources=("Categoría", "clasificacion", "Clasificacion")) -> DataFrame:
    """Rename the first existing class column to ``target``."""
    src = first_available_column(df, sources)
    return df.withColumnRenamed(src, target) if src and target not in df.columns else df


def value_map_replace(c: Column, mapping=fixed.PLURAL_TO_SINGULAR) -> Column:
    """Exact-value replacement through a literal map (fixed, 12 entries)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def placeholder_to_unclassified(c: Column, placeholders=fixed.PLACEHOLDER_CLASSES,
                                unclassified: str = fixed.UNCLASSIFIED) -> Column:
    """Placeholders and null -> ``sin_clasificar``."""
    return F.when(c.isNull() | c.isin(list(placeholders)), F.lit(unclassified)).otherwise(c)


def drop_classes(df: DataFrame, c: str, classes=fixed.RARE_CLASSES) -> DataFrame:
    """Remove listed classes; null rows are kept (pandas ``~isin``)."""
    return df.filter(~F.coalesce(F.col(c).isin(list(classes)), F.lit(False)))


def repair_labels(c: Column) -> Column:
    """F4 -> P7 -> P8 in the notebook's order."""
    return placeholder_to_unclassified(value_map_replace(normalize_class(c)))


def split_labelled(df: DataFrame, c: str, unclassified: str = fixed.UNCLASSIFIED):
    """P10: (labelled, unlabelled) -- two filters over one frame."""
    return df.filter(F.col(c) != unclassified), df.filter(F.col(c) == unclassified)


def drop_null_keys(df: DataFrame, id_col: str, assignee_col: str) -> DataFrame:
    """Drop rows with null id/assignee and blank or ``nan`` assignees."""
    a = to_column(F.col(assignee_col), [strip()])
    return df.dropna(subset=[id_col, assignee_col]).filter((a != "") & (F.lower(a) != "nan"))


def prune_columns_by_pattern(df: DataFrame, suffixes=("_norm",), drop=()) -> DataFrame:
    """Drop working columns before writing."""
    return df.select([F.col(f"`{c}`") for c in df.columns
                      if not any(c.endswith(s) for s in suffixes) and c not in drop])


def empty_text_to_review(text: Column, pred: Column, review: str = fixed.REVIEW_CLASS) -> Column:
    """Class ``revision`` when the cleaned text is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(review)).otherwise(pred)


def _py_str_strip(c: Column) -> Column:
    # str(x).strip() of a null is 'nan'; only equality with the rule values matters
    return to_column(c, [strip()])


def shift_rule_flag(df: DataFrame) -> Column:
    """Category, subcategory or contact type says "shift"; absent/null -> false."""
    cat = _py_str_strip(col_or(df, "category")) == fixed.SHIFT_RULE_CATEGORY
    sub = _py_str_strip(col_or(df, "u_subcategory")) == fixed.SHIFT_RULE_SUBCATEGORY
    con = _py_str_strip(col_or(df, "contact_type")) == fixed.SHIFT_RULE_CONTACT
    return F.coalesce(cat, F.lit(False)) | F.coalesce(sub, F.lit(False)) | F.coalesce(con, F.lit(False))


def shift_class_flag(c: Column, classes=fixed.SHIFT_CLASSES) -> Column:
    """Predicted class is exactly one of the shift classes."""
    return F.coalesce(c.isin(list(classes)), F.lit(False))


def overwrite_class_turno(flag: Column, c: Column) -> Column:
    """P17."""
    return F.when(flag, F.lit(fixed.TURNO_CLASS)).otherwise(c)


def align_output_columns(df: DataFrame, class_col: str, assigned: str = "assigned_to") -> DataFrame:
    """predicted_* copies of the result columns."""
    return df.withColumns({"predicted_assigned_to": F.col(assigned),
                           "predicted_assignment_group": F.col(f"`{class_col}`")})


def tag_source_confidence(df: DataFrame, source: str, confidence=None, model: str | None = None) -> DataFrame:
    """Constant provenance columns."""
    cols = {"Fuente": F.lit(source)}
    if confidence is not None:
        cols["Confianza"] = F.lit(confidence)
    if model is not None:
        cols["Modelo_usado"] = F.lit(model)
    return df.withColumns(cols)


#: Rows of a numeric first order column that one task ranks.
ID_RUN = 100_000


def synthesize_id(df: DataFrame, order_cols, out: str = "number") -> DataFrame:
    """Row index (0-based) as id over a stable order when no id column exists."""
    if out in df.columns:
        return df
    run = F.coalesce(F.floor(F.col(order_cols[0]).cast("double") / ID_RUN), F.lit(-(1 << 60)))
    return two_level_rank(df, [], list(order_cols), run, "_rank").withColumn(out, (F.col("_rank") - 1).cast("string")).drop("_rank")


def sample_n(df: DataFrame, n: int, key: str, seed: int = fixed.SEED) -> DataFrame:
    """N seeded pseudo-random rows: top-n by sha256(seed|key) (TakeOrderedAndProject)."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def case_trim_state(c: Column) -> Column:
    """strip + title case."""
    return F.initcap(to_column(c, [strip()]))


def format_report_line(c: Column, width: int, right: bool = False, truncate: int | None = None) -> Column:
    """optional truncation then pad (never truncating on pad)."""
    if truncate is not None:
        c = F.substring(c, 1, truncate)
    pad = F.lpad if right else F.rpad
    return F.when(F.length(c) >= width, c).otherwise(pad(c, width, " "))


def extract_version(path: Column) -> Column:
    """``_v<N>.csv`` suffix (case-insensitive) -> N, else 0."""
    v = F.regexp_extract(path, r"(?i)_v(\d+)\.csv$", 1)
    return F.when(v == "", F.lit(0)).otherwise(v.cast("bigint"))


def build_export_url(url: Column, base_url: str) -> Column:
    """F16: relative export paths get the base URL; the ``CSV`` parameter is added
    (``?CSV``, ``&CSV`` or ``CSV`` after a trailing ``&``) unless present."""
    full = F.when(url.startswith("http"), url).otherwise(
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(url, "^/+", "")))
    return (F.when(url.isNull() | (url == ""), F.lit(None))
             .when(F.upper(full).contains("CSV"), full)
             .when(full.contains("?") & full.endswith("&"), F.concat(full, F.lit("CSV")))
             .when(full.contains("?"), F.concat(full, F.lit("&CSV")))
             .otherwise(F.concat(full, F.lit("?CSV"))))


def record_url(base: Column, table: str, number: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(f"/{table}.do?sysparm_query=number="), number)
