"""Duplicate texts, ambiguity and label repair.

Texts can be long (tens of KB), so groups are keyed by a SHA-256 digest of the
text (``text_key``) and the text itself rides along once per group.  Per-text
"first n ids" use ``row_number() <= n``, which Spark turns into a partial
window group limit before the shuffle, so a text repeated on a third of all
rows still moves only n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed


def text_key(c: Column) -> Column:
    return F.sha2(c, 256)


def with_text_key(df: DataFrame, text: str, out: str = "text_key") -> DataFrame:
    return df.withColumn(out, text_key(F.col(text)))


def first_n_per_group(df: DataFrame, key: str, order: str, n: int, value: str, out: str,
                      sep: str = ", ") -> DataFrame:
    """First n values per group in ``order``, joined (window group limit)."""
    w = Window.partitionBy(key).orderBy(order)
    top = df.select(key, order, value).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return top.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("string").alias("v")))),
                                 lambda s: s["v"]), sep).alias(out))


def flag_duplicates(df: DataFrame, text: str, out: str = "is_dup") -> DataFrame:
    """True on every member of a repeated text (count per key joined back)."""
    x = with_text_key(df, text, "_tk")
    cnt = x.groupBy("_tk").agg(F.count(F.lit(1)).alias("_n"))
    return x.join(cnt, "_tk").withColumn(out, F.col("_n") > 1).drop("_tk", "_n")


def duplicate_share(df: DataFrame, text: str) -> DataFrame:
    """W1 summary: duplicated rows, their share, distinct repeated texts."""
    x = with_text_key(df, text, "_tk").groupBy("_tk").agg(F.count(F.lit(1)).alias("n"))
    return x.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("dup_rows"),
                 F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("dup_share"),
                 F.count_if(F.col("n") > 1).alias("repeated_texts"))


def duplicate_text_summary(df: DataFrame, text: str, class_col: str, id_col: str, order: str,
                           n_examples: int = 4) -> DataFrame:
    """Per repeated text: tickets, sorted distinct classes joined, number of
    classes, first ``n_examples`` ids in row order."""
    x = with_text_key(df, text)
    g = (x.groupBy("text_key")
          .agg(F.first(text).alias(text), F.count(F.lit(1)).alias("n_tickets"),
               F.array_join(F.array_sort(F.collect_set(class_col)), ", ").alias("clasificaciones"),
               F.count_distinct(class_col).alias("n_clases"))
          .filter("n_tickets > 1"))
    ex = first_n_per_group(x.join(g.select("text_key"), "text_key", "left_semi"), "text_key", order,
                           n_examples, id_col, "ejemplos")
    return g.join(ex, "text_key")


def ambiguous_texts(summary: DataFrame, exclude_unclassified: bool = True) -> DataFrame:
    """A10: repeated texts with more than one class; optionally without ``sin_clasificar``."""
    a = summary.filter("n_clases > 1")
    if exclude_unclassified:
        a = a.filter(~F.col("clasificaciones").rlike(r"\b" + fixed.UNCLASSIFIED + r"\b"))
    return a


def semi_ambiguous_texts(df: DataFrame, text: str, ambiguous: DataFrame) -> DataFrame:
    """Rows whose text is in the ambiguous set (left semi join on the key)."""
    x = with_text_key(df, text)
    return x.join(ambiguous.select("text_key"), "text_key", "left_semi")


def majority_label(rows: DataFrame, class_col: str, order: str) -> DataFrame:
    """Most frequent class per text key, ties to the class seen first."""
    g = rows.groupBy("text_key", class_col).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    w = Window.partitionBy("text_key").orderBy(F.desc("_n"), F.asc("_f"))
    return (g.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
             .select("text_key", F.col(class_col).alias("majority")))


def apply_majority_label(df: DataFrame, text: str, class_col: str, majority: DataFrame) -> DataFrame:
    """Replace the class of rows whose text has a majority label."""
    x = with_text_key(df, text)
    return (x.join(majority, "text_key", "left")
             .withColumn(class_col, F.coalesce("majority", class_col)).drop("majority"))


def repair_ambiguous(df: DataFrame, text: str, class_col: str, order: str) -> DataFrame:
    """A9 -> A10 -> A11 -> J12 in one plan."""
    x = with_text_key(df, text)
    g = (x.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"),
                                   F.array_join(F.array_sort(F.collect_set(class_col)), ", ").alias("clasificaciones"),
                                   F.count_distinct(class_col).alias("n_clases"))
          .filter("n > 1"))
    amb = ambiguous_texts(g)
    rows = x.join(amb.select("text_key"), "text_key", "left_semi")
    maj = majority_label(rows, class_col, order)
    return apply_majority_label(df, text, class_col, maj).drop("text_key")


def verify_single_class(df: DataFrame, text: str, class_col: str) -> DataFrame:
    """Texts that still carry more than one class (must be empty after repair,
    except for the groups left alone because they contain ``sin_clasificar``, Q16)."""
    x = with_text_key(df, text)
    return (x.groupBy("text_key").agg(F.count_distinct(class_col).alias("n_clases"),
                                      F.array_join(F.array_sort(F.collect_set(class_col)), ", ").alias("clasificaciones"))
             .filter("n_clases > 1"))


def dedup_keep_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """First row per text (``min_by`` with map-side combine)."""
    x = with_text_key(df, text, "_tk")
    cols = [c for c in df.columns]
    first = x.groupBy("_tk").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.col(order)).alias("_r"))
    return first.select("_r.*")


def review_listing(df: DataFrame, text: str, class_col: str, id_col: str, ambiguous: DataFrame,
                   extras=("short_description", "description", "Subcategoría", "category", "subcategory")) -> DataFrame:
    """Rows of the ambiguous texts with base + existing extra columns, sorted by id."""
    base = [id_col, text, class_col]
    cols = base + [c for c in extras if c in df.columns and c not in base]
    rows = semi_ambiguous_texts(df, text, ambiguous)
    return rows.select(*[F.col(f"`{c}`") for c in cols]).orderBy(id_col)
