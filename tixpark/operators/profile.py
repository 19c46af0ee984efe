"""Profiling aggregates.

All profiles are single-pass aggregations with partial (map-side) combine;
only one-row metric tables reach the driver, for decisions about which
columns to profile further.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def class_distribution(df: DataFrame, c: str, out: str = "n") -> DataFrame:
    """A1 + F27: count per class (nulls included), share of all rows, descending."""
    g = df.groupBy(c).agg(F.count(F.lit(1)).alias(out))
    total = df.select(F.count(F.lit(1))).scalar()
    return (g.withColumn("pct", F.round(F.col(out) * 100.0 / total, 4))
             .orderBy(F.desc(out), F.asc_nulls_first(c)))


def _long(df: DataFrame, exprs: dict, names=("column", "value")) -> DataFrame:
    row = df.agg(*[e.alias(k) for k, e in exprs.items()])
    return row.unpivot([], list(exprs), names[0], names[1])


def null_profile(df: DataFrame, top: int | None = 15) -> DataFrame:
    """A2: null count and share per column, most nulls first (ties by name)."""
    n = df.select(F.count(F.lit(1))).scalar()
    cols = [c for c in df.columns]
    exprs = {c: F.count_if(F.col(f"`{c}`").isNull()).cast("bigint") for c in cols}
    x = _long(df, exprs, ("column", "nulls"))
    x = x.withColumn("null_pct", F.round(F.col("nulls") * 100.0 / F.greatest(n, F.lit(1)), 4))
    x = x.orderBy(F.desc("nulls"), "column")
    return x.limit(top) if top else x


def distinct_profile(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A3: distinct non-null values per column (``approx_count_distinct`` at scale)."""
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    exprs = {c: f(F.col(f"`{c}`")).cast("bigint") for c in df.columns}
    return _long(df, exprs, ("column", "n_distinct"))


def non_null_types(df: DataFrame) -> DataFrame:
    """A4: non-null count and type per column (``info``)."""
    exprs = {c: F.count(F.col(f"`{c}`")).cast("bigint") for c in df.columns}
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return _long(df, exprs, ("column", "non_null")).withColumn("dtype", F.element_at(types, F.col("column")))


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """A5: rows equal (on all ``cols``) to an earlier row: one total, one per group."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                 F.count(F.lit(1)).alias("repeated_groups"))


def crosstab_long(df: DataFrame, cols, class_col: str, min_values: int = 2, max_values: int = 24) -> DataFrame:
    """(column, value, class, n) for categorical columns with 2..24 distinct values.

    The column choice needs one small metric row; the contingency table itself
    is one aggregation over an exploded (column, value) pair per row.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, value string, clase string, n bigint")
    nd = df.agg(*[F.count_distinct(c).alias(c) for c in present]).first().asDict()
    keep = [c for c in present if min_values <= nd[c] <= max_values]
    if not keep:
        return df.sparkSession.createDataFrame([], "column string, value string, clase string, n bigint")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in keep]))
    x = df.select(pairs.alias("p"), F.col(class_col).alias("clase")).select("p.column", "p.value", "clase")
    return x.groupBy("column", "value", "clase").agg(F.count(F.lit(1)).alias("n"))


def numeric_by_class(df: DataFrame, class_col: str, value_col: str, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """Min, quartiles, max per class.

    Exact ``percentile`` keeps a value->count map per group (bounded by the
    distinct values, merged map-side); ``approx=True`` uses a fixed-size sketch.
    """
    v = F.col(value_col).cast("double")
    if approx:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
    else:
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (df.groupBy(class_col)
              .agg(F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"), F.count(v).alias("n"))
              .select(class_col, "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                      F.col("_q")[2].alias("q3"), "max"))


def f_tail(f: float | None, between: int, within: int) -> float | None:
    """P(F >= f) for ``between`` and ``within`` degrees of freedom: the regularised incomplete beta function
    I_x(within / 2, between / 2) at x = within / (within + between f), by its continued fraction."""
    if f is None or math.isnan(f):
        return None
    if math.isinf(f) or f <= 0:
        return 0.0 if f > 0 else 1.0
    a, b, x = within / 2, between / 2, within / (within + between * f)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, between * f / (within + between * f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    value = front * total
    return 1 - value if swap else value


def anova_by_class(df: DataFrame, class_col: str, value_col: str) -> DataFrame:
    """One-way ANOVA F over the classes with more than one value (closed form) and its p-value;
    the tail is evaluated on the one result row."""
    v = F.col(value_col).cast("double")
    g = (df.filter(v.isNotNull()).groupBy(class_col)
           .agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.avg(v).alias("m"))
           .filter("n > 1"))
    cls = g.select(F.col(class_col).alias("_c"), "m")
    x = df.filter(v.isNotNull()).join(cls, df[class_col] == cls["_c"])
    within = x.agg(F.sum((v - F.col("m")) * (v - F.col("m"))).alias("ssw"))
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum("s") / F.sum("n")).alias("gm"))
    between = g.join(tot.select("gm"), how="left").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"))
    r = tot.join(within, how="left").join(between, how="left")
    r = r.select(F.lit(value_col).alias("column"), F.col("k").alias("n_classes"), F.col("N").alias("n_rows"),
                    F.when((F.col("k") > 1) & (F.col("N") > F.col("k")) & (F.col("ssw") > 0),
                           (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("N") - F.col("k"))))
                    .alias("f_stat"))
    tail = F.udf(f_tail, "double")
    return r.withColumn("p_value", tail("f_stat", F.col("n_classes") - 1, F.col("n_rows") - F.col("n_classes")))


def informative_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """P20 + P21: distinct count per column, numeric flag, and
    ``1 < nunique < 0.9 n`` with a name not starting with ``id``."""
    n = df.select(F.count(F.lit(1))).scalar()
    d = distinct_profile(df, approx)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return (d.withColumn("is_numeric", F.col("column").isin(numeric))
             .withColumn("informative", (F.col("n_distinct") > 1) & (F.col("n_distinct") < n * 0.9)
                         & ~F.lower(F.col("column")).startswith("id")))
