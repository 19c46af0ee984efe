"""Dimension lookups: group sheet, users, canonical names, shifts.

Dimension tables (users, group members, calendar) are small relative to the
ticket and history facts, but they still grow with the organisation, so no
explicit broadcast is forced here: Spark's planner broadcasts them when their
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
re-plans from runtime sizes, falling back to a shuffle join otherwise.  Fact
tables are reduced to distinct keys before they meet a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import (WS, normalize_group_key, name_token_key, singularize_phrase,
                              to_column, strip)


def pystrip(c: Column) -> Column:
    """Python ``str.strip()`` (whitespace set of Latin-1)."""
    return to_column(c, [strip()])


def unpivot_groups(sheet: DataFrame, group_columns: list[str] | None = None) -> DataFrame:
    """Wide group sheet -> (grp, grp_order, member, level).

    Group = header stripped + upper; member = cell stripped + upper; empty and
    ``NAN`` are skipped; ``grp_order`` keeps the sheet's column order.
    """
    cols = group_columns or [c for c in sheet.columns if c != "row_in_sheet"]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grp_order"),
                 F.lit(c.strip().upper()).alias("grp"),
                 F.col(f"`{c}`").cast("string").alias("cell"))
        for i, c in enumerate(cols) if c.strip() and c.strip().upper() != "NAN"]))
    x = sheet.select(pairs.alias("p")).select("p.grp_order", "p.grp", F.upper(pystrip(F.col("p.cell"))).alias("member"))
    return (x.filter(F.col("member").isNotNull() & (F.col("member") != "") & (F.col("member") != "NAN"))
             .withColumn("level", F.lit(1)))


def prepare_users(users: DataFrame, username: str = "usuario", name: str = "nombre",
                  status: str = "estado", order: str = "ord") -> DataFrame:
    """Valid user rows with upper-cased keys, token key and active flag."""
    u = users.select(
        F.upper(pystrip(F.col(username))).alias("username"),
        F.upper(pystrip(F.col(name))).alias("realname"),
        F.col(status).alias("status"),
        F.col(order).alias("uord"))
    u = u.filter(F.col("username").isNotNull() & F.col("realname").isNotNull()
                 & (F.col("username") != "") & (F.col("realname") != ""))
    return u.select("username", "realname", "uord",
                    name_token_key(F.col("realname")).alias("token_key"),
                    (F.col("status").isNull() | (pystrip(F.col("status")) == "1")).alias("active"))


def user_directory(users_prepared: DataFrame) -> DataFrame:
    """username -> (realname of the last row, active if any row is active)."""
    return users_prepared.groupBy("username").agg(
        F.max_by("realname", "uord").alias("realname"),
        F.max(F.col("active").cast("int")).cast("boolean").alias("active"))


def token_directory(users_prepared: DataFrame) -> DataFrame:
    """sorted-name-token key -> username of the last row holding it."""
    return (users_prepared.filter(F.col("token_key") != "")
            .groupBy("token_key").agg(F.max_by("username", "uord").alias("tk_username")))


def canonical_assignee(df: DataFrame, col: str, users_prepared: DataFrame,
                       out: str = "canonical") -> DataFrame:
    """Username match, else sorted-token name match, else the upper-cased input.

    Applied to the *distinct* values of ``col`` and joined back, so a fact table
    never shuffles against the user table row by row.
    """
    names = df.select(F.col(col).alias("_raw")).distinct()
    up = F.upper(pystrip(F.col("_raw")))
    names = names.withColumn("_up", up).withColumn("_tk", name_token_key(F.col("_up")))
    dir_u = user_directory(users_prepared).select(F.col("username").alias("_u"))
    dir_t = token_directory(users_prepared)
    names = (names.join(dir_u, names["_up"] == dir_u["_u"], "left")
                  .join(dir_t, names["_tk"] == dir_t["token_key"], "left"))
    mapping = names.select("_raw", F.coalesce("_u", "tk_username", "_up").alias(out))
    return df.join(mapping, df[col].eqNullSafe(mapping["_raw"]), "left").drop("_raw")


def any_active(users_prepared: DataFrame) -> Column:
    """Scalar: is at least one user active?  (guard of J6)."""
    return users_prepared.select(F.coalesce(F.max(F.col("active").cast("int")), F.lit(0)) > 0).scalar()


def active_filter(df: DataFrame, canonical_col: str, users_prepared: DataFrame,
                  out: str = "is_active") -> DataFrame:
    """Active if the canonical name is an active username; everyone when nobody is."""
    act = (user_directory(users_prepared).filter("active")
           .select(F.col("username").alias("_act_u"), F.lit(True).alias("_act")))
    j = df.join(act, df[canonical_col] == act["_act_u"], "left")
    return j.withColumn(out, F.when(~any_active(users_prepared), F.lit(True))
                        .otherwise(F.coalesce(F.col("_act"), F.lit(False)))).drop("_act_u", "_act")


def display_name(df: DataFrame, canonical_col: str, users_prepared: DataFrame,
                 out: str = "display_name") -> DataFrame:
    """Username -> real name, else itself."""
    d = user_directory(users_prepared).select(F.col("username").alias("_dn_u"), F.col("realname").alias("_dn"))
    j = df.join(d, df[canonical_col] == d["_dn_u"], "left")
    return j.withColumn(out, F.coalesce("_dn", canonical_col)).drop("_dn_u", "_dn")


def class_group_keys(members: DataFrame) -> DataFrame:
    """Keys of the class -> group map: normalised header and its singular, sheet order."""
    g = members.select("grp", "grp_order").distinct()
    norm = normalize_group_key(F.col("grp"))
    a = g.select(norm.alias("key"), "grp", "grp_order", F.lit(0).alias("variant"))
    b = g.select(singularize_phrase(norm).alias("key"), "grp", "grp_order", F.lit(1).alias("variant"))
    keys = a.unionByName(b).filter(F.col("key") != "")
    # a later sheet column overwrites an earlier one for the same key (dict semantics);
    # insertion order of a key is its first appearance.
    w = Window.partitionBy("key")
    return (keys.withColumn("first_pos", F.min(F.col("grp_order") * 2 + F.col("variant")).over(w))
                .withColumn("last_grp", F.max_by("grp", F.col("grp_order") * 2 + F.col("variant")).over(w))
                .select("key", F.col("last_grp").alias("grp"), "first_pos").distinct())


def class_to_group(classes: DataFrame, class_col: str, members: DataFrame, out: str = "grp") -> DataFrame:
    """J2 + J3 on the distinct classes: exact key, singular key, else containment.

    The containment (theta) join runs on distinct class values against the
    sheet's keys only -- both bounded by the label and group domains.
    """
    keys = class_group_keys(members)
    dc = classes.select(F.col(class_col).alias("_cls")).distinct().filter(F.col("_cls").isNotNull())
    dc = dc.withColumn("_norm", normalize_group_key(F.col("_cls"))).withColumn("_sing", singularize_phrase(F.col("_norm")))
    k1 = keys.select(F.col("key").alias("_k1"), F.col("grp").alias("_g1"))
    k2 = keys.select(F.col("key").alias("_k2"), F.col("grp").alias("_g2"))
    k3 = keys.select(F.col("key").alias("_k3"), F.col("grp").alias("_g3"), F.col("first_pos").alias("_p3"))
    x = dc.join(k1, dc["_norm"] == k1["_k1"], "left").join(k2, dc["_sing"] == k2["_k2"], "left")
    contains = x.join(k3, (F.col("_norm") == F.col("_k3")) | F.instr(F.col("_k3"), F.col("_norm")).__gt__(0)
                      | F.instr(F.col("_norm"), F.col("_k3")).__gt__(0), "left")
    best = contains.groupBy("_cls", "_g1", "_g2").agg(F.min_by("_g3", "_p3").alias("_g3"))
    mapping = best.select("_cls", F.coalesce("_g1", "_g2", "_g3").alias(out))
    return classes.join(mapping, classes[class_col].eqNullSafe(mapping["_cls"]), "left").drop("_cls")


def group_candidates(members: DataFrame, users_prepared: DataFrame) -> DataFrame:
    """Distinct (grp, member) with canonical name and active flag."""
    m = members.select("grp", "grp_order", "member", "level").dropDuplicates(["grp", "member"])
    m = canonical_assignee(m, "member", users_prepared, out="member_key")
    return active_filter(m, "member_key", users_prepared)


def primary_group(df: DataFrame, name_col: str, groups: DataFrame, name: str = "NOMBRE",
                  group: str = "GRUPO 1", out: str = "predicted_assignment_group",
                  order_col: str | None = None) -> DataFrame:
    """Person -> primary group; ``TURNO`` passes; otherwise ``NO GROUP FOUND``."""
    g = groups.select(F.upper(pystrip(F.col(f"`{name}`").cast("string"))).alias("_pg_name"),
                      pystrip(F.col(f"`{group}`").cast("string")).alias("_pg_grp"),
                      (F.col(order_col) if order_col else F.monotonically_increasing_id()).alias("_pg_ord"))
    g = g.filter(F.col("_pg_name").isNotNull() & (F.col("_pg_name") != "") & (F.lower("_pg_name") != "nan"))
    g = g.withColumn("_pg_grp", F.when(F.col("_pg_grp").isNull() | (F.col("_pg_grp") == "")
                                       | (F.lower("_pg_grp") == "nan"), F.lit(fixed.NO_GROUP_FOUND))
                     .otherwise(F.col("_pg_grp")))
    g = g.groupBy("_pg_name").agg(F.max_by("_pg_grp", "_pg_ord").alias("_pg_grp"))
    key = F.upper(pystrip(F.col(name_col)))
    x = df.withColumn("_pg_key", key)
    x = x.join(g, x["_pg_key"] == g["_pg_name"], "left")
    return (x.withColumn(out, F.when(F.col(name_col).isNull(), F.lit(fixed.NO_GROUP_FOUND))
                         .when(F.col("_pg_key") == fixed.TURNO, F.lit(fixed.TURNO))
                         .otherwise(F.coalesce("_pg_grp", F.lit(fixed.NO_GROUP_FOUND))))
             .drop("_pg_key", "_pg_name", "_pg_grp"))


def assignee_sys_id(df: DataFrame, name_col: str, users: DataFrame, name: str = "nombre",
                    username: str = "usuario", sys_id: str = "sys_id", out: str = "sys_id") -> DataFrame:
    """Real name (upper) or username (lower) -> external id, else ''."""
    u = users.select(F.upper(pystrip(F.col(name))).alias("_sn"), F.lower(pystrip(F.col(username))).alias("_su"),
                     pystrip(F.col(sys_id)).alias("_sid"), F.col("ord").alias("_so"))
    u = u.filter(F.col("_sid").isNotNull() & (F.col("_sid") != ""))
    by_name = u.filter(F.col("_sn").isNotNull() & (F.col("_sn") != "")).groupBy("_sn").agg(F.max_by("_sid", "_so").alias("_sid_n"))
    by_user = u.filter(F.col("_su").isNotNull() & (F.col("_su") != "")).groupBy("_su").agg(F.max_by("_sid", "_so").alias("_sid_u"))
    x = (df.withColumn("_kn", F.upper(pystrip(F.col(name_col)))).withColumn("_ku", F.lower(pystrip(F.col(name_col)))))
    x = x.join(by_name, x["_kn"] == by_name["_sn"], "left").join(by_user, x["_ku"] == by_user["_su"], "left")
    return x.withColumn(out, F.coalesce("_sid_n", "_sid_u", F.lit(""))).drop("_kn", "_ku", "_sn", "_su", "_sid_n", "_sid_u")
