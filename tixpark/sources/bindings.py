"""Ticket-domain views derived from the driver's tables.

The test data holds no service-desk exports, so tickets, users, group
membership, assigned history and the shift calendar are derived from the
TPC-H-style tables with plain DataFrame operations.  Every derived table grows
with its sources.  The same definitions, in SQL, are in ``ORACLE_WITH`` for the
DuckDB oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed-size dimension: TPC-H nation is always 25 rows, so broadcasting it is bounded.
NATION_ROWS = 25

# Fixed values of the fixture: class and group names, shift names.
GROUP_BY_REGION = {0: "CHEQUE", 1: "CUENTAS", 2: "REPORTE ONLINE", 3: "GARANTIAS"}
GROUP_DEFAULT = "USUARIO"
SHIFT_NAMES = ["Turno 1", "Turno 2", "Turno 3", "Turno 4", "Stand-by"]
AS_OF = "2001-08-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: str, c: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def tickets(spark: SparkSession, sf_dir: str, numbers: bool = False) -> DataFrame:
    """One ticket per document; metadata from the event with the same id.  ``numbers`` adds the numeric
    columns of both (n_chars, value)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), "event_type", "value", "ts")
    lab = read_table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic", F.lit(True).alias("_labelled"))
    t = d.join(e, "doc_id", "left").join(lab, "doc_id", "left")
    return t.select(
        F.col("doc_id").alias("ord"),
        _padded("TK", F.col("doc_id"), 7).alias("number"),
        F.substring("text", 1, 80).alias("short_description"),
        F.col("text").alias("description"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") < 10), "Batch")
         .otherwise(F.col("source")).alias("u_subcategory"),
        F.col("lang").alias("u_subcategory_2"),
        F.when((F.col("event_type") == "error") & (F.col("value") < 20), "Operación TI")
         .otherwise("Aplicaciones").alias("category"),
        F.when((F.col("event_type") == "signup") & (F.col("value") < 10), " Monitoreo ")
         .otherwise("Portal").alias("contact_type"),
        F.col("ts").alias("sys_created_on"),
        F.when(F.col("_labelled").isNull(), F.lit(None).cast("string"))
         .when(F.col("toxic") == 1, "Cheques")
         .when(F.col("quality") == 1, "Cuentas")
         .otherwise("Garantías.").alias("clasificacion"),
        *(["n_chars", "value"] if numbers else []),
    )


def tickets_with_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets plus the numeric columns used by the profiling operators."""
    return tickets(spark, sf_dir, numbers=True)


def _supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    sn = _supplier_nation(spark, sf_dir)
    k = F.col("s_suppkey")
    return sn.select(
        k.alias("ord"),
        _padded("USR", k, 5).alias("usuario"),
        F.concat(F.lit("Agente "), F.lpad(k.cast("string"), 5, "0"), F.lit(" "), F.col("n_name")).alias("nombre"),
        F.when(k % 11 == 3, F.lit(None).cast("string"))
         .when(F.col("s_acctbal") < 0, "0").otherwise("1").alias("estado"),
        F.when(k % 13 == 5, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sid"), k.cast("string"))).alias("sys_id"),
    )


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    sn = _supplier_nation(spark, sf_dir)
    grp = reduce(lambda acc, kv: acc.when(F.col("n_regionkey") == kv[0], kv[1]),
                 list(GROUP_BY_REGION.items())[1:],
                 F.when(F.col("n_regionkey") == 0, GROUP_BY_REGION[0])).otherwise(GROUP_DEFAULT)
    return sn.select(
        grp.alias("grp"),
        F.col("n_regionkey").alias("grp_order"),
        _padded("USR", F.col("s_suppkey"), 5).alias("member"),
        F.lit(1).alias("level"),
    )


def group_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide group sheet: one column per group, cells are members (ragged, nulls pad)."""
    gm = group_members(spark, sf_dir)
    from pyspark.sql.window import Window
    w = Window.partitionBy("grp").orderBy("member")
    names = list(GROUP_BY_REGION.values()) + [GROUP_DEFAULT]
    return (gm.withColumn("row_in_sheet", F.row_number().over(w))
              .groupBy("row_in_sheet").pivot("grp", names).agg(F.first("member")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned-ticket history: one row per order, assignee spelled three ways."""
    o = read_table(spark, sf_dir, "orders")
    n_sup = read_table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    u = (_supplier_nation(spark, sf_dir)
         .select(F.col("s_suppkey").alias("k"),
                 _padded("USR", F.col("s_suppkey"), 5).alias("usuario"),
                 F.concat(F.lit("Agente "), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"),
                          F.lit(" "), F.col("n_name")).alias("nombre")))
    o = o.withColumn("k", F.col("o_custkey") % n_sup)
    j = o.join(u, "k")
    m = F.col("o_orderkey") % 3
    return j.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("HT"), F.col("o_orderkey").cast("string")).alias("number"),
        F.when(m == 0, F.col("usuario"))
         .when(m == 1, F.concat(F.lit(" "), F.lower("usuario"), F.lit(" ")))
         .otherwise(F.concat(F.split_part("nombre", F.lit(" "), F.lit(3)), F.lit(" "),
                             F.split_part("nombre", F.lit(" "), F.lit(2)), F.lit(" agente")))
         .alias("assigned_to"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"),
               F.lit(None).cast("string"))
         .when(F.col("o_orderstatus") == "F", "Cerrado")
         .when(F.col("o_orderstatus") == "P", " resuelto")
         .otherwise("En curso").alias("state"),
        F.col("o_orderdate").alias("resolved_at"),
    )


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long shift calendar (shift_date, shift, username) for every event day."""
    days = read_table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    slots = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(s).alias("shift"))
                                for i, s in enumerate(SHIFT_NAMES)]))
    x = days.select("d", slots.alias("t")).select("d", "t.i", "t.shift")
    dom = F.dayofmonth("d")
    return x.select(
        F.col("d").alias("shift_date"), "shift",
        F.when((F.col("i") == 1) & (dom % 7 == 0), F.lit(None).cast("string"))
         .otherwise(_padded("USR", (dom * 5 + F.col("i")) % 10, 5)).alias("username"),
    )


def shift_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide calendar as the reference reads it: Fecha, Turno 1..4, Stand-by (dd/MM/yyyy)."""
    s = shifts(spark, sf_dir)
    return (s.groupBy(F.date_format("shift_date", "dd/MM/yyyy").alias("Fecha"))
             .pivot("shift", SHIFT_NAMES).agg(F.first("username")))


# SQL text of the same bindings for the DuckDB oracle (a WITH prefix).
ORACLE_WITH = """
WITH tickets AS (
SELECT d.doc_id AS ord,
       concat('TK', lpad(cast(d.doc_id AS varchar), 7, '0')) AS number,
       substr(d.text, 1, 80) AS short_description,
       d.text AS description,
       CASE WHEN e.event_type = 'purchase' AND e.value < 10 THEN 'Batch' ELSE d.source END AS u_subcategory,
       d.lang AS u_subcategory_2,
       CASE WHEN e.event_type = 'error' AND e.value < 20 THEN 'Operación TI' ELSE 'Aplicaciones' END AS category,
       CASE WHEN e.event_type = 'signup' AND e.value < 10 THEN ' Monitoreo ' ELSE 'Portal' END AS contact_type,
       e.ts AS sys_created_on,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'Cheques'
            WHEN l.quality = 1 THEN 'Cuentas' ELSE 'Garantías.' END AS clasificacion
FROM documents d
LEFT JOIN events e ON e.event_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
), users AS (
SELECT s.s_suppkey AS ord,
       concat('USR', lpad(cast(s.s_suppkey AS varchar), 5, '0')) AS usuario,
       concat('Agente ', lpad(cast(s.s_suppkey AS varchar), 5, '0'), ' ', n.n_name) AS nombre,
       CASE WHEN s.s_suppkey % 11 = 3 THEN NULL WHEN s.s_acctbal < 0 THEN '0' ELSE '1' END AS estado,
       CASE WHEN s.s_suppkey % 13 = 5 THEN NULL ELSE concat('sid', cast(s.s_suppkey AS varchar)) END AS sys_id
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
), group_members AS (
SELECT CASE n.n_regionkey WHEN 0 THEN 'CHEQUE' WHEN 1 THEN 'CUENTAS' WHEN 2 THEN 'REPORTE ONLINE'
            WHEN 3 THEN 'GARANTIAS' ELSE 'USUARIO' END AS grp,
       n.n_regionkey AS grp_order,
       concat('USR', lpad(cast(s.s_suppkey AS varchar), 5, '0')) AS member,
       1 AS level
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
), history AS (
SELECT o.o_orderkey AS ord,
       concat('HT', cast(o.o_orderkey AS varchar)) AS number,
       CASE o.o_orderkey % 3
            WHEN 0 THEN u.usuario
            WHEN 1 THEN concat(' ', lower(u.usuario), ' ')
            ELSE concat(split_part(u.nombre, ' ', 3), ' ', split_part(u.nombre, ' ', 2), ' agente') END AS assigned_to,
       CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'O' THEN NULL
            WHEN o.o_orderstatus = 'F' THEN 'Cerrado' WHEN o.o_orderstatus = 'P' THEN ' resuelto'
            ELSE 'En curso' END AS state,
       o.o_orderdate AS resolved_at
FROM (SELECT x.*, x.o_custkey % c.n AS k FROM orders x CROSS JOIN (SELECT count(*) AS n FROM supplier) c) o
JOIN (SELECT s.s_suppkey AS k,
             concat('USR', lpad(cast(s.s_suppkey AS varchar), 5, '0')) AS usuario,
             concat('Agente ', lpad(cast(s.s_suppkey AS varchar), 5, '0'), ' ', n.n_name) AS nombre
      FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey) u
  ON u.k = o.k
), shifts AS (
SELECT c.d AS shift_date, t.shift,
       CASE WHEN t.i = 1 AND day(c.d) % 7 = 0 THEN NULL
            ELSE concat('USR', lpad(cast((day(c.d) * 5 + t.i) % 10 AS varchar), 5, '0')) END AS username
FROM (SELECT DISTINCT cast(ts AS date) AS d FROM events) c
CROSS JOIN (SELECT 1 AS i, 'Turno 1' AS shift UNION ALL SELECT 2, 'Turno 2' UNION ALL SELECT 3, 'Turno 3'
            UNION ALL SELECT 4, 'Turno 4' UNION ALL SELECT 5, 'Stand-by') t
), tickets_num AS (
SELECT t.*, d.n_chars, e.value
FROM tickets t LEFT JOIN documents d ON d.doc_id = t.ord LEFT JOIN events e ON e.event_id = t.ord
)
"""
