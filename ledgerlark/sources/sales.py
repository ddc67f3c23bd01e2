"""Sales facts and dimensions.

The facts are text in every column, as a point-of-sale export gives them. ``raw_sales`` builds
them from lineitem and orders, with dirt at fixed remainders, so that every rule of the
cleaning has rows; the same SELECT runs in DuckDB for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import files_state

FACTS = ["order_id", "date", "store_id", "product_id", "qty", "amount", "payment"]
FACT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FACTS])

_RAW = """
SELECT 'ORD' || l_orderkey AS order_id,
  CASE WHEN k % 73 = 0 THEN '2026-13-45' WHEN l_orderkey % 3 = 0 THEN {ymd}
       WHEN l_orderkey % 3 = 1 THEN year(d) || '/' || month(d) || '/' || day(d) ELSE {dmy} END AS date,
  CASE WHEN k % 83 = 0 THEN 'S999999' WHEN k % 5 = 0 THEN ' s' || l_suppkey || ' ' ELSE 'S' || l_suppkey END AS store_id,
  CASE WHEN k % 79 = 0 THEN 'P999999' WHEN k % 7 = 0 THEN 'p' || l_partkey ELSE 'P' || l_partkey END AS product_id,
  CASE WHEN k % 89 = 0 THEN '0' WHEN k % 107 = 0 THEN q || '.5' WHEN k % 11 = 0 THEN q || '.0' ELSE CAST(q AS {text}) END AS qty,
  CASE WHEN k % 97 = 0 THEN '' WHEN k % 103 = 0 THEN 'n/a' WHEN k % 71 = 0 THEN '0.00'
       WHEN l_returnflag = 'R' THEN '-' || amt WHEN k % 13 = 0 THEN '¥' || amt ELSE amt END AS amount,
  o_orderpriority AS payment
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_orderkey * 8 + l_linenumber AS k, CAST(l_shipdate AS DATE) AS d,
    CAST(l_quantity AS BIGINT) AS q, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS {text}) AS amt, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) base
"""

_DUCK = _RAW.format(ymd="strftime(d, '%Y-%m-%d')", dmy="strftime(d, '%d-%m-%Y')", text="VARCHAR")
#: The facts in DuckDB: all rows, and every 101st once more.
RAW_SALES_SQL = f"{_DUCK} UNION ALL {_DUCK} WHERE k % 101 = 0"
STORES_SQL = "SELECT 'S' || s_suppkey AS store_id, s_name AS store_name, r_name AS category, n_name AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
PRODUCTS_SQL = "SELECT 'P' || p_partkey AS product_id, p_name AS product_name, p_type AS product_category, CAST(p_retailprice AS DECIMAL(12, 2)) AS unit_price FROM part"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> str:
    """A name of the files behind the facts and dimensions, as they are now."""
    return files_state(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "supplier", "nation", "region", "part")])


def read_facts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Facts from files, every column as text; types are never inferred."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(*(F.col(c).cast("string").alias(c) for c in FACTS))
    return spark.read.schema(FACT_SCHEMA).option("header", True).format(fmt).load(path)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven text columns of the facts; one join on the order key, and the copies from the same scan."""
    line, order = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = line.join(order, line.l_orderkey == order.o_orderkey)
    base = joined.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_orderkey * 8 + l_linenumber AS k", "CAST(l_shipdate AS DATE) AS d",
        "CAST(l_quantity AS BIGINT) AS q", "CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS STRING) AS amt", "o_orderpriority",
    )
    text = _RAW.format(ymd="date_format(d, 'yyyy-MM-dd')", dmy="date_format(d, 'dd-MM-yyyy')", text="STRING")
    columns = text.split("SELECT", 1)[1].split("FROM (")[0]
    twice = base.withColumn("copy", F.explode(F.when(F.col("k") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(columns[start:i])
            start = i + 1
    return twice.selectExpr(*(p.strip() for p in [*parts, columns[start:]]))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id (trimmed, upper case), store_name, category, district."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    near = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # nations and regions are fixed lists of 25 and 5 rows
    joined = s.join(F.broadcast(near), s.s_nationkey == n.n_nationkey)
    return joined.select(F.upper(F.trim(F.concat(F.lit("S"), "s_suppkey"))).alias("store_id"), F.col("s_name").alias("store_name"), F.col("r_name").alias("category"), F.col("n_name").alias("district"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id (trimmed, upper case), product_name, product_category, unit_price as a decimal."""
    p = _table(spark, sf_dir, "part")
    return p.select(F.upper(F.trim(F.concat(F.lit("P"), "p_partkey"))).alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category"), F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"))
