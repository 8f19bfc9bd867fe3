"""Auction lots, sessions and notices stated in terms of the driver's tables.

The same SQL runs in Spark (with frames for the braces) and in DuckDB (with table names), so queries and their
oracles start from equal rows; everything after that is the operators' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01 12:00:00"

LOTS = """
SELECT o.o_orderkey AS lot_id, p.p_partkey AS part_id, p.p_name || ' ' || p.p_brand AS title, p.p_type AS description,
  CASE p.p_size % 3 WHEN 0 THEN 'IMOVEL' WHEN 1 THEN 'VEICULO' ELSE 'OUTRO' END AS asset,
  CASE WHEN p.p_size % 4 < 2 THEN 'IMOVEL' WHEN p.p_size % 4 = 2 THEN 'MOVEL' ELSE 'INDEFINIDA' END AS nature,
  CASE WHEN p.p_size % 5 < 2 THEN 'URBANA' WHEN p.p_size % 5 = 2 THEN 'RURAL' ELSE 'INDEFINIDA' END AS zone,
  CASE s.s_nationkey % 3 WHEN 0 THEN 'ESTADUAL' WHEN 1 THEN 'FEDERAL' ELSE 'DESCONHECIDA' END AS sphere,
  CASE WHEN o.o_orderstatus = 'O' THEN 'ABERTO' WHEN o.o_orderstatus = 'P' THEN 'SUSPENSO' WHEN o.o_orderpriority = '5-LOW' THEN 'DESERTO' ELSE 'ARREMATADO' END AS status,
  r.r_name AS uf, n.n_name AS city, CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE 'Jardim São ' || CAST(p.p_size % 7 AS STRING) END AS district,
  s.s_suppkey AS auctioneer_id, p.p_brand AS brand, p.p_name AS model, 2000 + p.p_size % 20 AS model_year,
  CAST(o.o_totalprice AS DECIMAL(14,2)) AS appraisal, CAST(l.price AS DECIMAL(14,2)) AS first_min,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL WHEN o.o_orderkey % 20 = 1 THEN CAST(0 AS DECIMAL(14,2)) ELSE CAST(floor(l.price * 60) / 100 AS DECIMAL(14,2)) END AS second_min,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(5 AS DECIMAL(5,2)) END AS commission,
  CASE o.o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS occupied,
  CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'hipoteca' WHEN 2 THEN 'penhora,usufruto' END AS liens_text,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(l.quantity % 101 AS DOUBLE) END AS score,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(l.quantity % 60 AS DOUBLE) END AS discount,
  o.o_orderdate AS collected_at, o.o_custkey AS customer_id
FROM {orders} o
JOIN (SELECT l_orderkey, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey, min(l_extendedprice) AS price, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON p.p_partkey = l.partkey
JOIN {supplier} s ON s.s_suppkey = l.suppkey
JOIN {nation} n ON n.n_nationkey = s.s_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

SESSIONS = """
SELECT o_orderkey AS lot_id, 1 AS ordinal, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 20 DAY END AS at FROM {orders}
UNION ALL
SELECT o_orderkey, 2, o_orderdate + INTERVAL 34 DAY FROM {orders} WHERE o_orderkey % 3 > 0
"""

TABLES = ("orders", "lineitem", "part", "supplier", "nation", "region")


def stated(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in (*TABLES, "customer", "events", "documents") if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def in_duckdb(sql: str) -> str:
    return sql.format(**{t: t for t in (*TABLES, "customer", "events", "documents")})


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    liens = F.filter(F.split("liens_text", ","), lambda x: x != "")
    return stated(spark, sf_dir, LOTS).withColumn("liens", liens)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir, SESSIONS)
