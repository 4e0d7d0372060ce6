"""A graph view over the star schema, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _edges(df: DataFrame, kind: str, src, dst, ord_=None) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    named = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", F.concat_ws("/", "r_name", "n_name").alias("n_path"), "n_name")  # 25 rows by definition

    def rows(df: DataFrame, label: str, rank: int, prefix: str, key: str, name: str, path, size=None) -> DataFrame:
        number = F.col(key).cast("long") if label != "Class" else F.regexp_extract(key, r"(\d+)", 1).cast("long")
        return df.select(_id(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), path.alias("path"), (F.lit(rank * 10**9) + number).alias("ord"), (F.lit(None) if size is None else F.col(size)).cast("long").alias("size"))

    none = F.lit(None).cast("string")
    customers = t["customer"].join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t["supplier"].join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = (
        rows(t["region"], "Project", 0, "R", "r_regionkey", "r_name", F.col("r_name"))
        .unionByName(rows(named, "Folder", 1, "N", "n_nationkey", "n_name", F.col("n_path")))
        .unionByName(rows(customers, "File", 2, "C", "c_custkey", "c_name", F.concat_ws("/", "n_path", "c_name")))
        .unionByName(rows(suppliers, "Module", 3, "S", "s_suppkey", "s_name", F.concat_ws("/", "n_path", "s_name")))
        .unionByName(rows(t["part"].select("p_brand").distinct(), "Class", 4, "B", "p_brand", "p_brand", none))
        .unionByName(rows(t["part"], "Function", 5, "P", "p_partkey", "p_name", none, "p_size"))
    )
    bought = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    calls = t["lineitem"].select("l_partkey", F.lead("l_partkey").over(lines).alias("next")).filter("next IS NOT NULL AND next <> l_partkey").distinct()
    edges = (
        _edges(t["nation"], "CONTAINS", _id("R", "n_regionkey"), _id("N", "n_nationkey"))
        .unionByName(_edges(t["customer"], "CONTAINS", _id("N", "c_nationkey"), _id("C", "c_custkey")))
        .unionByName(_edges(t["supplier"], "CONTAINS", _id("N", "s_nationkey"), _id("S", "s_suppkey")))
        .unionByName(_edges(t["part"], "CONTAINS", _id("B", "p_brand"), _id("P", "p_partkey")))
        .unionByName(_edges(bought.select("o_custkey", "l_partkey").distinct(), "DEFINES", _id("C", "o_custkey"), _id("P", "l_partkey")))
        .unionByName(_edges(bought.select("o_custkey", "l_suppkey").distinct(), "IMPORTS", _id("C", "o_custkey"), _id("S", "l_suppkey")))
        .unionByName(_edges(calls, "CALLS", _id("P", "l_partkey"), _id("P", "next")))
        .withColumn("id", F.concat_ws("|", "type", "src", "dst"))
    )
    return PropertyGraph.of(nodes, edges)


#: The same graph for DuckDB, to stand before a query.
GRAPH_SQL = """
WITH RECURSIVE named AS (SELECT n_nationkey, n_regionkey, n_name, r_name || '/' || n_name AS n_path FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'Project' AS label, r_name AS name, r_name AS path, CAST(r_regionkey AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS size FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'Folder', n_name, n_path, 1000000000 + n_nationkey, NULL FROM named
  UNION ALL SELECT 'C' || c_custkey, 'File', c_name, n_path || '/' || c_name, 2000000000 + c_custkey, NULL FROM customer JOIN named ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'Module', s_name, n_path || '/' || s_name, 3000000000 + s_suppkey, NULL FROM supplier JOIN named ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'B' || p_brand, 'Class', p_brand, NULL, 4000000000 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), NULL FROM part
  UNION ALL SELECT 'P' || p_partkey, 'Function', p_name, NULL, 5000000000 + p_partkey, p_size FROM part),
bought AS (SELECT o_custkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
steps AS (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next FROM lineitem),
edges AS (
  SELECT 'CONTAINS' AS type, 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'CONTAINS', 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT 'CONTAINS', 'B' || p_brand, 'P' || p_partkey FROM part
  UNION ALL SELECT DISTINCT 'DEFINES', 'C' || o_custkey, 'P' || l_partkey FROM bought
  UNION ALL SELECT DISTINCT 'IMPORTS', 'C' || o_custkey, 'S' || l_suppkey FROM bought
  UNION ALL SELECT DISTINCT 'CALLS', 'P' || l_partkey, 'P' || next FROM steps WHERE next IS NOT NULL AND next <> l_partkey)
"""
