"""The test tables seen as point clouds and tree tables: pure projections, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """points AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS point_id,
         (l_partkey % 200) / 4.0::DOUBLE AS x, (l_suppkey % 100) / 2.0::DOUBLE AS y, CAST(l_quantity AS DOUBLE) AS z,
         CAST(l_partkey % 97 AS INT) AS tree_id, CAST(round(l_discount * 1000) AS INT) AS intensity,
         CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 5 ELSE 1 END AS cls,
         CAST(l_linenumber AS INT) AS scan, CAST(l_linenumber % 2 AS INT) AS epoch
  FROM lineitem)"""

TREES_SQL = """trees AS (
  SELECT CAST(p_partkey AS INT) AS tree_id,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size / 100.0::DOUBLE END AS dbh,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice / 60.0::DOUBLE END AS height,
         CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE (p_partkey % 40 + 5)::DOUBLE END AS crown_area,
         CAST(100 + p_partkey % 900 AS BIGINT) AS count,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (p_partkey * 37 % 1000) / 10.0::DOUBLE END AS x,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (p_partkey * 91 % 1000) / 10.0::DOUBLE END AS y,
         CASE p_partkey % 5 WHEN 0 THEN 'pine' WHEN 1 THEN 'Kuusi ' WHEN 2 THEN 'koivu' WHEN 3 THEN 'aspen' ELSE NULL END AS species
  FROM part)"""

QSM_SQL = """qsm AS (
  SELECT CAST(p_partkey AS INT) AS tree_id, (p_partkey % 50) / 40.0::DOUBLE AS stem_volume, (p_partkey % 7) / 100.0::DOUBLE AS stem_volume_std,
         1.96::DOUBLE * ((p_partkey % 7) / 100.0::DOUBLE) AS stem_volume_ci95, (p_partkey % 11) / 50.0::DOUBLE AS branch_volume,
         (p_partkey % 21) / 20.0::DOUBLE AS confidence, (p_partkey % 31) / 30.0::DOUBLE AS completeness
  FROM part WHERE p_partkey % 3 = 0)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = read(spark, sf_dir, "lineitem"), F.col
    key = F.concat_ws("-", *(c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.round(c("l_extendedprice") * 100).cast("long").cast("string"))
    return t.select(
        key.alias("point_id"), (c("l_partkey") % 200 / F.lit(4.0)).alias("x"), (c("l_suppkey") % 100 / F.lit(2.0)).alias("y"), c("l_quantity").cast("double").alias("z"),
        (c("l_partkey") % 97).cast("int").alias("tree_id"), F.round(c("l_discount") * 1000).cast("int").alias("intensity"),
        F.when(c("l_returnflag") == "R", 2).when(c("l_returnflag") == "A", 5).otherwise(1).alias("cls"),
        c("l_linenumber").cast("int").alias("scan"), (c("l_linenumber") % 2).cast("int").alias("epoch"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def unless(mod: int, value):
        return F.when(k % mod != 0, value)

    return read(spark, sf_dir, "part").select(
        k.cast("int").alias("tree_id"), unless(13, F.col("p_size") / F.lit(100.0)).alias("dbh"), unless(17, F.col("p_retailprice") / F.lit(60.0)).alias("height"),
        unless(19, (k % 40 + 5).cast("double")).alias("crown_area"), (100 + k % 900).cast("long").alias("count"),
        unless(23, k * 37 % 1000 / F.lit(10.0)).alias("x"), unless(23, k * 91 % 1000 / F.lit(10.0)).alias("y"),
        F.when(k % 5 == 0, "pine").when(k % 5 == 1, "Kuusi ").when(k % 5 == 2, "koivu").when(k % 5 == 3, "aspen").alias("species"))


def qsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    std = k % 7 / F.lit(100.0)
    return read(spark, sf_dir, "part").filter(k % 3 == 0).select(
        k.cast("int").alias("tree_id"), (k % 50 / F.lit(40.0)).alias("stem_volume"), std.alias("stem_volume_std"), (F.lit(1.96) * std).alias("stem_volume_ci95"),
        (k % 11 / F.lit(50.0)).alias("branch_volume"), (k % 21 / F.lit(20.0)).alias("confidence"), (k % 31 / F.lit(30.0)).alias("completeness"))
