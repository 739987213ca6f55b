"""A planar road lattice from the tables ``part`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 40


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gx, gy, x, y: a grid of 40 columns with jitter, so that no edge is parallel to an axis by design."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    return p.selectExpr("id", f"id % {COLUMNS} AS gx", f"id div {COLUMNS} AS gy", f"(id % {COLUMNS}) * 100 + (id * 37) % 41 - 20 AS x", f"(id div {COLUMNS}) * 100 + (id * 53) % 43 - 21 AS y")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, length: neighbours in a row and in a column, once each."""
    v = vertices(spark, sf_dir)
    out = v.selectExpr("id AS u", "x AS ux", "y AS uy", f"explode(if(gx < {COLUMNS - 1}, array(id + 1, id + {COLUMNS}), array(id + {COLUMNS}))) AS v")
    to = v.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return out.join(to, "v").selectExpr("u", "v", "sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)) AS length")


def diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v: both diagonals of every seventh cell, which cross inside it."""
    v = vertices(spark, sf_dir)
    d = v.where(f"gx < {COLUMNS - 1} AND (gx + gy) % 7 = 0").selectExpr(f"explode(array(struct(id AS u, id + {COLUMNS + 1} AS v), struct(id + 1 AS u, id + {COLUMNS} AS v))) AS d").select("d.u", "d.v")
    return d.join(v.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v").join(v.select(F.col("id").alias("u")), "u", "left_semi")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, weight: customers strewn over the grid."""
    rows = vertices(spark, sf_dir).agg(F.max("gy").alias("top"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return c.crossJoin(F.broadcast(rows)).selectExpr("id", "(id * 7919) % 3900 AS x", "(id * 104729) % (100 * top) AS y", "1 + id % 97 AS weight")  # rows: one row


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u (supplier), v (part, behind the suppliers), length: lines that join them."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000_000).alias("v")).agg(F.count("*").alias("length"))
