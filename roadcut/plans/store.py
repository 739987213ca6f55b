"""Cutting lineage and numbering rows without gathering them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="roadcut-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes that are measured to be small, at most. Shuffled rows are compressed; in the driver they take many times as much.
SMALL = 256 << 10


#: Whether Spark deletes a plan's shuffle files as soon as it has run, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def by_measure(spark: SparkSession) -> None:
    """From now on this session broadcasts what it has measured to be small (adaptive execution, after a shuffle), and not what it
    takes to be small by the size of files: these are compressed, and a grid's cells or a closure multiply rows, so that
    millions of rows would pass through the driver. Of Spark's own threshold SMALL bytes are left, since rounds of joins bring
    many such tables to the driver, at once and one after the other. Hints still hold."""
    plain, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (most := spark.conf.get(plain)) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, str(min(SMALL, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most))))
        spark.conf.set(plain, "-1")


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = 40_000) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir) and read back. rows: how many it has, about;
    then it is made in tasks and files of ``each`` rows, about, rather than in very small ones."""
    spark = df.sparkSession
    by_measure(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads this plan's shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables of which no plan that has yet to run reads anything; others are left alone."""
    for t in tables:
        if path := t.__dict__.pop("_stored_at", None):
            jvm_path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def numbered(df: DataFrame, by: list[str], name: str, first: int = 0, parts: int = 32) -> DataFrame:
    """Rows numbered in the order of ``by``: ranked inside range partitions, whose counts are summed up."""
    d = df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id())
    d = stored(d, "ranges")
    counts = d.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return d.withColumn("_at", inside).join(counts, "_part").withColumn(name, (F.col("_before") + F.col("_at") + first).cast("long")).drop("_part", "_at", "_before")
