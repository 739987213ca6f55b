"""Text formats: graphs, weighted points, divisions. Numbers may have a decimal comma."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcut.functions import geometry as G


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its white-space separated tokens."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.expr(r"filter(split(translate(value, ',', '.'), '\\s+'), x -> x <> '')").alias("t"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id, x, y) and half-edges (src, dst, length) of a graph file: the number of vertices, then for each one
    ``id x y k`` and k times ``id x y length``. Records may wrap over lines; what follows the last vertex is ignored.

    The records' starts depend on each other, so a file is walked through by one task; large inputs are read as many
    files or as tables.
    """

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            for t in pdf.t:
                out, at = [], 1
                for _ in range(int(t[0]) if len(t) else 0):
                    v, x, y, k = int(t[at]), float(t[at + 1]), float(t[at + 2]), int(t[at + 3])
                    at += 4
                    out.append((v, x, y, None, None))
                    for _ in range(k):
                        out.append((v, x, y, int(t[at]), float(t[at + 3])))
                        at += 4
                yield pd.DataFrame(out, columns=["id", "x", "y", "dst", "length"]).astype({"id": "int64", "dst": "Int64"})

    rows = _tokens(spark, path).mapInPandas(walk, "id long, x double, y double, dst long, length double")
    vertices = rows.where("dst IS NULL").groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")
    return vertices, rows.where("dst IS NOT NULL").select(F.col("id").alias("src"), "dst", "length")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, x (longitude), y (latitude), weight (length * width / 10) of a buildings file: a count, then rows
    ``id lat lon length width``."""
    raw = spark.read.text(path).select(F.expr(r"filter(split(translate(value, ',', '.'), '\\s+'), x -> x <> '')").alias("t")).where("size(t) = 5")
    return raw.selectExpr("cast(t[0] AS long) AS id", "cast(t[2] AS double) AS x", "cast(t[1] AS double) AS y", "cast(t[3] AS int) * cast(t[4] AS int) / 10.0D AS weight")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, weight of a vertex list: a count, then rows."""
    raw = spark.read.text(path).select(F.expr(r"filter(split(translate(value, ',', '.'), '\\s+'), x -> x <> '')").alias("t")).where("size(t) = 4")
    return raw.selectExpr("cast(t[0] AS long) AS id", "cast(t[1] AS double) AS x", "cast(t[2] AS double) AS y", "cast(t[3] AS double) AS weight")


def reference_point(vertices: DataFrame) -> DataFrame:
    """One row: the middle of the bounding box."""
    return vertices.agg(((F.min("x") + F.max("x")) / 2).alias("ref_x"), ((F.min("y") + F.max("y")) / 2).alias("ref_y"))


def to_plane(points: DataFrame, ref: DataFrame) -> DataFrame:
    p = points.crossJoin(F.broadcast(ref))  # ref: one row
    x, y = G.to_plane("x", "y", "ref_x", "ref_y")
    return p.withColumns({"x": x, "y": y}).drop("ref_x", "ref_y")


def to_degrees(points: DataFrame, ref: DataFrame) -> DataFrame:
    p = points.crossJoin(F.broadcast(ref))
    x, y = G.to_degrees("x", "y", "ref_x", "ref_y")
    return p.withColumns({"x": x, "y": y}).drop("ref_x", "ref_y")


def graph_lines(vertices: DataFrame, half: DataFrame, weight: str | None = None) -> DataFrame:
    """A line a vertex: ``id x y [weight] k`` and k times ``id x y length``."""
    to = vertices.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    out = half.join(to, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "x2", "y2", "length"))).alias("n"))
    v = vertices.join(out, "id", "left").withColumn("n", F.coalesce("n", F.expr("array()")))
    near = F.expr("concat_ws(' ', transform(n, e -> concat_ws(' ', e.dst, e.x2, e.y2, e.length)))")
    return v.select("id", F.concat_ws(" ", "id", "x", "y", *([weight] if weight else []), F.size("n"), F.when(F.size("n") > 0, near)).alias("value"))


def write_graph(vertices: DataFrame, half: DataFrame, path: str, weight: str | None = None) -> None:
    """A graph file that read_graph reads (without weight): the count, then the vertices in order of id."""
    head = vertices.agg(F.lit(-(2**62)).alias("id"), F.count("*").cast("string").alias("value"))
    graph_lines(vertices, half, weight).unionByName(head).orderBy("id").select("value").coalesce(1).write.text(path)


def write_points(points: DataFrame, path: str, order: str = "id", columns: tuple[str, ...] = ("id", "x", "y", "weight")) -> None:
    points.orderBy(order).select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def write_centres(centres: DataFrame, path: str) -> None:
    write_points(centres, path, "region", ("x", "y"))


def write_division(faces: DataFrame, assignment: DataFrame, cuts: DataFrame, path: str) -> None:
    """A folder region=... for each region, with a text file: its cut, its size, then ``face x y weight``."""
    f = assignment.join(faces, "face").select("region", F.col("face").alias("k"), F.concat_ws(" ", "face", "cx", "cy", "weight").alias("value"))
    n = assignment.groupBy("region").agg(F.count("*").cast("string").alias("value")).select("region", F.lit(-1).cast("long").alias("k"), "value")
    c = cuts.select("region", F.lit(-2).cast("long").alias("k"), F.col("cut").cast("string").alias("value"))
    f.unionByName(n).unionByName(c).repartition("region").sortWithinPartitions("region", "k").select("region", "value").write.partitionBy("region").text(path)


def write_bounds(bounds: DataFrame, weights: DataFrame, path: str) -> None:
    """bounds: region, pos, id, x, y, weight; weights: region, weight. A folder for each region: the ring's vertices in order of
    pos, then the region's weight."""
    b = bounds.select("region", "pos", F.concat_ws(" ", "id", "x", "y", "weight").alias("value"))
    s = weights.join(bounds.select("region"), "region", "left_semi").select("region", F.lit(2**62).alias("pos"), F.format_string("%f", F.col("weight").cast("double")).alias("value"))
    b.unionByName(s).repartition("region").sortWithinPartitions("region", "pos").select("region", "value").write.partitionBy("region").text(path)


def metrics_json(statistics: DataFrame) -> DataFrame:
    """value: the statistics row as a JSON object."""
    return statistics.select(F.to_json(F.struct("*")).alias("value"))


def write_metrics(statistics: DataFrame, path: str) -> None:
    metrics_json(statistics).coalesce(1).write.text(path)
