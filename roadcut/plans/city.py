"""From a graph and weighted points to balanced regions and their measures."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadcut.operators import faces as faces_
from roadcut.operators import graph, planar, regions
from roadcut.plans import divide
from roadcut.plans.store import stored
from roadcut.sources import text


@dataclass
class Prepared:
    """A plane graph with its faces: vertices, traced half-edges, inner faces and their dual, which is made when it is asked for."""

    vertices: DataFrame
    traced: DataFrame
    faces: DataFrame

    @cached_property
    def dual(self) -> DataFrame:
        return stored(faces_.dual_edges(self.traced, self.faces), "dual")


def prepare(vertices: DataFrame, edges: DataFrame, cell: float, eps: float = 1.0, make_planar: bool = True) -> Prepared:
    """Largest component, planarized, traced. What is read more than once is stored, so that no plan holds the making of it
    twice: plans and their code take the driver's memory."""
    half = stored(graph.half_edges(edges), "half")
    half = graph.induced(half, stored(graph.largest_component(half), "largest"))
    e = graph.undirected(half)
    vertices, e = planar.planarize(vertices, e, cell, eps) if make_planar else (vertices, e)
    traced = stored(faces_.trace(stored(faces_.angular(graph.half_edges(e), vertices), "angular")), "traced")
    return Prepared(vertices, traced, stored(faces_.interior(faces_.faces(traced)), "faces"))


def weigh(p: Prepared, points: DataFrame, cell: float) -> DataFrame:
    """face, weight, cx, cy of the inner faces."""
    w = faces_.face_weights(points, faces_.locate(points, p.faces, cell), p.faces)
    return stored(p.faces.select("face", "cx", "cy").join(w, "face"), "weights")


def rings(p: Prepared) -> DataFrame:
    return p.faces.select("face", F.explode("ring").alias("id"))


def run(spark: SparkSession, algorithm: str, graph_path: str, points_path: str, out: str, most: float, radius: float | None = None, cell: float = 200.0, share: float = 0.25) -> DataFrame:
    """The whole way from files to files; returns the statistics row."""
    v, half = text.read_graph(spark, graph_path)
    ref = stored(text.reference_point(v), "reference")
    v = text.to_plane(v, ref)
    edges = graph.undirected(half)
    p = prepare(v, edges, cell)
    points = text.to_plane(text.read_points(spark, points_path), ref)
    f = divide.reduced(weigh(p, points, cell), most)
    began = time.time()
    options = {"share": share, "traced": p.traced} if algorithm == "IF" else {}
    a = divide.rebalance(f, p.dual, divide.divide(algorithm, f, p.dual, most, **options), most)
    took = time.time() - began
    weights, cuts = regions.region_weights(f, a), regions.cut_per_region(p.dual, a)
    s = regions.statistics(weights, cuts, most).withColumns({"partition_time": F.lit(took), "dual_vertex_number": F.lit(f.count())})
    if radius is not None:
        s = s.withColumn("over_radius", F.lit(regions.radii(rings(p), a, p.vertices).where(F.col("centroid_radius") > radius).count()))
    back = lambda d: text.to_degrees(d, ref)
    centres = regions.centre_faces(f, a).join(f, "face").select("region", F.col("cx").alias("x"), F.col("cy").alias("y"))
    text.write_division(f, a, cuts, f"{out}/partition")
    text.write_centres(back(centres), f"{out}/centers")
    bound = regions.boundary_rings(p.traced, a).where("is_outer")
    text.write_bounds(back(bound.selectExpr("region", "pos", "id", "x", "y", "0.0D AS weight")), weights, f"{out}/bounds")
    fv = back(f.select(F.col("face").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "weight"))
    text.write_graph(fv, p.dual.select(F.col("f1").alias("src"), F.col("f2").alias("dst"), "length"), f"{out}/dual", "weight")
    text.write_metrics(s, f"{out}/partition_info")
    return s
