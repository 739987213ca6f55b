"""Planarizing: crossing segments, splitting, merging near vertices. Joins by place go over a grid, never over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.functions import geometry as G
from roadcut.operators import graph
from roadcut.plans.store import by_measure, numbered, stored


def placed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with x1, y1, x2, y2."""
    a = vertices.select(F.col("id").alias("u"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    b = vertices.select(F.col("id").alias("v"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))
    return edges.join(a, "u").join(b, "v")


def gridded(df: DataFrame, cell: float, x_low, x_high, y_low, y_high) -> DataFrame:
    """A row for each grid cell that the box touches: cell_x, cell_y."""
    by_measure(df.sparkSession)
    at = lambda v: F.floor(v / cell)
    return df.withColumn("cell_x", F.explode(F.sequence(at(x_low), at(x_high)))).withColumn("cell_y", F.explode(F.sequence(at(y_low), at(y_high))))


def near_pairs(segments: DataFrame, cell: float) -> DataFrame:
    """Pairs a < b of segments (seg, u, v, x1, y1, x2, y2) whose boxes overlap, each once: in the cell that holds the
    lower left corner of the overlap."""
    box = segments.withColumns({"xl": F.least("x1", "x2"), "xh": F.greatest("x1", "x2"), "yl": F.least("y1", "y2"), "yh": F.greatest("y1", "y2")})
    g = gridded(box, cell, F.col("xl"), F.col("xh"), F.col("yl"), F.col("yh"))
    a = g.select("cell_x", "cell_y", *(F.col(c).alias(f"a_{c}") for c in box.columns))
    b = g.select("cell_x", "cell_y", *(F.col(c).alias(f"b_{c}") for c in box.columns))
    x, y = F.greatest("a_xl", "b_xl"), F.greatest("a_yl", "b_yl")
    over = (F.col("a_seg") < F.col("b_seg")) & (x <= F.least("a_xh", "b_xh")) & (y <= F.least("a_yh", "b_yh"))
    return a.join(b, ["cell_x", "cell_y"]).where(over & (F.col("cell_x") == F.floor(x / cell)) & (F.col("cell_y") == F.floor(y / cell)))


def crossings(segments: DataFrame, cell: float, strict_bbox: bool = False) -> DataFrame:
    """a_seg, b_seg, x, y for segments that meet away from common ends; collinear overlaps give the ends inside them."""
    p = near_pairs(segments, cell)
    ends = [f"{s}_{c}" for s in "ab" for c in ("x1", "y1", "x2", "y2")]
    p = p.where(G.segments_meet(*ends, strict_bbox=strict_bbox))
    x, y, _ = G.meeting_point(*ends)
    p = p.withColumns({"x": x, "y": y})
    apart = F.expr("a_u <> b_u AND a_u <> b_v AND a_v <> b_u AND a_v <> b_v")
    inside = []  # of parallel ones: each end that lies inside the other segment
    for s, o in ("ab", "ba"):
        for i in "12":
            px, py = f"{s}_x{i}", f"{s}_y{i}"
            other = [f"{o}_x1", f"{o}_y1", f"{o}_x2", f"{o}_y2"]
            end = (F.col(px) == F.col(other[0])) & (F.col(py) == F.col(other[1])) | (F.col(px) == F.col(other[2])) & (F.col(py) == F.col(other[3]))
            inside.append(F.when(G.on_segment(px, py, *other) & ~end, F.struct(F.col(px).alias("x"), F.col(py).alias("y"))))
    at = F.when(F.col("x").isNull(), F.array_compact(F.array(*inside))).otherwise(F.array_compact(F.array(F.when(apart, F.struct("x", "y")))))
    return p.select("a_seg", "b_seg", F.explode(at).alias("at")).select("a_seg", "b_seg", "at.x", "at.y")


def nearest_within(points: DataFrame, targets: DataFrame, eps: float) -> DataFrame:
    """point, target, dist: for each point (id, x, y) the nearest target (id, x, y) not farther than eps."""
    t = targets.select(F.col("id").alias("target"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"))
    t = gridded(t, eps, F.col("tx") - eps, F.col("tx") + eps, F.col("ty") - eps, F.col("ty") + eps)
    p = points.select(F.col("id").alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    p = p.withColumns({"cell_x": F.floor(F.col("px") / eps), "cell_y": F.floor(F.col("py") / eps)})
    d = p.join(t, ["cell_x", "cell_y"]).withColumn("dist", G.distance("px", "py", "tx", "ty")).where(F.col("dist") <= eps)
    return d.groupBy("point").agg(F.min(F.struct("dist", "target")).alias("m")).select("point", "m.target", "m.dist")


def merge_near(vertices: DataFrame, eps: float) -> DataFrame:
    """id, into: vertices nearer than eps, directly or over others, become the one with the least id."""
    v = vertices.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    home = v.withColumns({"cell_x": F.floor(F.col("x") / eps), "cell_y": F.floor(F.col("y") / eps)})
    wide = gridded(v.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy")), eps, F.col("ox") - eps, F.col("ox") + eps, F.col("oy") - eps, F.col("oy") + eps)
    pairs = home.join(wide, ["cell_x", "cell_y"]).where((F.col("id") != F.col("o")) & (G.distance("x", "y", "ox", "oy") <= eps))
    half = stored(pairs.select(F.col("id").alias("src"), F.col("o").alias("dst"), F.lit(0.0).alias("length")), "near")
    return graph.components(half).select("id", F.col("component").alias("into")).where("id <> into")


def split_edges(segments: DataFrame, cuts: DataFrame, eps: float) -> DataFrame:
    """Pieces u, v, length of segments (seg, u, v, length, x1, ...) cut at cuts (seg, id, x, y), in order along each;
    pieces not longer than eps vanish unless they are whole segments."""
    s = segments.select("seg", "u", "v", "length", "x1", "y1", "x2", "y2")
    along = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    mid = cuts.join(s, "seg").select("seg", "length", "id", "x", "y", along.alias("t"))
    ends = s.select("seg", "length", F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(float("-inf")).alias("t")), F.struct(F.col("v").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(float("inf")).alias("t")))).alias("p")).select("seg", "length", "p.id", "p.x", "p.y", "p.t")
    w = Window.partitionBy("seg").orderBy("t", "id")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("id", "x", "y")}
    p = mid.unionByName(ends).withColumns(nxt | {"pieces": F.count("*").over(Window.partitionBy("seg")) - 1}).where("n_id IS NOT NULL AND id <> n_id")
    p = p.withColumn("d", G.distance("x", "y", "n_x", "n_y")).where((F.col("pieces") == 1) | (F.col("d") > eps))
    length = F.when(F.col("pieces") == 1, F.col("length")).otherwise(G.piece_length("length", "d"))
    return p.select(F.least("id", "n_id").alias("u"), F.greatest("id", "n_id").alias("v"), length.alias("length")).groupBy("u", "v").agg(F.min("length").alias("length"))


def planarize(vertices: DataFrame, edges: DataFrame, cell: float, eps: float = 1.0, strict_bbox: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices (id, x, y) and edges (u, v, length) without crossings: crossing points become vertices behind the largest
    id, or the vertex within eps of them; new vertices within eps of each other are merged."""
    seg = stored(numbered(placed(edges.select("u", "v", "length"), vertices), ["u", "v"], "seg"), "segments")
    met = stored(crossings(seg, cell, strict_bbox), "crossings")
    top = vertices.agg(F.max("id")).first()[0] or 0
    spots = numbered(met.select("x", "y").distinct(), ["x", "y"], "id", int(top) + 1).select("id", "x", "y")
    spots = stored(spots, "spots")
    v = vertices.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    snap = nearest_within(spots, v, eps).select(F.col("point").alias("id"), F.col("target").alias("into"))
    free = spots.join(snap, "id", "left_anti")
    into = stored(snap.unionByName(merge_near(free, eps)), "into")
    final = spots.join(into, "id", "left").select("x", "y", F.coalesce("into", "id").alias("id"))
    cut = met.join(final, ["x", "y"])
    cuts = cut.select(F.col("a_seg").alias("seg"), "id").unionByName(cut.select(F.col("b_seg").alias("seg"), "id")).distinct()
    all_v = stored(v.unionByName(free.join(into, "id", "left_anti").select("id", "x", "y")), "vertices")
    cuts = cuts.join(all_v, "id").join(seg.select("seg", "u", "v"), "seg").where("id <> u AND id <> v").select("seg", "id", "x", "y")
    return all_v, stored(split_edges(seg, cuts, eps), "edges")
