"""Regions: sets of faces. assignment: face, region; faces: face, weight, cx, cy; dual: f1, f2, length (both directions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.functions import geometry as G
from roadcut.operators.faces import FAN, orbits
from roadcut.plans.store import stored


def cut_edges(dual: DataFrame, assignment: DataFrame) -> DataFrame:
    """f1, f2, length, r1, r2 of the dual edges between regions."""
    a = assignment.select(F.col("face").alias("f1"), F.col("region").alias("r1"))
    b = assignment.select(F.col("face").alias("f2"), F.col("region").alias("r2"))
    return dual.join(a, "f1").join(b, "f2").where("r1 <> r2")


def cut_per_region(dual: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, cut: length of its border with other regions."""
    c = cut_edges(dual, assignment).groupBy(F.col("r1").alias("region")).agg(F.sum("length").alias("cut"))
    return assignment.select("region").distinct().join(c, "region", "left").select("region", F.coalesce("cut", F.lit(0.0)).alias("cut"))


def region_graph(dual: DataFrame, assignment: DataFrame) -> DataFrame:
    """r1, r2, border: both directions."""
    return cut_edges(dual, assignment).groupBy("r1", "r2").agg(F.sum("length").alias("border"))


def region_weights(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, weight, n_faces, cx, cy (mean of the face centres)."""
    f = assignment.join(faces.select("face", "weight", "cx", "cy"), "face")
    return f.groupBy("region").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_faces"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))


def centre_faces(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, face: the face nearest to the mean of the region's face centres."""
    f = assignment.join(faces.select("face", "cx", "cy"), "face")
    m = f.groupBy("region").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    d = F.round((F.col("cx") - F.col("mx")) * (F.col("cx") - F.col("mx")) + (F.col("cy") - F.col("my")) * (F.col("cy") - F.col("my")), 6)
    return f.join(m, "region").groupBy("region").agg(F.min_by("face", F.struct(d.alias("d"), "face")).alias("face"))


def medoids(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, face: the face with the least sum of distances to the region's faces. All pairs of a region are needed, so
    regions must be bounded in size (they are, by weight); pairs are summed on the fly."""
    f = assignment.join(faces.select("face", "cx", "cy"), "face")
    o = f.select("region", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    s = f.join(o, "region").groupBy("region", "face").agg(F.sum(G.distance("cx", "cy", "ox", "oy")).alias("s"))
    return s.groupBy("region").agg(F.min_by("face", F.struct(F.round("s", 6).alias("s"), "face")).alias("face"))


def region_vertices(rings: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, id: vertices of the region's faces. rings: face, id."""
    return rings.join(assignment, "face").select("region", "id").distinct()


def radii(rings: DataFrame, assignment: DataFrame, vertices: DataFrame) -> DataFrame:
    """region, centroid_radius: largest distance of a vertex from the mean of the region's vertices."""
    v = region_vertices(rings, assignment).join(vertices.select("id", "x", "y"), "id")
    m = v.groupBy("region").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return v.join(m, "region").groupBy("region").agg(F.max(G.distance("x", "y", "mx", "my")).alias("centroid_radius"))


def boundary_edges(traced: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, src, dst, length: half-edges of the region's faces whose other side is not in the region."""
    t = traced.select("src", "dst", "length", "face").join(assignment, "face", "left")
    o = t.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("region").alias("other"))
    return t.join(o, ["src", "dst"]).where("region IS NOT NULL AND NOT region <=> other").select("region", "src", "dst", "length")


def boundary_rings(traced: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, ring, pos, id, x, y, length (to the next vertex), is_outer: the closed lines around each region, which lies on
    their right: around the outside (is_outer; one for each piece) and around holes. A ring begins at its least x, of equal
    ones at the greatest y. Where a line meets itself in a vertex, it goes on to the next border counter-clockwise, so it stays
    beside the faces that it came along."""
    t = traced.select("hid", "src", "dst", "length", "x1", "y1", "face").join(assignment.select("face", "region"), "face", "left")
    o = t.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("hid").alias("twin"), F.col("region").alias("other"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    b = stored(t.join(o, ["src", "dst"]).where("region IS NOT NULL AND NOT region <=> other").drop("face", "other"), "borders")
    come = b.select("region", F.col("dst").alias("at"), (F.col("twin") % FAN).alias("rank"), F.col("hid").alias("into"), F.lit(None).cast("long").alias("out"))
    go = b.select("region", F.col("src").alias("at"), (F.col("hid") % FAN).alias("rank"), F.lit(None).cast("long").alias("into"), F.col("hid").alias("out"))
    w = Window.partitionBy("region", "at").orderBy("rank")
    rest, whole = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.first("out", ignorenulls=True).over(rest), F.first("out", ignorenulls=True).over(whole))
    nxt = come.union(go).withColumn("nxt", to).where("into IS NOT NULL").select(F.col("into").alias("hid"), "nxt")
    r = orbits(b.select("hid", "src", "dst", "length", "x1", "y1").join(nxt, "hid"))
    r = stored(r.select("hid", F.col("face").alias("ring"), "pos").join(b, "hid"), "rings")
    first = F.min_by("pos", F.struct("x1", -F.col("y1"), "pos")).alias("start")
    s = r.groupBy("ring").agg(first, F.count("*").alias("n"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) < 0).alias("is_outer"))
    return r.join(s, "ring").select("region", "ring", F.expr("pmod(pos - start, n)").alias("pos"), F.col("src").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "length", "is_outer")


def largest_diameter(rings: DataFrame, assignment: DataFrame, vertices: DataFrame) -> DataFrame:
    """region, diameter: the largest distance between two vertices, found among the corners of the convex hull."""
    v = region_vertices(rings, assignment).join(vertices.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "id")
    hull = v.groupBy("region").applyInPandas(_hull, "region long, id long, x double, y double")
    o = hull.select("region", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return hull.join(o, "region").groupBy("region").agg(F.max(G.distance("x", "y", "ox", "oy")).alias("diameter"))


def _hull(key, pdf):
    """Convex hull of a region's vertices, counter-clockwise from the least (x, y)."""
    p = pdf.drop_duplicates(["x", "y"]).sort_values(["x", "y", "id"])
    rows = list(zip(p.id.tolist(), p.x.tolist(), p.y.tolist()))

    def chain(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (q[2] - out[-2][2]) - (out[-1][2] - out[-2][2]) * (q[1] - out[-2][1]) <= 0:
                out.pop()
            out.append(q)
        return out

    import pandas as pd

    ring = rows if len(rows) < 3 else chain(rows)[:-1] + chain(rows[::-1])[:-1]
    return pd.DataFrame({"region": key[0], "id": [r[0] for r in ring], "x": [r[1] for r in ring], "y": [r[2] for r in ring]})


def convex_hulls(rings: DataFrame, assignment: DataFrame, vertices: DataFrame) -> DataFrame:
    v = region_vertices(rings, assignment).join(vertices.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "id")
    return v.groupBy("region").applyInPandas(_hull, "region long, id long, x double, y double")


def affinity(dual: DataFrame, assignment: DataFrame, weights: DataFrame, most: float) -> DataFrame:
    """face, region, neighbour, ratio: border of a face with a neighbouring region against its border inside its own,
    times most / weight of the neighbour."""
    a = assignment.select(F.col("face").alias("f1"), F.col("region").alias("r1"))
    b = assignment.select(F.col("face").alias("f2"), F.col("region").alias("r2"))
    e = dual.join(a, "f1").join(b, "f2")
    own = e.where("r1 = r2").groupBy("f1").agg(F.sum("length").alias("inner"))
    out = e.where("r1 <> r2").groupBy("f1", "r1", "r2").agg(F.sum("length").alias("outer"))
    w = weights.select(F.col("region").alias("r2"), F.col("weight").alias("w"))
    r = out.join(own, "f1", "left").join(w, "r2")
    ratio = F.col("outer") / F.coalesce("inner", F.lit(1.0)) * most / F.when(F.col("w") > 0, F.col("w"))
    return r.select(F.col("f1").alias("face"), F.col("r1").alias("region"), F.col("r2").alias("neighbour"), ratio.alias("ratio"))


def neighbour_capacity(links: DataFrame, weights: DataFrame, most: float) -> DataFrame:
    """region, weight, capacity: what its neighbours could still take."""
    w = weights.select(F.col("region").alias("r2"), (F.lit(most) - F.col("weight")).alias("room"))
    c = links.join(w, "r2").groupBy(F.col("r1").alias("region")).agg(F.sum("room").alias("capacity"))
    return weights.select("region", "weight").join(c, "region", "left").select("region", "weight", F.coalesce("capacity", F.lit(0.0)).alias("capacity"))


def perimeter_after(dual: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, face, added: change of the region's border when the neighbouring face joins it."""
    a = assignment.select(F.col("face").alias("f2"), F.col("region"))
    touch = dual.join(a, "f2").join(assignment.select(F.col("face").alias("f1"), F.col("region").alias("own")), "f1", "left").where("NOT own <=> region")
    shared = touch.groupBy("region", F.col("f1").alias("face")).agg(F.sum("length").alias("shared"))
    whole = dual.groupBy(F.col("f1").alias("face")).agg(F.sum("length").alias("whole"))
    return shared.join(whole, "face").select("region", "face", (F.col("whole") - 2 * F.col("shared")).alias("added"), "shared")


def statistics(weights: DataFrame, cuts: DataFrame, most: float) -> DataFrame:
    """One row: what is reported of a division (population variance; the *_stddev columns are its roots)."""
    w = weights.join(cuts, "region")
    s = w.agg(
        F.count("*").alias("region_count"), F.sum("weight").alias("total_weight"), F.min("weight").alias("min_region_weight"), F.max("weight").alias("max_region_weight"), F.avg("weight").alias("average_weight"),
        F.var_pop("weight").alias("weight_variance"), F.stddev_pop("weight").alias("weight_stddev"), F.avg("cut").alias("average_boundary"), F.var_pop("cut").alias("boundary_variance"),
        F.stddev_pop("cut").alias("boundary_stddev"), (F.sum("cut") / 2).alias("total_boundary_length"), F.count_if(F.col("n_faces") == 0).alias("empty_regions"),
        F.sort_array(F.collect_list(F.round(F.col("weight") / most, 3))).alias("ratios"),
    )
    ideal = F.ceil(F.col("total_weight") / most)
    return s.withColumns({"min_region_count_estimate": ideal, "estimator_region_number": F.col("region_count") / F.when(ideal > 0, ideal)})


def roll_up(runs: DataFrame) -> DataFrame:
    """runs (city, size, most, edges, time, memory, regions, ideal, average_weight) with regions against the ideal number, load
    and time an edge; null where what divides is 0 or null."""
    over = lambda a, b: F.col(a) / F.when(F.col(b) != 0, F.col(b))
    return runs.withColumns({"region_ratio": over("regions", "ideal"), "avg_load": over("average_weight", "most"), "time_per_edge": over("time", "edges")})


def roll_up_all(runs: DataFrame) -> DataFrame:
    """metric, value: the measures of all runs, and the mean load at each maximum weight, rounded to six places."""
    r = roll_up(runs)
    names = {"max_time": F.max("time"), "max_memory": F.max("memory"), "avg_time_per_edge": F.avg("time_per_edge"), "min_region_ratio": F.min("region_ratio"), "avg_region_ratio": F.avg("region_ratio"), "max_region_ratio": F.max("region_ratio")}
    one = r.agg(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in names.items())).alias("m")).select(F.inline("m"))
    load = r.groupBy("most").agg(F.avg("avg_load").alias("value")).select(F.concat(F.lit("avg_load_"), F.col("most").cast("long")).alias("metric"), "value")
    return one.union(load).select("metric", F.round("value", 6).alias("value"))


def best_half(capacity: DataFrame) -> DataFrame:
    """The half of the regions whose neighbours can take most, ranked."""
    n = capacity.count()
    return capacity.orderBy(F.desc("capacity"), "region").limit(n // 2)


def lightest(weights: DataFrame) -> DataFrame:
    """The lightest twentieth of the regions, one at least."""
    return weights.orderBy("weight", "region").limit(max(1, weights.count() // 20))


#: The eight lines on which regions are measured, as (slope, vertical).
LINES = [(0.0, False), (1.0, False), (-1.0, False), (0.5, False), (-0.5, False), (2.0, False), (-2.0, False), (0.0, True)]


def spreads(faces: DataFrame, assignment: DataFrame) -> DataFrame:
    """region, line, spread: extent of the region's face centres along each line."""
    lines = F.array(*(F.struct(F.lit(i).alias("line"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(LINES)))
    f = assignment.join(faces.select("face", "cx", "cy"), "face").withColumn("l", F.explode(lines))
    p = f.select("region", "face", F.col("l.line").alias("line"), G.projection("cx", "cy", F.col("l.k"), F.col("l.v")).alias("p"))
    return p.groupBy("region", "line").agg((F.max("p") - F.min("p")).alias("spread"), F.min_by("face", F.struct(F.round("p", 6).alias("p"), "face")).alias("first"), F.max_by("face", F.struct(F.round("p", 6).alias("p"), -F.col("face"))).alias("last"))


def ring_extremes(inner: DataFrame) -> DataFrame:
    """face, line, low, high: how far the ring of each face reaches along each line."""
    lines = F.array(*(F.struct(F.lit(i).alias("line"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(LINES)))
    p = inner.select("face", F.explode("shape").alias("q")).withColumn("l", F.explode(lines))
    p = p.select("face", F.col("l.line").alias("line"), G.projection("q.x", "q.y", F.col("l.k"), F.col("l.v")).alias("p"))
    return p.groupBy("face", "line").agg(F.min("p").alias("low"), F.max("p").alias("high"))


def outermost(extremes: DataFrame, assignment: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """region, line, source, sink: the faces that reach farthest to both ends of each line (of equal ones the least), but for
    those of ``without`` (face); a region with no face left has no row."""
    a = assignment if without is None else assignment.join(without.select("face"), "face", "left_anti")
    low, high = F.struct(F.round("low", 6).alias("p"), "face"), F.struct(F.round("high", 6).alias("p"), -F.col("face"))
    return extremes.join(a, "face").groupBy("region", "line").agg(F.min_by("face", low).alias("source"), F.max_by("face", high).alias("sink"))


def best_lines(spread: DataFrame) -> DataFrame:
    """region and the line of its largest spread (of equal ones the first), with the faces at both ends."""
    return spread.groupBy("region").agg(F.max_by(F.struct("line", "spread", "first", "last"), F.struct(F.round("spread", 6).alias("s"), -F.col("line"))).alias("b")).select("region", "b.*")


def seeds(faces: DataFrame, most: float, fill: float = 0.9) -> DataFrame:
    """face, seed: evenly spaced faces in order of distance from the origin; floor(W / (fill * most)) of them, one at least."""
    r = faces.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    count = max(1, int((r.w or 0) // (fill * most)))
    step = max(1, r.n // count)
    w = Window.orderBy(F.round(F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")), 6), "face")
    n = faces.withColumn("at", F.row_number().over(w) - 1)
    return n.where((F.col("at") % step == 0) & (F.col("at") < step * count)).select("face", (F.col("at") / step).cast("long").alias("seed"))
