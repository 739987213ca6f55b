"""Ways and trees in a plane graph: tours around trees, sectors at corners, graphs cut open along a way.

Half-edges ``h`` are those of faces.angular.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.operators.faces import FAN, orbits, successors
from roadcut.plans.store import numbered, stored


def running(d: DataFrame, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Rows (root, pos, ...) with the sum of value up to pos. Blocks of positions are summed first, so that a root that
    holds most rows isn't one task."""
    b = d.withColumn("_b", F.floor(F.col("pos") / block))
    s = b.groupBy("root", "_b").agg(F.sum(value).alias("_s"))
    s = s.select("root", "_b", (F.sum("_s").over(Window.partitionBy("root").orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy("root", "_b").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    return b.join(s, ["root", "_b"]).withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_b", "_before")


def euler_tour(h: DataFrame, tree: DataFrame) -> DataFrame:
    """root, pos, n, src, dst, hid: both directions of each tree's edges in the order of a tour around it, which turns to the
    next edge counter-clockwise and begins with the root's least one; n of them. tree: id, pred (null at roots). The tour is
    the only face of the tree alone, so it is traced as faces are. Trees without edges have no tour."""
    t = tree.where("pred IS NOT NULL")
    t = t.select(F.col("id").alias("src"), F.col("pred").alias("dst")).union(t.select("pred", "id"))
    around = Window.partitionBy("src")
    th = h.join(t, ["src", "dst"]).withColumnRenamed("hid", "full")
    th = th.withColumns({"rank": (F.row_number().over(around.orderBy("rank")) - 1).cast("long"), "degree": F.count("*").over(around)})
    th = stored(th.withColumn("hid", F.col("src") * FAN + F.col("rank")), "tree")
    o = stored(orbits(successors(th)), "tour")
    size = o.groupBy("face").agg(F.count("*").alias("n"))
    first = o.join(tree.where("pred IS NULL").select(F.col("id").alias("src")), "src").where(F.col("hid") % FAN == 0)
    first = first.select("face", F.col("src").alias("root"), F.col("pos").alias("start")).join(size, "face")
    o = o.join(first, "face").select("root", F.expr("pmod(pos - start, n)").alias("pos"), "n", "src", "dst", "hid")
    return o.join(th.select("hid", "full"), "hid").select("root", "pos", "n", "src", "dst", F.col("full").alias("hid"))


def subtree_sizes(tour: DataFrame) -> DataFrame:
    """root, id, size: vertices of the subtree at each vertex but the root, from the tour's way down to it and back."""
    down = tour.select("root", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("pos").alias("go"))
    both = tour.select("root", F.col("dst").alias("a"), F.col("src").alias("b"), F.col("pos").alias("back"))
    return down.join(both, ["root", "a", "b"]).where("go < back").select("root", F.col("b").alias("id"), ((F.col("back") - F.col("go") + 1) / 2).cast("long").alias("size"))


def tour_faces(h: DataFrame, traced: DataFrame, inner: DataFrame, tour: DataFrame) -> DataFrame:
    """root, face, pos: where in the tour each inner face comes first. An edge that isn't in the tree shows the face on its
    right when the tour passes it, which is before it takes the next tree edge counter-clockwise."""
    t = tour.select("hid", "root", "pos", "n")
    g = h.select("hid", "src", "rank").join(t, "hid", "left")
    rest = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tree = F.when(F.col("root").isNotNull(), F.struct("root", "pos", "n"))
    g = g.withColumn("next", F.coalesce(F.first(tree, ignorenulls=True).over(rest), F.first(tree, ignorenulls=True).over(whole))).where("root IS NULL AND next IS NOT NULL")
    g = g.select("hid", "next.root", F.when(F.col("next.pos") == 0, F.col("next.n")).otherwise(F.col("next.pos")).alias("pos"))
    f = traced.select("hid", "face").join(inner.select("face"), "face", "left_semi")
    return g.join(f, "hid").groupBy("root", "face").agg(F.min("pos").alias("pos"))


def leaf_weights(tour: DataFrame, shown: DataFrame, weights: DataFrame) -> DataFrame:
    """root, before, after, weight: what the faces weigh that the tour shows between one leaf and the next (the first follows
    the last). shown: tour_faces; weights: face, weight."""
    degree = tour.groupBy("root", "src").agg(F.count("*").alias("degree"), F.min("pos").alias("pos"))
    leaves = degree.where("degree = 1 AND src <> root").select("root", "pos", F.col("src").alias("leaf"), F.lit(None).cast("double").alias("weight"))
    f = shown.join(weights.select("face", F.col("weight").cast("double").alias("weight")), "face").groupBy("root", "pos").agg(F.sum("weight").alias("weight"))
    events = leaves.unionByName(f.withColumn("leaf", F.lit(None).cast("long")))
    at = stored(numbered(running(events, "weight", "upto").where("leaf IS NOT NULL"), ["root", "pos"], "nth"), "leaves")
    total = f.groupBy("root").agg(F.sum("weight").alias("total"))
    ends = at.groupBy("root").agg(F.min("nth").alias("low"), F.max("nth").alias("high")).join(total, "root", "left")
    at = at.join(ends, "root").select("root", "leaf", "nth", "low", "high", F.coalesce("upto", F.lit(0.0)).alias("upto"), F.coalesce("total", F.lit(0.0)).alias("total"))
    prev = at.select("root", F.col("leaf").alias("before"), F.when(F.col("nth") == F.col("high"), F.col("low")).otherwise(F.col("nth") + 1).alias("nth"), F.col("upto").alias("from"))
    gap = F.col("upto") - F.col("from") + F.when(F.col("nth") == F.col("low"), F.col("total")).otherwise(0.0)
    return at.join(prev, ["root", "nth"]).select("root", "before", F.col("leaf").alias("after"), gap.alias("weight"))


def sector(h: DataFrame, arms: DataFrame) -> DataFrame:
    """id, dst, at: the half-edges of a corner from that to ``first`` counter-clockwise to that to ``last``, both included.
    arms: id, first, last (neighbours)."""
    x = h.select(F.col("src").alias("id"), "dst", "rank", "degree").join(arms, "id")
    w = Window.partitionBy("id")
    x = x.withColumns({"a": F.min(F.when(F.col("dst") == F.col("first"), F.col("rank"))).over(w), "b": F.min(F.when(F.col("dst") == F.col("last"), F.col("rank"))).over(w)})
    x = x.withColumn("at", F.expr("pmod(rank - a, degree)"))
    return x.where("at <= pmod(b - a, degree)").select("id", "dst", "at")


def allowed(half: DataFrame, corners: DataFrame) -> DataFrame:
    """Half-edges but those that leave a corner for a neighbour that isn't listed. corners: id, dst (null: none is allowed)."""
    c = corners.select(F.col("id").alias("src")).distinct()
    listed = corners.select(F.col("id").alias("src"), "dst").distinct()
    free, bound = half.join(c, "src", "left_anti"), half.join(listed, ["src", "dst"], "left_semi")
    return free.select("src", "dst", "length").union(bound.select("src", "dst", "length"))


def split_path(h: DataFrame, path: DataFrame, outer: DataFrame) -> DataFrame:
    """path, src, src_side, dst, dst_side, length: all half-edges that touch a way, once it is cut open. path: path, pos, id;
    outer: hid of half-edges with an outer face on their right.

    A vertex of the way becomes two, (id, 1) on the left and (id, 2) on the right; each edge follows its sector between the
    way's edges, and the way's own edges are there on both sides. An end on the rim is split at the rim (of several gaps at
    the first one); another end stays whole, as (id, 0). Others are (id, 0) too. The id is the original's."""
    w = Window.partitionBy("path").orderBy("pos")
    p = path.select("path", F.col("id").alias("src"), F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))
    gap = h.join(outer.select("hid"), "hid", "left_semi").groupBy("src").agg((F.min("rank") - 0.5).alias("gap"))
    x = h.select("src", "dst", "rank", "degree", "length").join(p, "src").join(gap, "src", "left")
    v = Window.partitionBy("path", "src")
    to = lambda c: F.coalesce(F.max(F.when(F.col("dst") == F.col(c), F.col("rank").cast("double"))).over(v), F.when(F.col(c).isNull(), F.col("gap")))
    x = x.withColumns({"a": to("prev"), "b": to("next")})
    along = F.coalesce(F.col("dst") == F.col("prev"), F.lit(False)) | F.coalesce(F.col("dst") == F.col("next"), F.lit(False))
    side = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit(0))).when(along, F.array(F.lit(1), F.lit(2)))
    side = side.when(F.expr("pmod(rank - b, degree) < pmod(a - b, degree)"), F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    m = stored(x.select("path", "src", "dst", "length", along.alias("along"), F.explode(side).alias("src_side")), "sides")
    o = m.select("path", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("src_side").alias("dst_side"))
    j = m.join(o, ["path", "src", "dst"], "left").where("dst_side IS NULL OR NOT along OR src_side = dst_side OR src_side = 0 OR dst_side = 0")
    out = j.select("path", "src", "src_side", "dst", F.coalesce("dst_side", F.lit(0)).alias("dst_side"), "length")
    back = j.where("dst_side IS NULL").select("path", F.col("dst").alias("src"), F.lit(0).alias("src_side"), F.col("src").alias("dst"), F.col("src_side").alias("dst_side"), "length")
    return out.union(back)
