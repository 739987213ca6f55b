"""Faces of a plane graph and its dual."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.functions import geometry as G
from roadcut.operators.planar import gridded
from roadcut.plans.store import stored

#: A half-edge's number is src * FAN + its rank around src; vertices with more half-edges, or ids beyond MOST_ID, are refused.
FAN, MOST_ID = 4096, 2**51 - 1


def angular(half: DataFrame, vertices: DataFrame) -> DataFrame:
    """half-edges with angle in [0, 2 pi), rank around src (counter-clockwise from the x axis, ties by dst), degree, hid,
    and the neighbours ccw and cw in that circle."""
    a = vertices.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    h = half.join(a, "src").join(b, "dst").withColumn("angle", G.angle("x1", "y1", "x2", "y2"))
    around, order = Window.partitionBy("src"), Window.partitionBy("src").orderBy("angle", "dst")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.withColumns({
        "rank": (F.row_number().over(order) - 1).cast("long"), "degree": F.count("*").over(around),
        "ccw": F.coalesce(F.lead("dst").over(order), F.first("dst").over(whole)), "cw": F.coalesce(F.lag("dst").over(order), F.last("dst").over(whole)),
    })
    fits = (F.col("rank") < FAN) & F.col("src").between(0, MOST_ID)
    return h.withColumn("hid", F.when(fits, F.col("src") * FAN + F.col("rank")).otherwise(F.raise_error(F.lit(f"a vertex has more than {FAN} half-edges, or an id outside 0..{MOST_ID}"))))


def successors(h: DataFrame) -> DataFrame:
    """hid, nxt: the half-edge that follows on the face to the right: the next counter-clockwise one after the twin."""
    twin = h.select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"), (F.col("src") * FAN + (F.col("rank") + 1) % F.col("degree")).alias("nxt"))
    return h.join(twin, (h["src"] == twin["t_dst"]) & (h["dst"] == twin["t_src"])).select("hid", "src", "dst", "length", "x1", "y1", "nxt")


def _near(s: DataFrame) -> Column:
    """Where a half-edge starts, as one number that is close for close places (bits of x and y in turn)."""
    box = s.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()
    cells = [F.floor((F.col(c) - (low or 0.0)) / max((high or 0.0) - (low or 0.0), 1e-9) * 1023).cast("long") for c, low, high in (("x1", *box[:2]), ("y1", *box[2:]))]
    bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(1), 2 * i + k) for k, c in enumerate(cells) for i in range(10)]
    return reduce(lambda a, b: a + b, bits)


def _doubled(before: np.ndarray, value: np.ndarray, join) -> tuple[np.ndarray, np.ndarray]:
    """Pointers ``before`` (a node without one points at itself) and what lies on their ways, joined."""
    for _ in range(len(before).bit_length() + 1):
        value, before = join(value, value[before]), before[before]
    return before, value


def _chains(batches):
    """Chains of a part's half-edges: head, at (steps from the head), and at the head of an open chain n, out (the half-edge
    that follows its last one), low (the least half-edge) and low_at. A closed chain's head is its least half-edge."""
    got = [pa.Table.from_batches([b]) for b in batches]
    if not got:
        return
    t = pa.concat_tables(got)
    if not t.num_rows:
        return
    t = t.take(pa.array(np.argsort(t["hid"].to_numpy())))
    hid, nxt = t["hid"].to_numpy(), t["nxt"].to_numpy()
    n, itself = len(hid), np.arange(len(hid))
    to = np.minimum(np.searchsorted(hid, nxt), n - 1)
    inside = hid[to] == nxt
    before = itself.copy()
    before[to[inside]] = itself[inside]
    end, least = _doubled(before, itself, np.minimum)
    closed = before[end] != end  # no end was met
    closed |= (before == itself) & (to == itself) & inside
    before = np.where(closed & (least == itself), itself, before)
    head, at = _doubled(before, (before != itself).astype(np.int64), np.add)
    tail = ~inside
    size, out, low, low_at = (np.full(n, -1) for _ in range(4))
    size[head[tail]], out[head[tail]] = at[tail] + 1, nxt[tail]
    order = np.lexsort((itself, head))
    first = order[np.r_[True, np.diff(head[order]) != 0]] if n else order
    low[head[first]], low_at[head[first]] = hid[first], at[first]
    begins = ~closed & (head == itself)
    rows = t.select(["hid", "src", "dst", "length", "x1", "y1"])
    for name, v in (("head", hid[head]), ("at", at), ("n", size), ("out", out), ("low", low), ("low_at", low_at)):
        rows = rows.append_column(name, pa.array(v, pa.int64(), mask=None if name in ("head", "at") else ~begins))
    yield from rows.combine_chunks().to_batches(1 << 16)


def trace(h: DataFrame) -> DataFrame:
    """Half-edges with face (the least hid of the orbit) and pos (steps from that half-edge)."""
    return orbits(successors(h))


def orbits(s: DataFrame) -> DataFrame:
    """Half-edges (hid, src, dst, length, x1, y1, nxt) with face, the least hid of the orbit, and pos, steps from that one.

    Half-edges are dealt out by place, and each part joins its own to chains; most faces close there. What crosses parts
    goes on as one row a chain: pointers double (four steps a round); when nothing changes, orbits are labelled. Cut open
    before the chain that holds the least half-edge, the orbits' chains are ranked in the same way.
    """
    s = stored(s, "next")
    types = "hid long, src long, dst long, length double, x1 double, y1 double, head long, at long, n long, out long, low long, low_at long"
    s = s.select("hid", "nxt", *(F.col(c).cast(t).alias(c) for t, names in (("long", ("src", "dst")), ("double", ("length", "x1", "y1"))) for c in names))
    s = stored(s.repartitionByRange(_near(s), "src").mapInArrow(_chains, types), "chains")
    c = stored(s.where("n IS NOT NULL").select("head", "n", "out", "low", "low_at"), "open")
    done = s.select("hid", "src", "dst", "length", "x1", "y1", "head", "at")
    if c.isEmpty():
        return done.withColumnsRenamed({"head": "face", "at": "pos"})
    at = c.select("head", F.col("out").alias("to"), F.col("low").alias("face"))
    moved = True
    while moved:
        was = at
        for _ in range(2):
            far = at.select(F.col("head").alias("to"), F.col("to").alias("to2"), F.col("face").alias("face2"))
            at = at.join(far, "to").select("head", F.col("to2").alias("to"), F.least("face", "face2").alias("face"))
        at = stored(at, "orbit")
        moved = not at.join(was.select("head", F.col("face").alias("was")), "head").where("was <> face").isEmpty()
    c = stored(c.join(at.select("head", "face"), "head"), "orbits")
    first = c.where("low = face").select(F.col("head").alias("out"), F.lit(True).alias("last"))
    left = c.join(first, "out", "left").select("head", F.when(F.col("last").isNull(), F.col("out")).alias("to"), "n")
    while True:
        for _ in range(2):
            far = left.select(F.col("head").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
            left = left.join(far, "to", "left").select("head", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        left = stored(left, "rank")
        if left.where("to IS NOT NULL").isEmpty():
            break
    orbit = Window.partitionBy("face")
    c = c.join(left.select("head", F.col("n").alias("left")), "head")
    c = c.select("head", "face", F.sum("n").over(orbit).alias("total"), (F.sum("n").over(orbit) - F.col("left") - F.max(F.when(F.col("low") == F.col("face"), F.col("low_at"))).over(orbit)).alias("shift"))
    done = done.join(stored(c, "shifts"), "head", "left")
    return done.select("hid", "src", "dst", "length", "x1", "y1", F.coalesce("face", "head").alias("face"), F.when(F.col("face").isNull(), F.col("at")).otherwise(F.expr("pmod(shift + at, total)")).alias("pos"))


def faces(traced: DataFrame) -> DataFrame:
    """face, ring (vertices in order of pos), n, area (negative inside: rings run clockwise), cx, cy, is_external."""
    f = traced.groupBy("face").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("src").alias("id"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")))).alias("r"))
    cx, cy = G.ring_centre("r")
    return f.select("face", F.col("r.id").alias("ring"), F.size("r").alias("n"), G.ring_area("r").alias("area"), cx.alias("cx"), cy.alias("cy"), F.expr("transform(r, p -> struct(p.x as x, p.y as y))").alias("shape")).withColumn("is_external", F.col("area") >= 0)


def interior(f: DataFrame) -> DataFrame:
    return f.where("NOT is_external")


def ring_edges(inner: DataFrame) -> DataFrame:
    """u < v, length: the graph of some faces alone: edges between a ring's neighbours, as long as they are apart."""
    p = inner.select(F.expr("explode(transform(shape, (p, i) -> struct(ring[i] AS a, ring[(i + 1) % n] AS b, p AS p, shape[(i + 1) % n] AS q)))").alias("e"))
    e = p.select(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"), G.distance("e.p.x", "e.p.y", "e.q.x", "e.q.y").alias("length"))
    return e.where("u <> v").groupBy("u", "v").agg(F.max("length").alias("length"))


def cycle_edges(rings: DataFrame, half: DataFrame, vertices: DataFrame) -> DataFrame:
    """ring, u, v (in the ring's order), length: the closed cycle over each ring (ring, pos, id), with the length of the
    graph's edge where there is one, else the distance."""
    p = vertices.select("id", "x", "y")
    c = ring_neighbours(rings).select("ring", F.col("id").alias("u"), F.col("after").alias("v"))
    c = c.join(half.select(F.col("src").alias("u"), F.col("dst").alias("v"), "length"), ["u", "v"], "left")
    c = c.join(p.toDF("u", "x1", "y1"), "u").join(p.toDF("v", "x2", "y2"), "v")
    return c.select("ring", "u", "v", F.coalesce("length", G.distance("x1", "y1", "x2", "y2")).alias("length"))


def boxes(f: DataFrame) -> DataFrame:
    """face and its bounding box."""
    p = f.select("face", F.explode("shape").alias("p"))
    return p.groupBy("face").agg(F.min("p.x").alias("x_low"), F.max("p.x").alias("x_high"), F.min("p.y").alias("y_low"), F.max("p.y").alias("y_high"))


def dual_edges(traced: DataFrame, inner: DataFrame) -> DataFrame:
    """f1, f2, length (both directions): summed length of the borders between different inner faces."""
    k = inner.select("face")
    t = traced.select("src", "dst", "length", "face").join(k, "face", "left_semi")
    a = t.select("src", "dst", "length", F.col("face").alias("f1"))
    b = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("face").alias("f2"))
    return a.join(b, ["src", "dst"]).where("f1 <> f2").groupBy("f1", "f2").agg(F.sum("length").alias("length"))


def multiplicity(traced: DataFrame) -> DataFrame:
    """id, faces: in how many inner corners a vertex stands."""
    return traced.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("faces"))


def locate(points: DataFrame, f: DataFrame, cell: float) -> DataFrame:
    """point, face: the face that holds the point (id, x, y) or has it on its border; of several the least. Over a grid."""
    b = boxes(f).join(f.select("face", "shape"), "face")
    g = gridded(b, cell, F.col("x_low"), F.col("x_high"), F.col("y_low"), F.col("y_high"))
    p = points.select(F.col("id").alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumns({"cell_x": F.floor(F.col("px") / cell), "cell_y": F.floor(F.col("py") / cell)})
    hit = p.join(g, ["cell_x", "cell_y"]).where(G.in_rectangle("px", "py", "x_low", "y_low", "x_high", "y_high")).where(G.in_ring("px", "py", "shape"))
    return hit.groupBy("point").agg(F.min("face").alias("face"))


def face_weights(points: DataFrame, located: DataFrame, f: DataFrame) -> DataFrame:
    """face, weight: sum over its points; 0 for empty faces."""
    w = located.join(points.select(F.col("id").alias("point"), "weight"), "point").groupBy("face").agg(F.sum("weight").alias("w"))
    return f.select("face").join(w, "face", "left").select("face", F.coalesce("w", F.lit(0)).alias("weight"))


def weights_from_vertices(traced: DataFrame, inner: DataFrame, vertices: DataFrame) -> DataFrame:
    """face, weight: each vertex gives its weight in equal shares to the corners in which it stands."""
    t = traced.join(inner.select("face"), "face", "left_semi")
    m = multiplicity(t).join(vertices.select("id", "weight"), "id").select(F.col("id").alias("src"), (F.col("weight") / F.col("faces")).alias("share"))
    return t.join(m, "src").groupBy("face").agg(F.sum("share").alias("weight"))


def centroids(inner: DataFrame) -> DataFrame:
    """face, x, y: plain mean of the ring's vertices."""
    p = inner.select("face", F.explode("shape").alias("p"))
    return p.groupBy("face").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))


def ring_segment(rings: DataFrame, ends: DataFrame) -> DataFrame:
    """Of rings (ring, pos, id): the vertices from each ring's start to its end (ends: ring, first, last; ids), going on
    over the last position to the first; at: steps from the start."""
    n = Window.partitionBy("ring")
    r = rings.join(ends, "ring").withColumns({"n": F.count("*").over(n), "a": F.min(F.when(F.col("id") == F.col("first"), F.col("pos"))).over(n), "b": F.min(F.when(F.col("id") == F.col("last"), F.col("pos"))).over(n)})
    r = r.withColumn("at", F.expr("pmod(pos - a, n)"))
    return r.where(F.expr("at <= pmod(b - a, n)")).select("ring", F.col("at").cast("long").alias("at"), "id")


def ring_neighbours(rings: DataFrame) -> DataFrame:
    """ring, pos, id, after, before on the closed ring."""
    w = Window.partitionBy("ring").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rings.select("ring", "pos", "id", F.coalesce(F.lead("id").over(w), F.first("id").over(whole)).alias("after"), F.coalesce(F.lag("id").over(w), F.last("id").over(whole)).alias("before"))


def masked_run(rings: DataFrame, mask: DataFrame) -> DataFrame:
    """ring, at, id, masked: rings (ring, pos, id) turned so that they begin where a masked run does (mask: ring, id): at the
    masked vertex of least pos whose predecessor isn't masked; a ring that is masked wholly or not at all stays as it is."""
    w, whole = Window.partitionBy("ring").orderBy("pos"), Window.partitionBy("ring")
    r = rings.select("ring", "pos", "id").join(mask.select("ring", "id", F.lit(True).alias("masked")).distinct(), ["ring", "id"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    last = F.last("masked").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = r.withColumns({"was": F.coalesce(F.lag("masked").over(w), last), "n": F.count("*").over(whole)})
    begin = F.coalesce(F.min(F.when(F.col("masked") & ~F.col("was"), F.col("pos"))).over(whole), F.lit(0))
    return r.withColumn("begin", begin).select("ring", F.expr("pmod(pos - begin, n)").cast("long").alias("at"), "id", "masked")


def cyclic_order(rings: DataFrame, chosen: DataFrame, starts: DataFrame) -> DataFrame:
    """ring, nth, id: the chosen vertices (ring, id) of each ring in falling order of their steps from its start (ring, id)."""
    n = rings.groupBy("ring").agg(F.count("*").alias("n"))
    s = rings.join(starts.select("ring", "id"), ["ring", "id"]).groupBy("ring").agg(F.min("pos").alias("start")).join(n, "ring")
    r = rings.join(chosen.select("ring", "id").distinct(), ["ring", "id"], "left_semi").join(s, "ring").withColumn("at", F.expr("pmod(pos - start, n)"))
    return r.select("ring", (F.row_number().over(Window.partitionBy("ring").orderBy(F.desc("at"))) - 1).cast("long").alias("nth"), "id")


def prefix_weights(tour: DataFrame) -> DataFrame:
    """Of a tour (root, pos, face, weight): the weight up to each position and the rest behind it."""
    w = Window.partitionBy("root").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tour.withColumn("upto", F.sum("weight").over(w)).withColumn("rest", F.sum("weight").over(Window.partitionBy("root")) - F.col("upto"))


def leaf_groups(prefixes: DataFrame) -> DataFrame:
    """Weight between consecutive leaves from their prefix sums (root, leaf, upto): the difference to the leaf before."""
    w = Window.partitionBy("root").orderBy("leaf")
    return prefixes.select("root", "leaf", (F.col("upto") - F.coalesce(F.lag("upto").over(w), F.lit(0))).alias("weight"))
