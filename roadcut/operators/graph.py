"""Graph operators on edge tables. half-edges: src, dst, length, each edge in both directions; edges: u, v, length."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.plans.store import stored


def half_edges(edges: DataFrame) -> DataFrame:
    """Symmetric closure: both directions of every edge, once each, without loops; of parallel edges the longest."""
    e = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "length")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.max("length").alias("length"))


def undirected(half: DataFrame) -> DataFrame:
    """Distinct undirected edges u < v."""
    return half.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("length").alias("length"))


def induced(half: DataFrame, keep: DataFrame, key: str = "id") -> DataFrame:
    """Half-edges with both ends in keep."""
    k = keep.select(key).distinct()
    return half.join(k.select(F.col(key).alias("src")), "src", "left_semi").join(k.select(F.col(key).alias("dst")), "dst", "left_semi").select("src", "dst", "length")


def without_vertices(half: DataFrame, drop: DataFrame, key: str = "id") -> DataFrame:
    d = drop.select(key).distinct()
    return half.join(d.select(F.col(key).alias("src")), "src", "left_anti").join(d.select(F.col(key).alias("dst")), "dst", "left_anti").select("src", "dst", "length")


def without_edges(half: DataFrame, drop: DataFrame) -> DataFrame:
    """Half-edges that are not among drop (u, v) in either direction."""
    d = drop.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    return half.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(d, ["lo", "hi"], "left_anti").select("src", "dst", "length")


def tiny_edges(edges: DataFrame, least: float = 0.001) -> DataFrame:
    """edges, tiny: how many there are, and how many of them are shorter than least."""
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("length") < least).alias("tiny"))


def arcs(edges: DataFrame) -> DataFrame:
    """src, dst, length, bandwidth: edges (u, v, length, bandwidth) in their own direction only, without loops; of parallel ones
    the lengths' greatest and the bandwidths' sum."""
    return edges.where("u <> v").groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.max("length").alias("length"), F.sum("bandwidth").alias("bandwidth"))


def default_weights(vertices: DataFrame, seed: int = 15) -> DataFrame:
    """Vertices with weight; where it is missing or null, one from 10 to 39 drawn by the id and the seed."""
    drawn = F.lit(10) + F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 30
    return vertices.withColumn("weight", F.coalesce("weight", drawn) if "weight" in vertices.columns else drawn)


def degrees(half: DataFrame) -> DataFrame:
    return half.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def linked_vertices(vertices: DataFrame, half: DataFrame) -> DataFrame:
    """Vertices with an edge."""
    return vertices.join(half.select(F.col("src").alias("id")), "id", "left_semi")


def _forest(batches):
    """Of a part's edges (src, dst): the nodes, each with the least node of its component in this part."""
    got = [np.stack([b.column("src").to_numpy(), b.column("dst").to_numpy()]) for b in batches]
    if not got:
        return
    ends = np.concatenate(got, axis=1)
    node, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for place in (root[a], root[b], a, b):
            np.minimum.at(new, place, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for i in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(node[root[i : i + (1 << 16)]])], names=["id", "root"])


def components(half: DataFrame, vertices: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """id, component (its least id); vertices without edges are components.

    Each part of the edges (a range of ids; with ``dealt`` one of so many random parts, which suits vertices with very many edges) is
    contracted by itself to one root a component. What is left joins the roots of vertices that stand in several parts;
    labels spread over that with shortcuts, in rounds.
    """
    links = half.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src < dst")
    local = stored((links.repartition(dealt) if dealt else links.repartitionByRange("src")).mapInArrow(_forest, "id long, root long"), "local")
    own = local.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    label = own.select("id", F.col("low").alias("component"))
    split = own.where("low <> high").select("id", "low")
    over = stored(local.join(split, "id").where("root <> low").select("low", "root").distinct(), "over", local.count())
    if not over.isEmpty():
        both = over.selectExpr("low AS src", "root AS dst").unionByName(over.selectExpr("root AS src", "low AS dst"))
        top = _spread(both).select(F.col("id").alias("component"), F.col("component").alias("top"))
        label = label.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    if vertices is not None:
        alone = vertices.select(F.col("id").cast("long").alias("id")).join(own.select("id"), "id", "left_anti").distinct()
        label = label.unionByName(alone.select("id", F.col("id").alias("component")))
    return label


def _spread(links: DataFrame) -> DataFrame:
    """id, component of the ends of links (src, dst; both directions): each takes the least label around it, then that
    one's label, until nothing changes."""
    label = stored(links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("n")).select("id", F.least("id", "n").alias("component")), "labels")
    while True:
        of = label.select(F.col("id").alias("dst"), F.col("component").alias("near"))
        near = links.join(of, "dst").groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        step = label.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        new = stored(step.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("upper", "component")).alias("component")), "labels")
        label = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return label


def largest_component(half: DataFrame) -> DataFrame:
    """id of the vertices of the component with most vertices (the least one of equals)."""
    c = components(half)
    size = c.groupBy("component").agg(F.count("*").alias("n"))
    best = size.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return c.join(F.broadcast(best), "component").select("id")  # best: one row


def reachable(half: DataFrame, start: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """id of what can be reached from start without entering blocked (start itself counts unless blocked): the components
    that hold a start once blocked is gone. half: both directions of every edge."""
    h = half if blocked is None else without_vertices(half, blocked)
    first = start.select("id").distinct()
    first = first if blocked is None else first.join(blocked.select("id"), "id", "left_anti")
    c = stored(components(h, first), "parts")
    return c.join(c.join(first, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id")


def _settle(key, edges: pa.Table, state: pa.Table) -> pa.Table:
    """Shortest ways inside a block, from what has newly come in: kind 0, the block's vertices as far as they are known;
    kind 1, what leaves to other blocks."""
    near: dict[int, list] = {}
    for s, d, w, to in zip(*(edges[c].to_pylist() for c in ("src", "dst", "length", "to"))):
        near.setdefault(s, []).append((d, w, to))
    best: dict[int, tuple] = {}
    heap = []
    for fresh, v, d, p in sorted(zip(*(state[c].to_pylist() for c in ("fresh", "id", "dist", "pred")))):
        if v not in best or (d, p) < best[v]:
            if fresh and (v not in best or d < best[v][0]):
                heapq.heappush(heap, (d, v))
            best[v] = (d, p)
    own, out = key[0].as_py(), {}
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u][0]:
            continue
        for v, w, to in near.get(u, ()):
            new = (d + w, u)
            if to != own:
                if v not in out or new < out[v][:2]:
                    out[v] = (*new, to)
            elif v not in best or new[0] < best[v][0]:
                best[v] = new
                heapq.heappush(heap, (new[0], v))
            elif new < best[v] and w > 0 and best[v][1] >= 0:
                best[v] = new
    rows = [(0, v, d, p, own) for v, (d, p) in best.items()] + [(1, v, d, p, to) for v, (d, p, to) in out.items()]
    cols = list(zip(*rows)) or [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "id", "dist", "pred", "block"), cols, (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32()))})


def shortest_paths(half: DataFrame, start: DataFrame) -> DataFrame:
    """id, dist, pred (null at the start): from the nearest of start (id). Of equally short ways the one over the least
    vertex counts.

    Edges lie in blocks of neighbouring ids. A round settles all blocks that something shorter has reached, each in a
    worker, and passes on what leaves them; so there are as many rounds as a way crosses blocks, not as it has edges.
    """
    h = half.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("length").cast("double").alias("length"))
    h = stored(h.repartitionByRange("src").withColumn("block", F.spark_partition_id()), "blocks")
    at = stored(h.groupBy(F.col("src").alias("id")).agg(F.min("block").alias("block")), "places")
    h = stored(h.join(at.select(F.col("id").alias("dst"), F.col("block").alias("to")), "dst"), "blocks")
    first = start.select(F.col("id").cast("long").alias("id")).distinct().join(at, "id", "left")
    first = first.select("id", F.lit(0.0).alias("dist"), F.lit(-1).cast("long").alias("pred"), "block")
    alone = first.where("block IS NULL").select("id", "dist", "pred")
    new, known = stored(first.where("block IS NOT NULL"), "ways"), None
    while not new.isEmpty():
        state = new.withColumn("fresh", F.lit(True))
        touched = new.select("block").distinct()
        if known is not None:
            state = state.unionByName(known.join(touched, "block", "left_semi").withColumn("fresh", F.lit(False)))
        got = h.join(touched, "block", "left_semi").groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_settle, "kind int, id long, dist double, pred long, block int")
        got = stored(got, "ways")
        done = got.where("kind = 0").drop("kind")
        known = done if known is None else stored(known.join(touched, "block", "left_anti").unionByName(done), "known")
        new = got.where("kind = 1").groupBy("id", "block").agg(F.min(F.struct("dist", "pred")).alias("m")).select("id", "m.dist", "m.pred", "block")
        old = known.select("id", F.struct("dist", "pred").alias("o"))
        new = stored(new.join(old, "id", "left").where("o IS NULL OR dist < o.dist OR dist = o.dist AND o.pred >= 0 AND pred < o.pred").select("id", "dist", "pred", "block"), "ways")
    out = alone if known is None else known.select("id", "dist", "pred").unionByName(alone)
    return out.select("id", "dist", F.when(F.col("pred") >= 0, F.col("pred")).alias("pred"))


def path_to(paths: DataFrame, target: DataFrame) -> DataFrame:
    """target, pos (0 at the target), id: the way from each target back to its start. Known parts of the ways double each
    round, by steps of twice the length."""
    out = target.select(F.col("id").alias("target"), F.lit(0).alias("pos"), "id")
    jump, step = paths.where("pred IS NOT NULL").select("id", F.col("pred").alias("to")), 1
    while True:
        more = stored(out.join(jump, "id").select("target", (F.col("pos") + step).alias("pos"), F.col("to").alias("id")), "path")
        if more.isEmpty():
            return out
        out, step = stored(out.unionByName(more), "path"), 2 * step
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        jump = stored(jump.join(far, "to").select("id", F.col("to2").alias("to")), "jumps")


def parts_after_cut(half: DataFrame, cut: DataFrame) -> DataFrame:
    """id, component, side: components once the edges of cut (u, v) are gone; side 2 is the second largest one (of equal
    ones the one with the greater id), side 1 all the others."""
    c = stored(components(without_edges(half, cut)), "parts")
    size = c.groupBy("component").agg(F.count("*").alias("n"))
    second = size.orderBy(F.desc("n"), "component").limit(2).groupBy().agg(F.count("*").alias("k"), F.min_by("component", F.struct("n", -F.col("component"))).alias("second"))
    return c.crossJoin(F.broadcast(second)).select("id", "component", F.when((F.col("k") > 1) & (F.col("component") == F.col("second")), 2).otherwise(1).cast("long").alias("side"))  # second: one row


def expand_pockets(half: DataFrame, source: DataFrame, sink: DataFrame) -> DataFrame:
    """id, side: source (1) and sink (2) with all that only one of them reaches without passing the other."""
    a, b = reachable(half, source, sink), reachable(half, sink, source)
    one = source.select("id").union(a.join(b, "id", "left_anti")).distinct().select("id", F.lit(1).cast("long").alias("side"))
    return one.unionByName(sink.select("id").union(b.join(a, "id", "left_anti")).distinct().select("id", F.lit(2).cast("long").alias("side")))


def clip(segments: DataFrame, x_low: float, y_low: float, x_high: float, y_high: float) -> DataFrame:
    """segments (u, v, x1, y1, x2, y2) cut at a closed frame: the part inside, with cut_u and cut_v where an end moved.
    Segments that miss the frame, or touch it in a point, go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low, high, inside = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for d, p, a, b in ((dx, "x1", x_low, x_high), (dy, "y1", y_low, y_high)):
        t, s = (F.lit(a) - F.col(p)) / F.when(d != 0, d), (F.lit(b) - F.col(p)) / F.when(d != 0, d)
        low.append(F.coalesce(F.least(t, s), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(t, s), F.lit(1.0)))
        inside = inside & ((d != 0) | F.col(p).between(a, b))
    s = segments.withColumns({"t0": F.greatest(*low), "t1": F.least(*high)}).where(inside & (F.col("t0") < F.col("t1")))
    at = lambda p, d, t: F.col(p) + F.col(t) * d
    return s.select("u", "v", at("x1", dx, "t0").alias("x1"), at("y1", dy, "t0").alias("y1"), at("x1", dx, "t1").alias("x2"), at("y1", dy, "t1").alias("y2"), (F.col("t0") > 0).alias("cut_u"), (F.col("t1") < 1).alias("cut_v"))
