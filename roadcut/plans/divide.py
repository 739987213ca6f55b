"""Dividing a face graph into connected regions under a maximum weight."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut.operators import graph, regions
from roadcut.plans import kernels
from roadcut.plans.planecut import Plane
from roadcut.plans.store import stored

#: Faces of a region that one worker takes; larger regions are first cut along clusters of faces. A worker goes on with
#: pieces of up to FINISH faces by itself. CELLS: the grid of clusters over a large region, each way.
BOUND, FINISH, CELLS = 100_000, 4_000, 64

_ALGORITHMS: dict[str, Callable[..., DataFrame]] = {}


def register_algorithm(name: str, divide: Callable[..., DataFrame]) -> None:
    """divide(faces, dual, most, **options) returns face, region."""
    _ALGORITHMS[name] = divide


def divide(algorithm: str, faces: DataFrame, dual: DataFrame, most: float, **options) -> DataFrame:
    return _ALGORITHMS[algorithm](faces, dual, most, **options)


def reduced(faces: DataFrame, most: float) -> DataFrame:
    """Faces with weights brought under most; the full ones in weight_full."""
    from roadcut.functions import geometry as G

    return faces.withColumns({"weight_full": F.col("weight").cast("double"), "weight": G.reduced(F.col("weight").cast("double"), most)})


_LISTS = {"near": "array<long>", "border": "array<double>", "src": "array<long>", "dst": "array<long>", "length": "array<double>", "x": "array<double>", "y": "array<double>"}


def shapes(faces: DataFrame, dual: DataFrame, traced: DataFrame | None = None) -> DataFrame:
    """face, cx, cy, weight and lists of its neighbours and, of traced ones, its half-edges: all that a worker needs to know
    of a face stands in one row."""
    out = faces.select(F.col("face").cast("long").alias("face"), *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "weight")))
    near = dual.groupBy(F.col("f1").alias("face")).agg(F.sort_array(F.collect_list(F.struct(F.col("f2").alias("near"), F.col("length").alias("border")))).alias("n"))
    out, lists = out.join(near, "face", "left"), {"near": "n.near", "border": "n.border"}
    if traced is not None:
        edges = traced.groupBy("face").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "length", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e"))
        out = out.join(edges, "face", "left")
        lists |= {c: f"e.{c}" for c in ("src", "dst", "length", "x", "y")}
    return stored(out.select("face", "cx", "cy", "weight", *(F.coalesce(F.col(at).cast(_LISTS[c]), F.expr(f"cast(array() AS {_LISTS[c]})")).alias(c) for c, at in lists.items())), "shapes")


def _flat(t: pa.Table, lists: list[str]) -> list[tuple]:
    """Rows (entries of the lists, face) of a worker's faces."""
    cols = [t[c].combine_chunks() for c in lists]
    n = np.diff(cols[0].offsets.to_numpy())
    return list(zip(*(c.flatten().to_pylist() for c in cols), np.repeat(t["face"].to_numpy(), n).tolist()))


def _inside(t: pa.Table) -> tuple[list[tuple], list[tuple], list[tuple] | None]:
    """Of a worker's faces, in order of face: nodes (face, cx, cy, weight), borders among them (f1 < f2, length), and the
    half-edges (src, dst, length, face, x, y) where they are known."""
    t = t.sort_by("face")
    nodes = list(zip(*(t[c].to_pylist() for c in ("face", "cx", "cy", "weight"))))
    own = {n[0] for n in nodes}
    rows = [(f, g, w) for g, w, f in _flat(t, ["near", "border"]) if f < g and g in own]
    plane = [(a, b, w, f, x, y) for a, b, w, x, y, f in _flat(t, ["src", "dst", "length", "x", "y"])] if "src" in t.column_names else None
    return nodes, rows, plane


def _per_region(kernel: Callable, shape: DataFrame, assignment: DataFrame, count: int) -> DataFrame:
    """kernel(nodes, rows, plane) -> face: part, for each of count regions by itself; a region's parts are named by their
    least face."""

    def run(t):
        part = kernel(*_inside(t))
        least: dict[int, int] = {}
        for f, p in part.items():
            least[p] = min(f, least.get(p, f))
        return pa.table({"face": pa.array(list(part), pa.int64()), "region": pa.array([least[p] for p in part.values()], pa.int64())})

    work = assignment.select("face", "region").join(shape, "face").repartition(_tasks(shape, count), "region")
    return work.groupBy("region").applyInArrow(run, "face long, region long")


def _tasks(df: DataFrame, count: int) -> int:
    """Enough partitions for so many groups, several times those that run at once at most."""
    return max(1, min(3 * count, 8 * df.sparkSession.sparkContext.defaultParallelism))


def _start(faces: DataFrame, dual: DataFrame) -> DataFrame:
    """First regions: connected components of the face graph, the larger ones in pieces of up to BOUND faces."""
    half = dual.select(F.col("f1").alias("src"), F.col("f2").alias("dst"), "length")
    c = graph.components(half, faces.select(F.col("face").alias("id")))
    return _bounded(faces, dual, stored(c.select(F.col("id").alias("face"), F.col("component").alias("region")), "assignment"))


def _bounded(faces: DataFrame, dual: DataFrame, now: DataFrame) -> DataFrame:
    """Cuts regions of more than BOUND faces in two until there are none, without gathering one: the faces of a grid cell
    are joined to connected clusters, and a worker cuts the graph of the clusters."""
    cells = CELLS
    while True:
        big = stored(now.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > BOUND).select("region"), "big")
        count = big.count()
        if not count:
            return now
        f = now.join(F.broadcast(big), "region", "left_semi").join(faces.select("face", *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "weight"))), "face")
        f = stored(f, "large")
        box = f.groupBy("region").agg(F.min("cx").alias("xl"), F.max("cx").alias("xh"), F.min("cy").alias("yl"), F.max("cy").alias("yh"))
        step = F.greatest(F.col("xh") - F.col("xl"), F.col("yh") - F.col("yl"), F.lit(1e-9)) / cells
        at = f.join(F.broadcast(box), "region")  # big and box: a row for every BOUND faces at most
        at = stored(at.select("face", "region", F.struct("region", F.floor((F.col("cx") - F.col("xl")) / step), F.floor((F.col("cy") - F.col("yl")) / step)).alias("cell")), "cells")
        a, b = at.select(F.col("face").alias("f1"), F.col("cell").alias("c1")), at.select(F.col("face").alias("f2"), F.col("cell").alias("c2"))
        d = stored(dual.join(a, "f1").join(b, "f2").where("c1.region = c2.region"), "inside")
        cluster = graph.components(d.where("c1 = c2").select(F.col("f1").alias("src"), F.col("f2").alias("dst"), "length"), f.select(F.col("face").alias("id")))
        cluster = stored(f.join(cluster.withColumnRenamed("id", "face"), "face").select("face", "region", "cx", "cy", "weight", F.col("component").alias("cluster")), "clusters")
        a, b = (cluster.select(F.col("face").alias(f"f{i}"), F.col("cluster").alias(f"k{i}")) for i in (1, 2))
        coarse = cluster.groupBy("region", F.col("cluster").alias("face")).agg(*(F.avg(c).alias(c) for c in ("cx", "cy")), F.sum("weight").alias("weight"))
        borders = d.where("c1 <> c2").join(a, "f1").join(b, "f2").groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.sum("length").alias("length"))
        coarse = stored(coarse, "coarse")
        got = _per_region(lambda n, r, p: _halves(n, r), shapes(coarse, borders), coarse, count)
        got = stored(cluster.drop("region").join(got.withColumnRenamed("face", "cluster"), "cluster").select("face", "region"), "halves")
        if got.select("region").distinct().count() == count:
            cells *= 4
        now = stored(now.join(F.broadcast(big), "region", "left_anti").select("face", "region").unionByName(got), "assignment")


def _halves(nodes, rows, share: float = 0.25, plane=None) -> dict[int, int]:
    part, _ = kernels.bisect(nodes, rows, share, plane)
    adj, out, label = kernels.adjacency(rows), {}, 0
    for side in (0, 1):  # a side may fall apart: each piece goes on by itself
        for comp in kernels.connected({f for f, p in part.items() if p == side}, adj):
            out |= dict.fromkeys(comp, label)
            label += 1
    return out


def inertial_flow(faces: DataFrame, dual: DataFrame, most: float, share: float = 0.25, traced: DataFrame | None = None) -> DataFrame:
    """face, region: every region that weighs most or more is divided by a cut between its ends, all open regions of a
    round in parallel, until none is left. A single face stays as it is.

    With the traced half-edges, cuts are short and even ways through the plane graph, else least cuts by maximum flow."""
    shape = shapes(faces, dual, traced)
    now = _start(faces, dual)
    while True:
        w = now.join(shape.select("face", "weight"), "face").groupBy("region").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        heavy = stored(w.where((F.col("w") >= most) & (F.col("n") > 1)).select("region"), "open")
        if not (count := heavy.count()):
            return now
        split = _per_region(lambda n, r, p: kernels.divided(n, r, p, most, share, FINISH), shape, now.join(heavy, "region", "left_semi"), count)
        now = stored(now.join(heavy, "region", "left_anti").select("face", "region").unionByName(split), "assignment")


def cuts(faces: DataFrame, dual: DataFrame, traced: DataFrame, assignment: DataFrame, share: float = 0.25) -> DataFrame:
    """Of each region, between the sets grown from its ends: region, flow (the greatest flow), least and balanced (lengths of
    the least and of the balanced way through the plane graph; null where the sets touch no common rim), apart (whether
    both ways separate the sets)."""

    def run(key, t):
        nodes, rows, plane_rows = _inside(t)
        adj, plane = kernels.adjacency(rows), Plane(plane_rows)
        _, source, sink = kernels.ends(nodes, adj, share)
        flow, _ = kernels.max_flow(adj, source, sink)
        two = [plane.least_cut(source, sink), plane.balanced_cut(source, sink, {n[0]: n[3] for n in nodes})]
        apart = all(c is None or source <= c[1] and not c[1] & sink for c in two)
        return pa.table({"region": [key[0].as_py()], "flow": [flow], **{k: pa.array([c[0] if c else None], pa.float64()) for k, c in zip(("least", "balanced"), two)}, "apart": [apart]})

    work = assignment.select("face", "region").join(shapes(faces, dual, traced), "face")
    return work.groupBy("region").applyInArrow(run, "region long, flow double, least double, balanced double, apart boolean")


def _grown(kernel: Callable, faces: DataFrame, dual: DataFrame) -> DataFrame:
    start = _start(faces, dual)
    count = start.select("region").distinct().count()
    return stored(_per_region(kernel, shapes(faces, dual), start, count), "assignment")


def bubbles_in_turn(faces: DataFrame, dual: DataFrame, most: float) -> DataFrame:
    """face, region: regions grown one after the other from the leftmost free face."""
    return _grown(lambda n, r, p: kernels.bubbles_in_turn(n, r, most), faces, dual)


def bubbles_together(faces: DataFrame, dual: DataFrame, most: float) -> DataFrame:
    """face, region: regions grown at once from seeds."""

    def kernel(nodes, rows, _):
        total = sum(n[3] for n in nodes)
        count = max(1, int(total // (0.9 * most)))
        order = sorted(nodes, key=lambda n: (round((n[1] ** 2 + n[2] ** 2) ** 0.5, 6), n[0]))
        step = max(1, len(order) // count)
        return kernels.bubbles_together(nodes, rows, [n[0] for n in order[::step][:count]], most)

    return _grown(kernel, faces, dual)


register_algorithm("IF", inertial_flow)
register_algorithm("BUS", bubbles_in_turn)
register_algorithm("BUP", bubbles_together)


def rebalance(faces: DataFrame, dual: DataFrame, assignment: DataFrame, most: float, rounds: int | None = None) -> DataFrame:
    """face, region with fewer or more even regions: first regions are dissolved into neighbours with room, as long as one
    can be; then light regions are joined with a neighbour and divided anew while weights vary by more than a tenth and
    a join is accepted. ``rounds``: no more than so many rounds of each.

    A round tries all candidates at once, each in a worker, and carries out those that don't touch each other, the best
    ones first. A join is kept if the cut doesn't grow (by half at most when the light region passes half of most) and the
    weights come closer, so both loops end.
    """
    shape = shapes(faces, dual)
    return _evened(shape, dual, _fewer(shape, dual, assignment, most, rounds), most, rounds)


def _turns(rounds: int | None):
    return itertools.count() if rounds is None else range(rounds)


def _fewer(shape: DataFrame, dual: DataFrame, now: DataFrame, most: float, rounds: int | None) -> DataFrame:
    failed = None  # regions that can't be dissolved as long as nothing around them changes
    for _ in _turns(rounds):
        weights = stored(regions.region_weights(shape, now), "weights")
        links = stored(regions.region_graph(dual, now), "links")
        able = regions.best_half(regions.neighbour_capacity(links, weights, most).where("capacity >= weight"))
        able = stored(able.select("region", F.struct(F.col("capacity").alias("capacity"), F.xxhash64("region").alias("turn")).alias("score")), "able")
        left = able if failed is None else stored(able.join(failed, "region", "left_anti"), "able")
        if not (count := left.count()):
            break
        moved = stored(_dissolved(shape, now, links, left.select("region"), most, count), "moved")
        can = stored(left.join(moved.select(F.col("a").alias("region")), "region", "left_semi"), "can")
        if can.isEmpty():
            break
        chosen = stored(_apart(can, links), "chosen")
        moved = stored(moved.join(chosen.withColumnRenamed("region", "a"), "a", "left_semi"), "moved")
        lost = left.select("region").join(can.select("region"), "region", "left_anti")
        changed = moved.select(F.col("new").alias("region")).unionByName(chosen.select("region")).distinct()
        near = links.join(changed.withColumnRenamed("region", "r2"), "r2", "left_semi").select(F.col("r1").alias("region")).unionByName(changed)
        failed = stored((lost if failed is None else lost.unionByName(failed)).join(near, "region", "left_anti"), "failed")
        now = _moved(now, moved)
    return now


def _apart(able: DataFrame, links: DataFrame) -> DataFrame:
    """region: those whose score is greater than that of all others in reach of two steps."""
    best = able
    for _ in range(2):
        near = links.join(best.withColumnRenamed("region", "r2"), "r2").select(F.col("r1").alias("region"), "score")
        best = best.unionByName(near).groupBy("region").agg(F.max("score").alias("score"))
    return able.join(best, ["region", "score"], "left_semi").select("region")


def _grouped(shape: DataFrame, now: DataFrame, groups: DataFrame, kernel: Callable, count: int) -> DataFrame:
    """a, b, face, new: kernel(a, b, regions, nodes, rows) -> face: new region, or None; for each of count groups (a, b,
    region) of regions, by itself. A face goes to each group that holds its region."""
    work = now.select("face", "region").join(groups, "region").join(shape, "face").repartition(_tasks(shape, count), "a", "b")

    def run(key, t):
        a, b = (k.as_py() for k in key)
        of = dict(zip(t["face"].to_pylist(), t["region"].to_pylist()))
        nodes, rows, _ = _inside(t)
        found = kernel(a, b, of, nodes, rows) or {}
        names = {"a": [a] * len(found), "b": [b] * len(found), "face": list(found), "new": list(found.values())}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in names.items()})

    return work.groupBy("a", "b").applyInArrow(run, "a long, b long, face long, new long")


def _dissolved(shape: DataFrame, now: DataFrame, links: DataFrame, chosen: DataFrame, most: float, count: int) -> DataFrame:
    """a (a region that can be dissolved), face, new."""
    own = chosen.select(F.col("region").alias("a"), F.col("region").alias("b"), "region")
    groups = own.unionByName(links.join(own.select("a", "b"), F.col("r1") == F.col("a")).select("a", "b", F.col("r2").alias("region")))

    def kernel(region, _, of, nodes, rows):
        total: dict[int, float] = {}
        for f, _, _, w in nodes:
            total[of[f]] = total.get(of[f], 0.0) + w
        total.pop(region)
        return kernels.dissolve(region, of, {n[0]: n[3] for n in nodes}, kernels.adjacency(rows), total, most)

    return _grouped(shape, now, groups, kernel, count)


def _evened(shape: DataFrame, dual: DataFrame, now: DataFrame, most: float, rounds: int | None) -> DataFrame:
    for _ in _turns(rounds):
        weights = stored(regions.region_weights(shape, now), "weights")
        s = weights.agg(F.stddev_pop("weight").alias("d"), F.avg("weight").alias("m")).first()
        if not s.m or s.d <= 0.1 * s.m:
            break
        light = regions.lightest(weights).select(F.col("region").alias("r1"), F.col("weight").alias("w1"))
        near = regions.region_graph(dual, now).join(light, "r1").join(weights.select(F.col("region").alias("r2"), F.col("weight").alias("w2")), "r2")
        pairs = near.select(F.col("r1").alias("a"), F.col("r2").alias("b"), F.struct(-F.col("w1"), -F.col("r1"), "w2", -F.col("r2")).alias("score"))
        pairs = stored(pairs, "pairs")  # the lightest region first, and its heaviest neighbour
        groups = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("region"))
        moved = stored(_grouped(shape, now, groups, lambda a, b, of, n, r: _rejoined(a, of, n, r, most), pairs.count()), "moved")
        can = stored(pairs.join(moved.select("a", "b"), ["a", "b"], "left_semi"), "can")
        if can.isEmpty():
            break
        best = can.select("score", F.explode(F.array("a", "b")).alias("region")).groupBy("region").agg(F.max("score").alias("score"))
        chosen = can.join(best.select(F.col("region").alias("a"), "score"), ["a", "score"], "left_semi").join(best.select(F.col("region").alias("b"), "score"), ["b", "score"], "left_semi")
        now = _moved(now, moved.join(chosen.select("a", "b"), ["a", "b"], "left_semi"))
    return now


def _moved(now: DataFrame, moved: DataFrame) -> DataFrame:
    return stored(now.join(moved.select("face", "new"), "face", "left").select("face", F.coalesce("new", "region").alias("region")), "assignment")


def _rejoined(light: int, of: dict[int, int], nodes: list[tuple], rows: list[tuple], most: float) -> dict[int, int] | None:
    own, other = (sum(n[3] for n in nodes if (of[n[0]] == light) == mine) for mine in (True, False))
    part, cut = kernels.bisect(nodes, rows, max(0.05, min(0.45, 1 - most / max(own + other, 1e-9))))
    before = sum(w for a, b, w in rows if of[a] != of[b])
    w = [sum(n[3] for n in nodes if part[n[0]] == p) for p in (0, 1)]
    adj = kernels.adjacency(rows)
    whole = all(len(kernels.connected({f for f, p in part.items() if p == q}, adj)) == 1 for q in (0, 1))
    slack = 1.5 if min(w) > most / 2 >= own else 1.0
    if not whole or max(w) >= most or cut > slack * before or abs(w[0] - w[1]) >= abs(own - other) - 1e-9:
        return None
    name = {p: min(f for f, q in part.items() if q == p) for p in (0, 1)}
    return {f: name[p] for f, p in part.items()}
