import math
import random

import pytest
from pyspark.sql import functions as F

from roadcut.functions import geometry as G
from roadcut.operators import faces as D
from roadcut.operators import graph, planar, regions, tours
from roadcut.plans import city, divide, kernels, planecut
from roadcut.sources import text
from tests import fixtures


def read(spark, tmp_path, raw):
    (tmp_path / "g.txt").write_text(raw)
    v, h = text.read_graph(spark, str(tmp_path / "g.txt"))
    return v, graph.half_edges(h.withColumnsRenamed({"src": "u", "dst": "v"}))


def traced(v, h):
    t = D.trace(D.angular(h, v))
    return t, D.interior(D.faces(t))


def turned(ring):
    i = ring.index(min(ring))
    return tuple(ring[i:] + ring[:i])


def canonical(ring):
    return min(tuple(ring[i:] + ring[:i]) for i in range(len(ring)))


def test_read_graph(spark, tmp_path):
    v, h = read(spark, tmp_path, fixtures.HUB.replace(" 12 8 ", " 12,0 8.0\n"))
    assert v.count() == 8 and h.count() == 16
    v, h = read(spark, tmp_path, fixtures.APART)
    assert graph.components(h).select("component").distinct().count() == 2
    v, h = read(spark, tmp_path, "0\n")
    assert v.count() == 0 and h.count() == 0


@pytest.mark.parametrize(("raw", "rings", "outer"), [
    (fixtures.BOX, {(11, 12, 13, 14): -15.0}, 15.0),
    (fixtures.HUB, {(1, 2, 9): -16.0, (2, 3, 9): -24.0, (1, 9, 3, 4, 7, 4): -56.0}, 96.0),
    (fixtures.BRIDGE, {(5, 6, 7): -2.0, (1, 2, 3, 4, 1, 5, 7, 6, 5): -98.0}, 100.0),
])
def test_faces(spark, tmp_path, raw, rings, outer):
    v, h = read(spark, tmp_path, raw)
    v = graph.linked_vertices(v, h)
    f = D.faces(D.trace(D.angular(h, v))).collect()
    assert {canonical(list(r.ring)): r.area for r in f if not r.is_external} == {canonical(list(k)): a for k, a in rings.items()}
    assert [r.area for r in f if r.is_external] == [outer]
    n, e = v.count(), h.count() // 2
    assert n - e + len(f) == 2


def test_dual_edges(spark, tmp_path):
    v, h = read(spark, tmp_path, fixtures.HUB)
    t, f = traced(v, h)
    name = {r.face: canonical(list(r.ring)) for r in f.collect()}
    got = {(name[r.f1], name[r.f2]): r.length for r in D.dual_edges(t, f).collect()}
    a, b, c = (1, 2, 9), (2, 3, 9), (1, 9, 3, 4, 7, 4)
    want = {(a, b): 6, (a, c): 6, (b, c): 9}
    assert got == want | {(y, x): w for (x, y), w in want.items()}


def test_planarize(spark, tmp_path):
    v, h = read(spark, tmp_path, fixtures.CROSSED)
    pv, pe = planar.planarize(v, graph.undirected(h), 7.0, 0.01)
    assert pv.count() == 9 and pe.count() == 11
    assert traced(pv, graph.half_edges(pe))[1].count() == 3
    sv, se = planar.planarize(v, graph.undirected(h), 7.0, 0.01, strict_bbox=True)
    assert sv.count() == 8 and se.count() == 9


def test_planarize_random_segments(spark):
    """Euler's formula holds and no crossing is left."""
    rng = random.Random(1)
    v = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(24)]
    e = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(22)}
    vd = spark.createDataFrame(v, "id long, x double, y double")
    ed = planar.placed(spark.createDataFrame(list(e), "u long, v long"), vd).select("u", "v", G.distance("x1", "y1", "x2", "y2").alias("length"))
    pv, pe = planar.planarize(vd, ed, 25.0, 1e-6)
    h = graph.half_edges(pe)
    n, m = h.select("src").distinct().count(), pe.count()
    c = graph.components(h).select("component").distinct().count()
    faces = D.faces(D.trace(D.angular(h, pv)))
    assert n - m + faces.count() == 2 * c
    s = planar.placed(pe, pv).withColumn("seg", F.col("u") * 1000 + F.col("v"))
    left = planar.crossings(s, 25.0).join(s.select(F.col("seg").alias("a_seg"), "x1", "y1", "x2", "y2"), "a_seg").collect()
    assert all(min((r.x - r.x1) ** 2 + (r.y - r.y1) ** 2, (r.x - r.x2) ** 2 + (r.y - r.y2) ** 2) < 1e-9 for r in left)


def test_collinear_overlap(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 4.0, 0.0), (4, 14.0, 0.0)], "id long, x double, y double")
    e = spark.createDataFrame([(1, 2, 10.0), (3, 4, 10.0)], "u long, v long, length double")
    pv, pe = planar.planarize(v, e, 5.0, 0.01)
    assert sorted((r.u, r.v) for r in pe.collect()) == [(1, 3), (2, 3), (2, 4)] and pv.count() == 4


@pytest.mark.parametrize(("ring", "inside", "outside"), [
    ([(0, 0), (4, 1), (1, 5)], [(1, 2), (2, 2)], [(4, 4)]),
    ([(10, 0), (14, 0), (15, 3), (12, 6), (9, 3)], [(12, 2), (11, 4)], [(15, 5)]),
    ([(20, 0), (28, 0), (28, 6), (24, 2), (20, 6)], [(21, 2), (27, 1)], [(24, 4)]),
])
def test_point_in_ring(spark, ring, inside, outside):
    shape = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring))
    rows = spark.createDataFrame([(float(x), float(y), True) for x, y in inside] + [(float(x), float(y), False) for x, y in outside], "x double, y double, want boolean")
    assert rows.select((G.in_ring("x", "y", shape) == F.col("want")).alias("ok")).where("NOT ok").count() == 0


def test_paths_and_reach(spark):
    pts = {1: (0, 0), 2: (3, 0), 3: (0, 4), 4: (3, 4), 5: (7, 1), 6: (7, 5), 8: (5, 9), 9: (0, 9)}
    rows = [(a, b, math.dist(pts[a], pts[b])) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4), (2, 5), (4, 6), (5, 6), (6, 8), (4, 8), (3, 9), (8, 9))]
    h = graph.half_edges(spark.createDataFrame(rows, "u long, v long, length double"))
    start = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r.dist for r in graph.shortest_paths(h, start).collect()}
    dist, _ = kernels.dijkstra(kernels.adjacency(rows), [1])
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in dist.items()}
    way = {r.pos: r.id for r in graph.path_to(graph.shortest_paths(h, start), spark.createDataFrame([(8,)], "id long")).collect()}
    assert way[0] == 8 and way[max(way)] == 1
    blocked = spark.createDataFrame([(4,), (5,)], "id long")
    assert {r.id for r in graph.reachable(h, start, blocked).collect()} == {1, 2, 3, 6, 8, 9}


def rough_lattice(rng, w, h, missing):
    """Faces of a jittered lattice with holes: half-edges (clockwise rings), centres."""
    at = {j * (w + 1) + i: (100 * i + rng.uniform(-30, 30), 100 * j + rng.uniform(-30, 30)) for i in range(w + 1) for j in range(h + 1)}
    half, centre = [], {}
    for f in range(w * h):
        if rng.random() >= missing:
            v = f // w * (w + 1) + f % w
            ring = [v, v + w + 1, v + w + 2, v + 1]
            half += [(a, b, round(math.dist(at[a], at[b]), 6), f, *at[a]) for a, b in zip(ring, ring[1:] + ring[:1])]
            centre[f] = tuple(sum(at[u][k] for u in ring) / 4 for k in (0, 1))
    return half, centre


def test_cuts_through_the_plane_graph():
    """The least way is as long as the greatest flow; both ways separate the sets, and the balanced one is the more even."""
    rng, seen, even = random.Random(5), 0, [0, 0]
    for _ in range(150):
        half, centre = rough_lattice(rng, rng.randint(1, 8), rng.randint(3, 12), rng.choice([0, 0.05, 0.15]))
        side = {(a, b): f for a, b, _, f, _, _ in half}
        rows = [(f, side[b, a], w) for a, b, w, f, _, _ in half if a < b and (b, a) in side]
        adj = kernels.adjacency(rows)
        faces = kernels.connected(set(centre), adj)[0]
        if len(faces) < 4:
            continue
        rows, half = [r for r in rows if r[0] in faces], [r for r in half if r[3] in faces]
        adj = kernels.adjacency(rows)
        weight = {f: float(rng.randint(0, 50)) for f in faces}
        _, source, sink = kernels.ends([(f, *centre[f], weight[f]) for f in sorted(faces)], adj, 0.25)
        flow, _ = kernels.max_flow(adj, source, sink)
        plane = planecut.Plane(half)
        least, balanced = plane.least_cut(source, sink), plane.balanced_cut(source, sink, weight)
        if least is None:
            continue
        seen += 1
        for value, own in (least, balanced):
            assert source <= own and not own & sink
            assert value == pytest.approx(sum(w for a, b, w in rows if (a in own) != (b in own)))
        assert least[0] == pytest.approx(flow) and balanced[0] >= least[0] - 1e-6
        for k, (_, own) in enumerate((least, balanced)):
            even[k] += abs(sum(weight[f] for f in own) - sum(weight.values()) / 2)
    assert seen > 100 and even[1] < even[0]


def test_large_regions_are_cut_along_clusters(spark, lattice, monkeypatch):
    faces, dual = lattice
    monkeypatch.setattr(divide, "BOUND", 30)
    monkeypatch.setattr(divide, "CELLS", 4)
    start = divide._start(faces, dual)
    check(faces, dual, start, 1e9)
    assert start.groupBy("region").count().agg({"count": "max"}).first()[0] <= 30


def test_paths_across_blocks(spark):
    """Shortest ways, reachability and components, with as many blocks as partitions."""
    rng = random.Random(9)
    edges = {(rng.randrange(60), rng.randrange(60)): float(rng.randint(1, 9)) for _ in range(90)}
    half = {}
    for (a, b), w in edges.items():
        if a != b:
            half[a, b] = half[b, a] = w
    adj: dict = {}
    for (a, b), w in half.items():
        adj.setdefault(a, {})[b] = w
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        h = spark.createDataFrame([(a, b, w) for (a, b), w in half.items()], "src long, dst long, length double")
        s = spark.createDataFrame([(3,), (17,), (99,)], "id long")
        got = {r.id: (r.dist, r.pred) for r in graph.shortest_paths(h, s).collect()}
        paths = graph.path_to(graph.shortest_paths(h, s), spark.createDataFrame([(v,) for v in sorted(adj)[:5]], "id long")).collect()
        parts = {r.id: r.component for r in graph.components(h).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    dist, _ = kernels.dijkstra(adj, [3, 17, 99])
    want = {v: (d, None if v in (3, 17, 99) else min(u for u in adj[v] if u in dist and dist[u] + adj[v][u] == d)) for v, d in dist.items()}
    assert got == want
    for v in sorted(adj)[:5]:
        way = [r.id for r in sorted((r for r in paths if r.target == v), key=lambda r: r.pos)]
        assert way[0] == v and (v not in dist or way[-1] in (3, 17, 99)) and all(want[a][1] == b for a, b in zip(way, way[1:]))
    for comp in kernels.connected(set(adj), adj):
        assert {parts[v] for v in comp} == {min(comp)}


@pytest.fixture(scope="module")
def lattice(spark):
    """A 12 by 9 face graph with weights."""
    rng = random.Random(6)
    faces = [(y * 12 + x, x + 0.5, y + 0.5, float(rng.randint(0, 9))) for y in range(9) for x in range(12)]
    dual = [(f, g, 1.0 + (f * 7 + g * 7) % 5) for f, *_ in faces for g in (f - 1 if f % 12 else -1, f + 1 if f % 12 < 11 else -1, f - 12, f + 12) if 0 <= g < 108]
    return spark.createDataFrame(faces, "face long, cx double, cy double, weight double"), spark.createDataFrame(dual, "f1 long, f2 long, length double")


@pytest.mark.parametrize("name", ["IF", "BUS", "BUP"])
def test_divisions(lattice, name):
    faces, dual = lattice
    a = divide.divide(name, faces, dual, 60.0)
    check(faces, dual, a, 60.0)


def check(faces, dual, a, most):
    rows = a.collect()
    assert sorted(r.face for r in rows) == sorted(r.face for r in faces.collect())
    w = {r.face: r.weight for r in faces.collect()}
    adj = kernels.adjacency((r.f1, r.f2, r.length) for r in dual.collect())
    for region in {r.region for r in rows}:
        members = {r.face for r in rows if r.region == region}
        assert region == min(members) or region in members
        assert sum(w[f] for f in members) <= most
        assert len(kernels.connected(members, adj)) == 1


def test_rebalance(lattice):
    faces, dual = lattice
    before = divide.divide("IF", faces, dual, 60.0)
    after = divide.rebalance(faces, dual, before, 60.0, rounds=3)
    n = [x.select("region").distinct().count() for x in (before, after)]
    assert n[1] <= n[0]
    assert after.count() == 108 and regions.region_weights(faces, after).where("weight > 60").count() == 0


def test_rebalance_goes_on_until_done(spark):
    """Sixty regions of one face in a row, of which all but a few can be dissolved."""
    faces = spark.createDataFrame([(i, i + 0.5, 0.5, 1.0) for i in range(60)], "face long, cx double, cy double, weight double").coalesce(1)
    dual = spark.createDataFrame([(i, j, 1.0) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "f1 long, f2 long, length double").coalesce(1)
    after = divide.rebalance(faces, dual, faces.selectExpr("face", "face AS region"), 20.0)
    check(faces, dual, after, 20.0)
    n = after.select("region").distinct().count()
    assert n < 20
    room = regions.neighbour_capacity(regions.region_graph(dual, after), regions.region_weights(faces, after), 20.0).where("capacity >= weight")
    assert room.count() < 2 or n < 8


def test_registered_algorithm(lattice):
    divide.register_algorithm("one", lambda faces, dual, most: faces.selectExpr("face", "0L AS region"))
    assert divide.divide("one", *lattice, 1.0).select("region").distinct().count() == 1


def test_sinks(spark, tmp_path, lattice):
    v, h = read(spark, tmp_path, fixtures.BRIDGE)
    text.write_graph(v, h, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.txt"))
    v2, h2 = text.read_graph(spark, str(part))
    assert sorted(v2.collect()) == sorted(v.collect()) and sorted(h2.collect()) == sorted(h.select("src", "dst", "length").collect())
    faces, dual = lattice
    a = divide.divide("BUS", faces, dual, 200.0)
    cuts = regions.cut_per_region(dual, a)
    text.write_division(faces, a, cuts, str(tmp_path / "div"))
    assert len(list((tmp_path / "div").glob("region=*"))) == a.select("region").distinct().count()
    s = regions.statistics(regions.region_weights(faces, a), cuts, 200.0)
    assert '"region_count"' in text.metrics_json(s).first().value


@pytest.fixture(scope="module")
def squares(spark):
    """A square grid of 5 by 5 vertices (id = 10 * y + x): vertices, half-edges, traced half-edges, inner faces; name: the
    face of each cell by its lower left corner."""
    v = spark.createDataFrame([(10 * y + x, float(x), float(y)) for x in range(5) for y in range(5)], "id long, x double, y double")
    e = [(10 * y + x, 10 * y + x + s, 1.0) for x in range(5) for y in range(5) for s in (1, 10) if (x < 4 or s == 10) and (y < 4 or s == 1)]
    h = D.angular(graph.half_edges(spark.createDataFrame(e, "u long, v long, length double")), v)
    t, f = traced(v, graph.half_edges(spark.createDataFrame(e, "u long, v long, length double")))
    return v, h, t, f, {min(r.ring): r.face for r in f.collect()}


def test_boundary_rings_around_holes_and_corners(spark, squares):
    v, h, t, f, name = squares
    around = [0, 1, 2, 10, 12, 20, 21, 22]  # eight cells around that of 11
    a = spark.createDataFrame([(name[c], 1) for c in around] + [(name[c], 2) for c in (3, 13, 33)], "face long, region long")
    rows = regions.boundary_rings(t, a).orderBy("region", "ring", "pos").collect()
    rings = {}
    for r in rows:
        rings.setdefault((r.region, r.is_outer, r.ring), []).append(r.id)
    got = sorted((k[0], k[1], tuple(x)) for k, x in rings.items())
    assert got == [
        (1, False, (21, 11, 12, 22)),
        (1, True, (30, 31, 32, 33, 23, 13, 3, 2, 1, 0, 10, 20)),
        (2, True, (23, 24, 14, 4, 3, 13)),
        (2, True, (43, 44, 34, 33)),
    ]
    touching = spark.createDataFrame([(name[c], 1) for c in (0, 11)], "face long, region long")  # they share the vertex 11 only
    assert regions.boundary_rings(t, touching).where("id = 11").select("ring").distinct().count() == 2
    assert regions.boundary_rings(t, touching.limit(0)).count() == 0


def test_tour_and_its_faces(spark, squares):
    v, h, t, f, name = squares
    tree = spark.createDataFrame([(i, None if i == 0 else i - 1 if i < 10 else i - 10) for i in (10 * y + x for x in range(5) for y in range(5))], "id long, pred long")
    tour = tours.euler_tour(h, tree)
    walk = [r.src for r in tour.orderBy("pos").collect()]
    up = lambda x: [10 * y + x for y in range(5)] + [10 * y + x for y in (3, 2, 1)]
    assert walk == [0, 1, 2, 3, *up(4), 4, *up(3), 3, *up(2), 2, *up(1), 1, *up(0)]
    assert len(walk) == 48
    assert {r.id: r["size"] for r in tours.subtree_sizes(tour).collect()}[1] == 20
    w = f.select("face", F.lit(1).alias("weight"))
    got = {(r.before, r.after): r.weight for r in tours.leaf_weights(tour, tours.tour_faces(h, t, f, tour), w).collect()}
    assert got == {(44, 43): 4, (43, 42): 4, (42, 41): 4, (41, 40): 4, (40, 44): 0}
    assert tours.euler_tour(h, tree.limit(0)).count() == 0


def test_split_path_ends_inside_or_on_the_rim(spark, squares):
    v, h, t, f, name = squares
    outer = t.join(D.faces(t).where("is_external").select("face"), "face", "left_semi")
    path = spark.createDataFrame([("slit", 0, 2), ("slit", 1, 12), ("slit", 2, 22)], "path string, pos int, id long")
    got = {tuple(r) for r in tours.split_path(h, path, outer).select("src", "src_side", "dst", "dst_side").collect()}
    want = {(2, 1, 1, 0), (2, 2, 3, 0), (12, 1, 11, 0), (12, 2, 13, 0), (22, 0, 21, 0), (22, 0, 23, 0), (22, 0, 32, 0)}
    want |= {(c, d, a, b) for a, b, c, d in want}
    want |= {(2, s, 12, s) for s in (1, 2)} | {(12, s, 2, s) for s in (1, 2)} | {(12, s, 22, 0) for s in (1, 2)} | {(22, 0, 12, s) for s in (1, 2)}
    assert got == want


def test_masked_run_and_orders(spark):
    rings = spark.createDataFrame([(1, i, 10 + i) for i in range(6)] + [(2, 0, 7), (2, 1, 8)], "ring long, pos long, id long")
    mask = spark.createDataFrame([(1, 15), (1, 10), (1, 11), (1, 11)], "ring long, id long")
    got = [(r.ring, r.id, r.masked) for r in D.masked_run(rings, mask).orderBy("ring", "at").collect()]
    assert got == [(1, 15, True), (1, 10, True), (1, 11, True), (1, 12, False), (1, 13, False), (1, 14, False), (2, 7, False), (2, 8, False)]
    order = D.cyclic_order(rings, mask, spark.createDataFrame([(1, 11)], "ring long, id long"))
    assert [r.id for r in order.orderBy("nth").collect()] == [10, 15, 11]


def test_weights_arcs_and_runs(spark):
    e = spark.createDataFrame([(1, 2, 3.0, 4), (1, 2, 1.0, 5), (2, 1, 1.0, 1), (3, 3, 1.0, 1)], "u long, v long, length double, bandwidth long")
    assert sorted(map(tuple, graph.arcs(e).collect())) == [(1, 2, 3.0, 9), (2, 1, 1.0, 1)]
    assert tuple(graph.tiny_edges(e.limit(0)).first()) == (0, 0)
    w = graph.default_weights(spark.createDataFrame([(1, 5), (2, None)], "id long, weight long"))
    assert all(10 <= r.weight < 40 or (r.id, r.weight) == (1, 5) for r in w.collect()) and w.where("id = 1").first().weight == 5
    half = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0)], "src long, dst long, length double")
    assert sorted(map(tuple, tours.allowed(half, spark.createDataFrame([(1, 2)], "id long, dst long")).collect())) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert tours.allowed(half, spark.createDataFrame([(1, None)], "id long, dst long")).count() == 1
    runs = spark.createDataFrame([("a", 1, 10, 0, 1.0, 5, 3, 2, 4.0)], "city string, size int, most int, edges long, time double, memory long, regions long, ideal long, average_weight double")
    assert {r.metric: r.value for r in regions.roll_up_all(runs).collect()} == {"max_time": 1.0, "max_memory": 5.0, "avg_time_per_edge": None, "min_region_ratio": 1.5, "avg_region_ratio": 1.5, "max_region_ratio": 1.5, "avg_load_10": 0.4}


def test_points(spark, tmp_path):
    (tmp_path / "b.txt").write_text("2\n7 59,9 30,3 20 15\n8 59.8 30.2 10 10\n")
    assert sorted(map(tuple, text.read_points(spark, str(tmp_path / "b.txt")).collect())) == [(7, 30.3, 59.9, 30.0), (8, 30.2, 59.8, 10.0)]


def test_city(spark, tmp_path):
    """From files to files, on a jittered grid of streets."""
    rng = random.Random(8)
    n = 7
    at = {(x, y): (30.3 + x * 1e-3 + rng.uniform(-2e-4, 2e-4), 59.9 + y * 1e-3 + rng.uniform(-2e-4, 2e-4)) for x in range(n) for y in range(n)}
    lines = [str(n * n)]
    for (x, y), (lon, lat) in at.items():
        near = [(x + 1, y), (x, y + 1)]
        near = [q for q in near if q in at]
        lines.append(" ".join([f"{y * n + x} {lon} {lat} {len(near)}", *(f"{q[1] * n + q[0]} {at[q][0]} {at[q][1]} 80" for q in near)]))
    (tmp_path / "g.txt").write_text("\n".join(lines))
    rows = [f"{i} {59.9 + rng.uniform(0, 6e-3)} {30.3 + rng.uniform(0, 6e-3)} {rng.randint(5, 30)} {rng.randint(5, 30)}" for i in range(80)]
    (tmp_path / "b.txt").write_text("\n".join(["80", *rows]))
    s = city.run(spark, "IF", str(tmp_path / "g.txt"), str(tmp_path / "b.txt"), str(tmp_path / "out"), 900.0, 200.0).first()
    assert s.region_count >= s.min_region_count_estimate >= 1 and s.max_region_weight < 900
    assert s.dual_vertex_number == (n - 1) ** 2
    lines = next((tmp_path / "out" / "bounds").rglob("part-*")).read_text().split("\n")
    assert len(lines[-2].split()) == 1 and 0 < float(lines[-2]) < 900 and len({x.split()[0] for x in lines[:-2]}) == len(lines) - 2 >= 4
    for name in ("partition", "centers", "bounds", "dual", "partition_info"):
        assert list((tmp_path / "out" / name).rglob("part-*"))


@pytest.mark.parametrize("name", ["near_duplicates", "split_edges", "planarized_city"])
def test_no_table_is_broadcast_by_the_size_of_its_files(spark, monkeypatch, name):
    from roadcut import queries as Q
    from roadcut.operators import faces, planar
    from roadcut.plans import store

    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    stored = store.stored

    def seen(df, *a, **k):
        told(df)
        return stored(df, *a, **k)

    for m in (store, planar, faces):
        monkeypatch.setattr(m, "stored", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    told(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans if "max_by" not in p)  # the largest component is one row, and broadcast by a hint
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") is not None  # small ones by measure


@pytest.mark.parametrize("own, left", [("10m", 256 << 10), ("64k", 64 << 10)])
def test_little_is_broadcast_however_it_was_measured(spark, own, left):
    from roadcut.plans import store

    plain, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    was = {k: spark.conf.get(k, None) for k in (plain, measured)}
    try:
        spark.conf.unset(measured)
        spark.conf.set(plain, own)
        store.by_measure(spark)
        assert spark.conf.get(plain) == "-1" and int(spark.conf.get(measured)) == left
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_preparation_makes_each_table_once_and_no_dual_that_nobody_reads(spark, monkeypatch):
    from roadcut import queries as Q
    from roadcut.operators import faces, graph, planar
    from roadcut.plans import city, store

    plans = {}
    stored = store.stored

    def seen(df, name, *a, **k):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name, *a, **k)

    for m in (store, planar, faces, graph, city):
        monkeypatch.setattr(m, "stored", seen)
    assert Q.QUERIES["planarized_city"](spark, "/root/testdata/sf0.001").count()
    assert "dual" not in plans
    assert all("Window" not in p for p in plans["next"])  # angles and ranks were made before, not once for each side of the join
    assert all("_forest" not in p for p in plans["ranges"])  # nor the components
    half, vertices = plans["half"][0], plans["local"][0]
    assert "Join" in half and "Join" not in vertices
