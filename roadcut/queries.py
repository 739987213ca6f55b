"""Queries over the road lattice (see testbed), by name, with the SQL that tells what each must return."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcut import testbed as T
from roadcut.functions import geometry as G
from roadcut.operators import faces as D
from roadcut.operators import graph, planar, regions, tours
from roadcut.plans import city, divide
from roadcut.plans.store import by_measure, numbered, stored
from roadcut.sources import text

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Cells of the grid for joins by place; maximum weight of a region; tolerance.
CELL, MOST, EPS = 150.0, 3000.0, 15.0

_V = """v AS (SELECT p_partkey AS id, p_partkey % 40 AS gx, p_partkey // 40 AS gy, (p_partkey % 40) * 100 + (p_partkey * 37) % 41 - 20 AS x,
  (p_partkey // 40) * 100 + (p_partkey * 53) % 43 - 21 AS y FROM part)"""
_E = """e AS (SELECT a.id AS u, b.id AS v, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.gx < 39
  UNION ALL SELECT a.id, b.id, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) FROM v a JOIN v b ON b.id = a.id + 40),
h AS (SELECT u AS src, v AS dst, length FROM e UNION ALL SELECT v, u, length FROM e)"""
_R = """g AS (SELECT h.*, atan2(b.y - a.y, b.x - a.x) AS t FROM h JOIN v a ON a.id = src JOIN v b ON b.id = dst),
r AS (SELECT src, dst, length, if(t < 0, t + 2 * pi(), t) AS angle, row_number() OVER (PARTITION BY src ORDER BY if(t < 0, t + 2 * pi(), t), dst) - 1 AS rank,
  count(*) OVER (PARTITION BY src) AS degree FROM g)"""
_C = """c AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx_, c.y AS cy_, d.x AS dx, d.y AS dy,
  r.src * 4096 + r.rank AS face, a.gx // 8 + 5 * (a.gy // 8) AS region
  FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 41 JOIN v d ON d.id = a.id + 40 JOIN r ON r.src = a.id AND r.dst = d.id WHERE a.gx < 39),
l AS (SELECT *, sqrt((dx - ax) ** 2 + (dy - ay) ** 2) AS ad, sqrt((cx_ - dx) ** 2 + (cy_ - dy) ** 2) AS dc, sqrt((bx - cx_) ** 2 + (by_ - cy_) ** 2) AS cb, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS ba FROM c),
f AS (SELECT *, ((ax * (ad + ba)) + (dx * (ad + dc)) + (cx_ * (dc + cb)) + (bx * (cb + ba))) / (2 * (ad + dc + cb + ba)) AS cx,
  ((ay * (ad + ba)) + (dy * (ad + dc)) + (cy_ * (dc + cb)) + (by_ * (cb + ba))) / (2 * (ad + dc + cb + ba)) AS cy,
  ((ax * dy - dx * ay) + (dx * cy_ - cx_ * dy) + (cx_ * by_ - bx * cy_) + (bx * ay - ax * by_)) / 2.0 AS area FROM l)"""
_D = """du AS (SELECT p.face AS f1, q.face AS f2, e.length, p.region AS r1, q.region AS r2 FROM f p JOIN f q ON q.a = p.a + 1 JOIN e ON e.u = p.b AND e.v = p.c
  UNION ALL SELECT p.face, q.face, e.length, p.region, q.region FROM f p JOIN f q ON q.a = p.a + 40 JOIN e ON e.u = p.d AND e.v = p.c),
dual AS (SELECT f1, f2, length, r1, r2 FROM du UNION ALL SELECT f2, f1, length, r2, r1 FROM du)"""
_P = """p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 3900 AS x, (c_custkey * 104729) % (100 * (SELECT max(gy) FROM v)) AS y, 1 + c_custkey % 97 AS weight FROM customer)"""
_L = """loc AS (SELECT p.id AS point, min(face) AS face FROM p JOIN f ON f.a % 40 BETWEEN p.x // 100 - 1 AND p.x // 100 + 1 AND f.a // 40 BETWEEN p.y // 100 - 1 AND p.y // 100 + 1
  WHERE (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) >= 0 AND (cx_ - bx) * (p.y - by_) - (cy_ - by_) * (p.x - bx) >= 0
    AND (dx - cx_) * (p.y - cy_) - (dy - cy_) * (p.x - cx_) >= 0 AND (ax - dx) * (p.y - dy) - (ay - dy) * (p.x - dx) >= 0 GROUP BY p.id),
w AS (SELECT f.face, f.region, f.cx, f.cy, coalesce(sum(p.weight), 0)::BIGINT AS weight FROM f LEFT JOIN loc USING (face) LEFT JOIN p ON p.id = loc.point GROUP BY ALL),
rw AS (SELECT region, sum(weight)::BIGINT AS weight, count(*) AS n_faces FROM w GROUP BY region),
cut AS (SELECT f.region, coalesce(sum(length), 0) AS cut FROM (SELECT DISTINCT region FROM f) f LEFT JOIN (SELECT r1, length FROM dual WHERE r1 <> r2) ON r1 = region GROUP BY f.region)"""
_LINES = "ln(line, k, vertical) AS (VALUES (0, 0.0, false), (1, 1.0, false), (2, -1.0, false), (3, 0.5, false), (4, -0.5, false), (5, 2.0, false), (6, -2.0, false), (7, 0.0, true))"
_GRAPH, _FACES = f"WITH {_V}, {_E} ", f"WITH {_V}, {_E}, {_R}, {_C} "
_ALL = f"WITH {_V}, {_E}, {_R}, {_C}, {_D}, {_P}, {_L}, {_LINES} "


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark, d) -> DataFrame:
            by_measure(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _half(spark, d):
    return graph.half_edges(T.edges(spark, d))


def _angular(spark, d):
    return D.angular(_half(spark, d), T.vertices(spark, d))


def _traced(spark, d):
    return stored(D.trace(_angular(spark, d)), "traced")


def _faces(spark, d):
    t = _traced(spark, d)
    return t, stored(D.interior(D.faces(t)), "faces")


def _assigned(faces):
    a = "face div 4096"
    return faces.selectExpr("face", f"({a}) % 40 div 8 + 5 * ((({a}) div 40) div 8) AS region")


def _weighed(spark, d):
    """traced, faces with weights, dual, assignment."""
    t, f = _faces(spark, d)
    p = T.points(spark, d)
    w = D.face_weights(p, D.locate(p, f, CELL), f)
    w = stored(f.select("face", "cx", "cy").join(w, "face"), "weights")
    return t, f, w, stored(D.dual_edges(t, f), "dual"), stored(_assigned(w), "assignment")


def _r(name: str, to: str | None = None, digits: int = 6):
    return F.round(name, digits).alias(to or name)


# Vertices and edges


@query(f"WITH {_V}, {_LINES} SELECT id, line::BIGINT AS line, round(if(vertical, y, (x + k * y) / (1 + k * k)), 6)::DOUBLE AS p FROM v, ln")
def vertex_projection(spark, d) -> DataFrame:
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("line"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(regions.LINES)))
    v = T.vertices(spark, d).withColumn("l", F.explode(lines))
    return v.select("id", F.col("l.line").alias("line"), F.round(G.projection(F.col("x").cast("double"), F.col("y").cast("double"), F.col("l.k"), F.col("l.v")), 6).alias("p"))


@query(f"WITH {_V}, b AS (SELECT (min(x) + max(x)) / 2 / 1000 AS rx, (min(y) + max(y)) / 2 / 1000 AS ry FROM v) SELECT id, round(111321.377778 * cos(ry * pi() / 180) * (x / 1000 - rx), 4) AS x, round(111321.377778 * (y / 1000 - ry), 4) AS y FROM v, b")
def plane_projection(spark, d) -> DataFrame:
    v = T.vertices(spark, d).selectExpr("id", "x / 1000D AS x", "y / 1000D AS y")
    return text.to_plane(v, text.reference_point(v)).select("id", _r("x", digits=4), _r("y", digits=4))


@query(f"WITH {_V} SELECT id, x / 1000 AS x, y / 1000 AS y FROM v")
def plane_projection_inverse(spark, d) -> DataFrame:
    v = T.vertices(spark, d).selectExpr("id", "x / 1000D AS x", "y / 1000D AS y")
    ref = text.reference_point(v)
    return text.to_degrees(text.to_plane(v, ref), ref).select("id", _r("x", digits=9), _r("y", digits=9))


@query(_GRAPH + "SELECT u, v, round(length, 6) AS length FROM e")
def edge_lengths(spark, d) -> DataFrame:
    return T.edges(spark, d).select("u", "v", _r("length"))


@query(_GRAPH + ", m AS (SELECT e.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e JOIN v a ON a.id = u JOIN v b ON b.id = e.v) SELECT u, v, round(if(atan2(y2 - y1, x2 - x1) < 0, atan2(y2 - y1, x2 - x1) + 2 * pi(), atan2(y2 - y1, x2 - x1)), 6) AS angle, round(atan2(y2 - y1, x2 - x1) + pi(), 6) AS from_west, if(x1 = x2, NULL, round((y2 - y1) / nullif(x2 - x1, 0), 6)) AS slope, x1 = x2 AS vertical, y1 = y2 AS horizontal FROM m")
def edge_angles(spark, d) -> DataFrame:
    p = planar.placed(T.edges(spark, d), T.vertices(spark, d))
    at = ("x1", "y1", "x2", "y2")
    return p.select("u", "v", F.round(G.angle(*at), 6).alias("angle"), F.round(G.angle_from_west(*at), 6).alias("from_west"), F.round(G.slope(*at), 6).alias("slope"), G.is_vertical("x1", "x2").alias("vertical"), G.is_horizontal("y1", "y2").alias("horizontal"))


@query(_GRAPH + "SELECT p.id AS point, e.u, e.v, (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) AS turn, p.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND p.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y) AS boxed, p.x > least(a.x, b.x) AND p.x < greatest(a.x, b.x) AS between_x FROM e JOIN v a ON a.id = e.u JOIN v b ON b.id = e.v JOIN v p ON p.id = e.u + 41 OR p.id = e.u")
def segment_predicates(spark, d) -> DataFrame:
    p = planar.placed(T.edges(spark, d), T.vertices(spark, d)).withColumn("point", F.explode(F.array(F.col("u"), F.col("u") + 41)))
    p = p.join(T.vertices(spark, d).selectExpr("id AS point", "cast(x AS double) AS x", "cast(y AS double) AS y"), "point")
    turn = G.cross("x1", "y1", "x2", "y2", "x", "y").cast("long")
    return p.select("point", "u", "v", turn.alias("turn"), G.in_rectangle("x", "y", "x1", "y1", "x2", "y2").alias("boxed"), G.strictly_between("x", "x1", "x2").alias("between_x"))


@query(_GRAPH + "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM h GROUP BY src) GROUP BY degree")
def degree_dist(spark, d) -> DataFrame:
    return graph.degrees(_half(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


@query("SELECT u, count(*) AS degree, sum(n)::BIGINT AS lines FROM (SELECT l_suppkey AS u, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY u")
def bipartite_degrees(spark, d) -> DataFrame:
    return T.bipartite(spark, d).groupBy("u").agg(F.count("*").alias("degree"), F.sum("length").alias("lines"))


@query(_GRAPH + "SELECT src, dst, round(length, 6) AS length FROM h")
def undirected_closure(spark, d) -> DataFrame:
    e = T.edges(spark, d)
    return graph.half_edges(e.unionByName(e.where("u % 3 = 0"))).select("src", "dst", _r("length"))


@query(_GRAPH + "SELECT u, v, round(length, 6) AS length FROM e")
def distinct_edges(spark, d) -> DataFrame:
    return graph.undirected(_half(spark, d)).select("u", "v", _r("length"))


@query(_GRAPH + "SELECT src, dst FROM h WHERE src % 40 < 20 AND dst % 40 < 20")
def induced_subgraph(spark, d) -> DataFrame:
    return graph.induced(_half(spark, d), T.vertices(spark, d).where("gx < 20")).select("src", "dst")


@query(_GRAPH + "SELECT src, dst FROM h WHERE src % 7 <> 0 AND dst % 7 <> 0")
def drop_vertices(spark, d) -> DataFrame:
    return graph.without_vertices(_half(spark, d), T.vertices(spark, d).where("id % 7 = 0")).select("src", "dst")


@query(_GRAPH + "SELECT src, dst FROM h WHERE NOT (least(src, dst) % 5 = 0 AND greatest(src, dst) = least(src, dst) + 1)")
def drop_edges(spark, d) -> DataFrame:
    return graph.without_edges(_half(spark, d), T.edges(spark, d).where("u % 5 = 0 AND v = u + 1")).select("src", "dst")


def _strips(spark, d):
    return graph.without_vertices(_half(spark, d), T.vertices(spark, d).where("gx % 10 = 9"))


@query(f"WITH {_V} SELECT id, gx // 10 * 10 AS component FROM v WHERE gx % 10 <> 9")
def components(spark, d) -> DataFrame:
    return graph.components(_strips(spark, d))


@query(f"WITH {_V} SELECT id FROM v WHERE gx < 9")
def largest_component(spark, d) -> DataFrame:
    return graph.largest_component(_strips(spark, d))


@query(_GRAPH + "SELECT DISTINCT src AS id FROM h WHERE src % 7 <> 0 AND dst % 7 <> 0")
def linked_vertices(spark, d) -> DataFrame:
    v = T.vertices(spark, d)
    return graph.linked_vertices(v, graph.without_vertices(_half(spark, d), v.where("id % 7 = 0"))).select("id")


@query(f"WITH {_V} SELECT id, (gx + gy)::DOUBLE AS dist, CASE WHEN id = 0 THEN -1 WHEN gy > 0 THEN id - 40 ELSE id - 1 END AS pred FROM v")
def sssp_lattice(spark, d) -> DataFrame:
    h = _half(spark, d).withColumn("length", F.lit(1.0))
    return graph.shortest_paths(h, T.vertices(spark, d).where("id = 0")).select("id", "dist", F.coalesce("pred", F.lit(-1)).cast("long").alias("pred"))


@query(f"WITH {_V}, t AS (SELECT max(id) AS t FROM v), g AS (SELECT t % 40 AS gx, t // 40 AS gy, t FROM t), n AS (SELECT t AS target, unnest(range(0, gx + gy + 1)) AS pos, gx, gy FROM g) SELECT target, pos::INTEGER AS pos, if(pos <= gy, target - 40 * pos, gx - (pos - gy)) AS id FROM n")
def path_reconstruct(spark, d) -> DataFrame:
    v = T.vertices(spark, d)
    paths = graph.shortest_paths(_half(spark, d).withColumn("length", F.lit(1.0)), v.where("id = 0"))
    return graph.path_to(paths, v.agg(F.max("id").alias("id")))


@query(f"WITH {_V} SELECT id FROM v WHERE gx < 6")
def reachability_blocked(spark, d) -> DataFrame:
    v = T.vertices(spark, d)
    return graph.reachable(_half(spark, d), v.where("id = 0"), v.where("gx = 6"))


# Angular order, faces, dual


@query(f"WITH {_V}, {_E}, {_R} SELECT src, dst, rank, degree, round(angle, 6) AS angle FROM r")
def angular_order(spark, d) -> DataFrame:
    return _angular(spark, d).select("src", "dst", "rank", "degree", _r("angle"))


@query(f"WITH {_V}, {_E}, {_R} SELECT p.src, p.dst, n.dst AS ccw, b.dst AS cw FROM r p JOIN r n ON n.src = p.src AND n.rank = (p.rank + 1) % p.degree JOIN r b ON b.src = p.src AND b.rank = (p.rank + p.degree - 1) % p.degree")
def ccw_next(spark, d) -> DataFrame:
    return _angular(spark, d).select("src", "dst", "ccw", "cw")


@query(_FACES + "SELECT face, 4 AS n, concat_ws(',', a, d, c, b) AS ring FROM c")
def face_trace(spark, d) -> DataFrame:
    return _faces(spark, d)[1].select("face", "n", F.expr("concat_ws(',', ring)").alias("ring"))


@query(_FACES + "SELECT face, round(area, 3) AS area FROM f")
def face_area(spark, d) -> DataFrame:
    return _faces(spark, d)[1].select("face", _r("area", digits=3))


@query(_FACES + "SELECT face, round(cx, 6) AS cx, round(cy, 6) AS cy FROM f")
def face_center(spark, d) -> DataFrame:
    return _faces(spark, d)[1].select("face", _r("cx"), _r("cy"))


@query(_FACES + "SELECT face, least(ax, bx, cx_, dx)::DOUBLE AS x_low, greatest(ax, bx, cx_, dx)::DOUBLE AS x_high, least(ay, by_, cy_, dy)::DOUBLE AS y_low, greatest(ay, by_, cy_, dy)::DOUBLE AS y_high FROM c")
def face_bbox(spark, d) -> DataFrame:
    return D.boxes(_faces(spark, d)[1])


@query(_FACES + "SELECT id, count(*) AS faces FROM (SELECT unnest([a, b, c, d]) AS id FROM c) GROUP BY id")
def vertex_multiplicity(spark, d) -> DataFrame:
    t, f = _faces(spark, d)
    return D.multiplicity(t.join(f.select("face"), "face", "left_semi"))


@query(f"WITH {_V}, {_E}, {_R}, {_C}, {_D} SELECT f1, f2, round(length, 6) AS length FROM dual")
def dual_edges(spark, d) -> DataFrame:
    return D.dual_edges(*_faces(spark, d)).select("f1", "f2", _r("length"))


@query(f"WITH {_V}, {_E}, {_R}, {_C}, {_D} SELECT degree, count(*) AS n FROM (SELECT f1, count(*) AS degree FROM dual GROUP BY f1) GROUP BY degree")
def dual_degree(spark, d) -> DataFrame:
    return D.dual_edges(*_faces(spark, d)).groupBy("f1").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


@query(_ALL + "SELECT point, face FROM loc")
def point_in_face(spark, d) -> DataFrame:
    return D.locate(T.points(spark, d), _faces(spark, d)[1], CELL)


@query(_ALL + "SELECT face, weight FROM w")
def face_weights(spark, d) -> DataFrame:
    return _weighed(spark, d)[2].select("face", "weight")


@query(_ALL + "SELECT face, round(weight - floor(weight / 40) * 40, 6)::DOUBLE AS weight, weight::DOUBLE AS weight_full FROM w")
def heavy_face_mod(spark, d) -> DataFrame:
    return divide.reduced(_weighed(spark, d)[2], 40.0).select("face", _r("weight"), "weight_full")


@query(_ALL + "SELECT count(*) AS n FROM w WHERE weight = 0")
def zero_weight_faces(spark, d) -> DataFrame:
    return _weighed(spark, d)[2].where("weight = 0").agg(F.count("*").alias("n"))


# Planarizing

_X = f"""WITH {_V}, {_E}, q AS (SELECT a.id AS a, a.id + 1 AS b, a.id + 41 AS c, a.id + 40 AS d, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy
  FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 41 JOIN v d ON d.id = a.id + 40 WHERE a.gx < 39 AND (a.gx + a.gy) % 7 = 0),
t AS (SELECT *, ((bx - ax) * (dy - by_) - (by_ - ay) * (dx - bx))::DOUBLE / ((cx - ax) * (dy - by_) - (cy - ay) * (dx - bx)) AS t FROM q),
x AS (SELECT *, ax + t * (cx - ax) AS x, ay + t * (cy - ay) AS y FROM t)"""


def _crossed(spark, d):
    v = T.vertices(spark, d)
    e = planar.placed(T.diagonals(spark, d), v).select("u", "v", G.distance("x1", "y1", "x2", "y2").alias("length"))
    return v, T.edges(spark, d).select("u", "v", "length").unionByName(e)


@query(_X + " SELECT a AS a_u, c AS a_v, d AS b_v, b AS b_u, round(x, 6) AS x, round(y, 6) AS y FROM x")
def segment_crossings(spark, d) -> DataFrame:
    v, e = _crossed(spark, d)
    s = stored(numbered(planar.placed(e, v), ["u", "v"], "seg"), "segments")
    c = planar.crossings(s, CELL)
    a, b = (s.select(F.col("seg").alias(f"{k}_seg"), F.col("u").alias(f"{k}_u"), F.col("v").alias(f"{k}_v")) for k in "ab")
    return c.join(a, "a_seg").join(b, "b_seg").select("a_u", "a_v", "b_u", "b_v", _r("x"), _r("y"))


@query(_X + """, n AS (SELECT *, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY x, y) AS id FROM x)
SELECT u, v, round(length, 6) AS length FROM e UNION ALL
SELECT p, id, round(sqrt((x - px) ** 2 + (y - py) ** 2), 6) FROM (SELECT id, x, y, unnest([a, b, c, d]) AS p, unnest([ax, bx, cx, dx]) AS px, unnest([ay, by_, cy, dy]) AS py FROM n)""")
def split_edges(spark, d) -> DataFrame:
    v, e = _crossed(spark, d)
    return planar.planarize(v, e, CELL, 1.0)[1].select("u", "v", _r("length"))


@query(f"WITH {_V}, {_P} SELECT point, target, round(dist, 6) AS dist FROM (SELECT p.id AS point, v.id AS target, sqrt((p.x - v.x) ** 2 + (p.y - v.y) ** 2) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - v.x) ** 2 + (p.y - v.y) ** 2, v.id) AS k FROM p JOIN v ON v.x BETWEEN p.x - 15 AND p.x + 15 AND v.y BETWEEN p.y - 15 AND p.y + 15 WHERE (p.x - v.x) ** 2 + (p.y - v.y) ** 2 <= 225) WHERE k = 1")
def near_duplicates(spark, d) -> DataFrame:
    return planar.nearest_within(T.points(spark, d), T.vertices(spark, d), EPS).select("point", "target", _r("dist"))


@query(f"WITH {_V} SELECT id, if(gx < 20, 0, 20)::BIGINT AS component, if(gx < 20, 1, 2)::BIGINT AS side FROM v")
def cut_components(spark, d) -> DataFrame:
    return graph.parts_after_cut(_half(spark, d), T.edges(spark, d).where("u % 40 = 19 AND v = u + 1"))


@query(f"WITH {_V} SELECT id, if(gx <= 3, 1, 2)::BIGINT AS side FROM v WHERE gx <= 3 OR gx >= 6")
def expand_pockets(spark, d) -> DataFrame:
    v = T.vertices(spark, d)
    return graph.expand_pockets(_half(spark, d), v.where("gx = 3"), v.where("gx = 6"))


@query(_GRAPH + """, s AS (SELECT u, e.v, a.x AS x1, a.y AS y1, (b.x - a.x)::DOUBLE AS dx, (b.y - a.y)::DOUBLE AS dy FROM e JOIN v a ON a.id = u JOIN v b ON b.id = e.v),
t AS (SELECT *, greatest(0, coalesce(least((250 - x1) / nullif(dx, 0), (2050 - x1) / nullif(dx, 0)), 0), coalesce(least((150 - y1) / nullif(dy, 0), (1250 - y1) / nullif(dy, 0)), 0)) AS t0,
  least(1, coalesce(greatest((250 - x1) / nullif(dx, 0), (2050 - x1) / nullif(dx, 0)), 1), coalesce(greatest((150 - y1) / nullif(dy, 0), (1250 - y1) / nullif(dy, 0)), 1)) AS t1 FROM s WHERE (dx <> 0 OR x1 BETWEEN 250 AND 2050) AND (dy <> 0 OR y1 BETWEEN 150 AND 1250))
SELECT u, v, round(x1 + t0 * dx, 6) AS x1, round(y1 + t0 * dy, 6) AS y1, round(x1 + t1 * dx, 6) AS x2, round(y1 + t1 * dy, 6) AS y2, t0 > 0 AS cut_u, t1 < 1 AS cut_v FROM t WHERE t0 < t1""")
def clip_box(spark, d) -> DataFrame:
    c = graph.clip(planar.placed(T.edges(spark, d), T.vertices(spark, d)), 250.0, 150.0, 2050.0, 1250.0)
    return c.select("u", "v", _r("x1"), _r("y1"), _r("x2"), _r("y2"), "cut_u", "cut_v")


def _rings(f):
    return f.select(F.col("face").alias("ring"), F.posexplode("ring").alias("pos", "id"))


@query(_FACES + "SELECT face AS ring, unnest([0, 1, 2])::BIGINT AS at, unnest([b, a, d]) AS id FROM c")
def ring_segment(spark, d) -> DataFrame:
    f = _faces(spark, d)[1]
    return D.ring_segment(_rings(f), f.selectExpr("face AS ring", "ring[3] AS first", "ring[1] AS last"))


@query(_FACES + "SELECT face AS ring, unnest([a, d, c, b]) AS id, unnest([d, c, b, a]) AS after, unnest([b, a, d, c]) AS before FROM c")
def ring_neighbours(spark, d) -> DataFrame:
    return D.ring_neighbours(_rings(_faces(spark, d)[1])).select("ring", "id", "after", "before")


@query(_FACES + ", k AS (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c, d]) AS id FROM c) GROUP BY id) SELECT face, round(sum((1 + k.id % 7) / k.n), 6) AS weight FROM (SELECT face, unnest([a, b, c, d]) AS id FROM c) JOIN k USING (id) GROUP BY face")
def face_weights_from_vertices(spark, d) -> DataFrame:
    t, f = _faces(spark, d)
    return D.weights_from_vertices(t, f, T.vertices(spark, d).selectExpr("id", "1 + id % 7 AS weight")).select("face", _r("weight"))


@query(_FACES + "SELECT face, (ax + bx + cx_ + dx) / 4 AS x, (ay + by_ + cy_ + dy) / 4 AS y FROM c")
def face_centroid(spark, d) -> DataFrame:
    return D.centroids(_faces(spark, d)[1])


@query(_ALL + "SELECT region, face, sum(weight) OVER (PARTITION BY region ORDER BY face)::BIGINT AS upto, (sum(weight) OVER (PARTITION BY region) - sum(weight) OVER (PARTITION BY region ORDER BY face))::BIGINT AS rest FROM w")
def prefix_weights(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return D.prefix_weights(a.join(w, "face").select(F.col("region").alias("root"), F.col("face").alias("pos"), "face", "weight")).select(F.col("root").alias("region"), "face", "upto", "rest")


@query(_ALL + ", o AS (SELECT region, face, weight, sum(weight) OVER (PARTITION BY region ORDER BY face) AS upto, row_number() OVER (PARTITION BY region ORDER BY face) AS nth FROM w) SELECT region, face AS leaf, (upto - coalesce(lag(upto) OVER (PARTITION BY region ORDER BY face), 0))::BIGINT AS weight FROM o WHERE nth % 5 = 0")
def leaf_groups(spark, d) -> DataFrame:
    p = prefix_weights(spark, d).withColumn("nth", F.expr("row_number() OVER (PARTITION BY region ORDER BY face)")).where("nth % 5 = 0")
    return D.leaf_groups(p.selectExpr("region AS root", "face AS leaf", "upto")).select(F.col("root").alias("region"), "leaf", "weight")


# Regions


@query(_ALL + "SELECT region, line, round(max(p) - min(p), 4) AS spread, arg_min(face, (round(p, 6), face)) AS first, arg_max(face, (round(p, 6), -face)) AS last FROM (SELECT region, line, face, if(vertical, cy, (cx + k * cy) / (1 + k * k)) AS p FROM f, ln) GROUP BY region, line")
def direction_spread(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return regions.spreads(w, a).select("region", "line", _r("spread", digits=4), "first", "last")


@query(_ALL + "SELECT region, arg_max(line, (round(s, 6), -line)) AS line, round(max(round(s, 6)), 4) AS spread FROM (SELECT region, line, max(p) - min(p) AS s FROM (SELECT region, line, if(vertical, cy, (cx + k * cy) / (1 + k * k)) AS p FROM f, ln) GROUP BY region, line) GROUP BY region")
def best_direction(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return regions.best_lines(regions.spreads(w, a)).select("region", "line", F.round(F.round("spread", 6), 4).alias("spread"))


@query(_ALL + ", s AS (SELECT greatest(1, floor(sum(weight) / 2700))::BIGINT AS k, count(*) AS n FROM w), o AS (SELECT face, row_number() OVER (ORDER BY round(sqrt(cx * cx + cy * cy), 6), face) - 1 AS nth FROM w) SELECT face, nth // greatest(1, n // k) AS seed FROM o, s WHERE nth % greatest(1, n // k) = 0 AND nth < greatest(1, n // k) * k")
def seed_pick(spark, d) -> DataFrame:
    return regions.seeds(_weighed(spark, d)[2], MOST)


@query(_ALL + ", t AS (SELECT d.r2 AS region, d.f1 AS face, sum(d.length) AS shared FROM dual d WHERE d.r1 <> d.r2 GROUP BY ALL), q AS (SELECT f1, sum(length) AS whole FROM dual GROUP BY f1) SELECT region, face, round(whole - 2 * shared, 6) AS added, round(shared, 6) AS shared FROM t JOIN q ON f1 = face")
def new_perimeter(spark, d) -> DataFrame:
    _, _, _, dual, a = _weighed(spark, d)
    return regions.perimeter_after(dual, a).select("region", "face", _r("added"), _r("shared"))


@query(_ALL + ", t AS (SELECT d.r2 AS region, d.f1 AS face, sum(d.length) AS shared FROM dual d WHERE d.r1 <> d.r2 GROUP BY ALL), q AS (SELECT f1, sum(length) AS whole FROM dual GROUP BY f1) SELECT t.region, face, round((1 - w.weight / 3000.0) ** 2 * (sqrt(20.0) * (whole - 2 * shared)), 4)::DOUBLE AS together, round((3000.0 - rw.weight) * (whole - 2 * shared) ** 2 / shared, 2)::DOUBLE AS in_turn FROM t JOIN q ON f1 = face JOIN w USING (face) JOIN rw ON rw.region = t.region")
def bubble_rating(spark, d) -> DataFrame:
    """Ratings of faces that may join a region, by the rule for regions that grow together (without the way to the seed)
    and by that for regions grown in turn."""
    _, _, w, dual, a = _weighed(spark, d)
    p = regions.perimeter_after(dual, a).join(w.select("face", "weight"), "face").join(regions.region_weights(w, a).select("region", F.col("weight").alias("load")), "region")
    return p.select("region", "face", F.expr(f"round(pow(1 - weight / {MOST}D, 2) * sqrt(20D) * added, 4)").alias("together"), F.expr(f"round(({MOST}D - load) * added * added / shared, 2)").alias("in_turn"))


@query(_ALL + "SELECT region, round(cut, 4) AS cut FROM cut")
def cut_per_part(spark, d) -> DataFrame:
    _, _, _, dual, a = _weighed(spark, d)
    return regions.cut_per_region(dual, a).select("region", _r("cut", digits=4))


@query(_ALL + "SELECT round(sum(cut) / 2, 3) AS total FROM cut")
def total_cut(spark, d) -> DataFrame:
    _, _, _, dual, a = _weighed(spark, d)
    return regions.cut_per_region(dual, a).agg(F.round(F.sum("cut") / 2, 3).alias("total"))


@query(_ALL + "SELECT r1, r2, round(sum(length), 4) AS border FROM dual WHERE r1 <> r2 GROUP BY r1, r2")
def region_graph(spark, d) -> DataFrame:
    _, _, _, dual, a = _weighed(spark, d)
    return regions.region_graph(dual, a).select("r1", "r2", _r("border", digits=4))


@query(_ALL + ", o AS (SELECT f1, r1, r2, sum(length) AS o FROM dual WHERE r1 <> r2 GROUP BY ALL), i AS (SELECT f1, sum(length) AS i FROM dual WHERE r1 = r2 GROUP BY f1) SELECT o.f1 AS face, o.r1 AS region, o.r2 AS neighbour, round(o / coalesce(i, 1) * 3000.0 / nullif(weight, 0), 6)::DOUBLE AS ratio FROM o LEFT JOIN i USING (f1) JOIN rw ON rw.region = o.r2")
def affinity_ratio(spark, d) -> DataFrame:
    _, _, w, dual, a = _weighed(spark, d)
    return regions.affinity(dual, a, regions.region_weights(w, a), MOST).select("face", "region", "neighbour", _r("ratio"))


_CAP = ", n AS (SELECT DISTINCT r1, r2 FROM dual WHERE r1 <> r2), cap AS (SELECT rw.region, rw.weight, coalesce(sum(3000.0 - o.weight), 0)::DOUBLE AS capacity FROM rw LEFT JOIN n ON r1 = rw.region LEFT JOIN rw o ON o.region = r2 GROUP BY ALL) "


@query(_ALL + _CAP + "SELECT region, weight, capacity FROM cap")
def neighbor_capacity(spark, d) -> DataFrame:
    _, _, w, dual, a = _weighed(spark, d)
    return regions.neighbour_capacity(regions.region_graph(dual, a), regions.region_weights(w, a), MOST)


@query(_ALL + _CAP + "SELECT region, capacity FROM (SELECT *, row_number() OVER (ORDER BY capacity DESC, region) AS k, count(*) OVER () AS n FROM cap) WHERE k <= n // 2")
def top_half_regions(spark, d) -> DataFrame:
    _, _, w, dual, a = _weighed(spark, d)
    return regions.best_half(stored(regions.neighbour_capacity(regions.region_graph(dual, a), regions.region_weights(w, a), MOST), "capacity")).select("region", "capacity")


@query(_ALL + "SELECT region, weight FROM (SELECT *, row_number() OVER (ORDER BY weight, region) AS k, count(*) OVER () AS n FROM rw) WHERE k <= greatest(1, n // 20)")
def bottom_twentieth(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return regions.lightest(stored(regions.region_weights(w, a), "regions")).select("region", "weight")


@query(_ALL + "SELECT count(*) AS region_count, sum(weight)::BIGINT AS total_weight, min(weight) AS min_region_weight, max(weight) AS max_region_weight, round(avg(weight), 6) AS average_weight, round(stddev_pop(weight), 6) AS weight_stddev, round(avg(cut), 4) AS average_boundary, round(stddev_pop(cut), 4) AS boundary_stddev, round(sum(cut) / 2, 3) AS total_boundary_length, ceil(sum(weight) / 3000.0)::BIGINT AS min_region_count_estimate FROM rw JOIN cut USING (region)")
def part_stats(spark, d) -> DataFrame:
    _, _, w, dual, a = _weighed(spark, d)
    s = regions.statistics(regions.region_weights(w, a), regions.cut_per_region(dual, a), MOST)
    return s.select("region_count", "total_weight", "min_region_weight", "max_region_weight", _r("average_weight"), _r("weight_stddev"), _r("average_boundary", digits=4), _r("boundary_stddev", digits=4), _r("total_boundary_length", digits=3), F.col("min_region_count_estimate").cast("long").alias("min_region_count_estimate"))


@query(_ALL + "SELECT string_agg(printf('%.3f', round(weight / 3000.0, 3)), ',' ORDER BY weight) AS ratios FROM rw")
def part_ratios(spark, d) -> DataFrame:
    _, _, w, dual, a = _weighed(spark, d)
    s = regions.statistics(regions.region_weights(w, a), regions.cut_per_region(dual, a), MOST)
    return s.select(F.expr("concat_ws(',', transform(ratios, x -> format_string('%.3f', x)))").alias("ratios"))


@query(_ALL + ", m AS (SELECT region, avg(cx) AS mx, avg(cy) AS my FROM w GROUP BY region) SELECT region, arg_min(face, (round((cx - mx) ** 2 + (cy - my) ** 2, 6), face)) AS face FROM w JOIN m USING (region) GROUP BY region")
def part_centers(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return regions.centre_faces(w, a)


@query(_ALL + "SELECT region, arg_min(face, (s, face)) AS face FROM (SELECT p.region, p.face, round(sum(sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2)), 6) AS s FROM w p JOIN w q ON p.region = q.region GROUP BY ALL) GROUP BY region")
def medoid(spark, d) -> DataFrame:
    _, _, w, _, a = _weighed(spark, d)
    return regions.medoids(w, a)


_RV = ", rv AS (SELECT DISTINCT region, unnest([a, b, c, d]) AS id FROM f), rp AS (SELECT region, v.id, x, y FROM rv JOIN v USING (id)) "


@query(_ALL + _RV + ", m AS (SELECT region, avg(x) AS mx, avg(y) AS my FROM rp GROUP BY region) SELECT region, round(max(sqrt((x - mx) ** 2 + (y - my) ** 2)), 6) AS radius FROM rp JOIN m USING (region) GROUP BY region")
def part_radius(spark, d) -> DataFrame:
    _, f, _, _, a = _weighed(spark, d)
    return regions.radii(f.select("face", F.explode("ring").alias("id")), a, T.vertices(spark, d)).select("region", _r("centroid_radius", "radius"))


@query(_ALL + _RV + "SELECT p.region, round(max(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) AS diameter FROM rp p JOIN rp q USING (region) GROUP BY p.region")
def part_diameter(spark, d) -> DataFrame:
    _, f, _, _, a = _weighed(spark, d)
    return regions.largest_diameter(f.select("face", F.explode("ring").alias("id")), a, T.vertices(spark, d)).select("region", _r("diameter"))


@query(_ALL + ", s AS (SELECT region, unnest([a, d, c, b]) AS src, unnest([d, c, b, a]) AS dst FROM f) SELECT region, src, dst FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.src = s.dst AND o.dst = s.src AND o.region = s.region)")
def part_boundary_edges(spark, d) -> DataFrame:
    t, _, _, _, a = _weighed(spark, d)
    return regions.boundary_edges(t, a).select("region", "src", "dst")


@query(_ALL + _RV + """, he AS (SELECT p.region, p.id FROM rp p JOIN rp q ON q.region = p.region AND q.id <> p.id JOIN rp r ON r.region = p.region GROUP BY p.region, p.id, q.id
  HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) BETWEEN 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2)))
SELECT DISTINCT region, id, x::DOUBLE AS x, y::DOUBLE AS y FROM he JOIN rp USING (region, id)""")
def convex_hull(spark, d) -> DataFrame:
    _, f, _, _, a = _weighed(spark, d)
    return regions.convex_hulls(f.select("face", F.explode("ring").alias("id")), a, T.vertices(spark, d))


def _divided(spark, d, algorithm: str):
    t, _, w, dual, _ = _weighed(spark, d)
    w = stored(divide.reduced(w, MOST), "reduced")
    return w, dual, divide.divide(algorithm, w, dual, MOST, **({"traced": t} if algorithm == "IF" else {}))


@query()
def inertial_flow(spark, d) -> DataFrame:
    return _divided(spark, d, "IF")[2]


@query()
def bubble_sequential(spark, d) -> DataFrame:
    return _divided(spark, d, "BUS")[2]


@query()
def bubble_parallel(spark, d) -> DataFrame:
    return _divided(spark, d, "BUP")[2]


@query()
def rebalance(spark, d) -> DataFrame:
    w, dual, a = _divided(spark, d, "IF")
    return divide.rebalance(w, dual, a, MOST)


def _holds(kind: str):
    """What holds of a division: a row of SQL that says so for all faces."""
    return query(_ALL + f"SELECT '{kind}' AS division, count(*) AS faces, sum(weight)::DOUBLE AS weight, true AS light, true AS whole FROM w")


def _checked(kind: str, w: DataFrame, dual: DataFrame, a: DataFrame) -> DataFrame:
    """One row: the faces that have a region and their weight, whether no region is too heavy, whether all are connected."""
    a = stored(a, "division")
    heaviest = regions.region_weights(w, a).agg(F.max("weight").alias("heaviest"))
    inside = dual.join(a.withColumnRenamed("face", "f1"), "f1").join(a.selectExpr("face AS f2", "region AS r2"), "f2").where("region = r2")
    parts = graph.components(inside.selectExpr("f1 AS src", "f2 AS dst", "length"), a.selectExpr("face AS id")).agg(F.countDistinct("component").alias("parts"))
    n = a.join(w.select("face", "weight"), "face").agg(F.countDistinct("face").alias("faces"), F.sum("weight").alias("weight"), F.countDistinct("region").alias("regions"))
    return n.crossJoin(heaviest).crossJoin(parts).select(F.lit(kind).alias("division"), "faces", "weight", (F.col("heaviest") <= MOST).alias("light"), (F.col("parts") == F.col("regions")).alias("whole"))  # one row each


@_holds("IF")
def inertial_flow_holds(spark, d) -> DataFrame:
    return _checked("IF", *_divided(spark, d, "IF"))


@_holds("BUS")
def bubble_sequential_holds(spark, d) -> DataFrame:
    return _checked("BUS", *_divided(spark, d, "BUS"))


@_holds("BUP")
def bubble_parallel_holds(spark, d) -> DataFrame:
    return _checked("BUP", *_divided(spark, d, "BUP"))


@_holds("IF, rebalanced")
def rebalance_holds(spark, d) -> DataFrame:
    w, dual, a = _divided(spark, d, "IF")
    return _checked("IF, rebalanced", w, dual, divide.rebalance(w, dual, a, MOST))


@query(_ALL + "SELECT DISTINCT region, true AS same, true AS fits FROM w")
def planar_cut(spark, d) -> DataFrame:
    """Of each region: whether the least cut as a way through the plane graph is as long as that by maximum flow, and
    whether the balanced cut is no shorter and keeps source and sink apart."""
    t, _, w, dual, a = _weighed(spark, d)
    c = divide.cuts(w, dual, t, a)
    return c.select("region", (F.abs(F.col("least") - F.col("flow")) < 1e-6).alias("same"), (F.col("apart") & (F.col("balanced") >= F.col("least") - 1e-6)).alias("fits"))


@query(_X + """, n AS (SELECT *, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY x, y) AS id FROM x),
pv AS (SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM v UNION ALL SELECT id, x, y FROM n), sp AS (SELECT unnest([a, b, c, d]) AS p, id AS m FROM n),
ph AS (SELECT src, dst FROM h UNION ALL SELECT p, m FROM sp UNION ALL SELECT m, p FROM sp),
pa AS (SELECT src, dst, atan2(b.y - a.y, b.x - a.x) AS t FROM ph JOIN pv a ON a.id = src JOIN pv b ON b.id = dst),
pr AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY if(t < 0, t + 2 * pi(), t), dst) - 1 AS rank FROM pa),
cell AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d, n.id AS m FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 41 JOIN v d ON d.id = a.id + 40 LEFT JOIN n ON n.a = a.id WHERE a.gx < 39),
k AS (SELECT a, d, c, b AS e FROM cell WHERE m IS NULL UNION ALL SELECT a, m, b, NULL FROM cell WHERE m IS NOT NULL UNION ALL SELECT b, m, c, NULL FROM cell WHERE m IS NOT NULL
  UNION ALL SELECT d, c, m, NULL FROM cell WHERE m IS NOT NULL UNION ALL SELECT a, d, m, NULL FROM cell WHERE m IS NOT NULL)
SELECT k.a * 4096 + rank AS face, if(e IS NULL, 3, 4) AS n, round(((a.x - c.x) * (d.y - coalesce(e.y, a.y)) - (d.x - coalesce(e.x, a.x)) * (a.y - c.y)) / 2, 4) AS area
FROM k JOIN pr ON src = k.a AND dst = k.d JOIN pv a ON a.id = k.a JOIN pv d ON d.id = k.d JOIN pv c ON c.id = k.c LEFT JOIN pv e ON e.id = k.e""")
def planarized_city(spark, d) -> DataFrame:
    """Faces of the lattice with crossing diagonals, planarized."""
    v, e = _crossed(spark, d)
    return city.prepare(v, e, CELL).faces.select("face", "n", _r("area", digits=4))


_RING = """, s AS (SELECT region, unnest([a, d, c, b]) AS src, unnest([d, c, b, a]) AS dst FROM f),
bd AS (SELECT region, src, dst FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.src = s.dst AND o.dst = s.src AND o.region = s.region)),
st AS (SELECT region, arg_min(src, (v.x, -v.y)) AS src FROM bd JOIN v ON v.id = src GROUP BY region),
ring AS (SELECT region, 0::BIGINT AS pos, src AS id, src AS start FROM st UNION ALL SELECT r.region, r.pos + 1, bd.dst, r.start FROM ring r JOIN bd ON bd.region = r.region AND bd.src = r.id WHERE bd.dst <> r.start) """
_RECURSIVE = _ALL.replace("WITH", "WITH RECURSIVE", 1)


@query(_RECURSIVE + _RING + "SELECT region, pos, id FROM ring")
def part_boundary_ring(spark, d) -> DataFrame:
    t, _, _, _, a = _weighed(spark, d)
    return regions.boundary_rings(t, a).where("is_outer").select("region", "pos", "id")


@query(_RECURSIVE + _RING + ", m AS (SELECT region, count(*) AS n FROM ring GROUP BY region) SELECT a.region, a.id AS u, b.id AS v, round(length, 6) AS length FROM ring a JOIN m USING (region) JOIN ring b ON b.region = a.region AND b.pos = (a.pos + 1) % m.n JOIN h ON src = a.id AND dst = b.id")
def boundary_cycle_edges(spark, d) -> DataFrame:
    t, _, _, _, a = _weighed(spark, d)
    r = regions.boundary_rings(t, a).where("is_outer").select(F.col("region").alias("ring"), "pos", "id")
    return D.cycle_edges(r, _half(spark, d), T.vertices(spark, d)).select(F.col("ring").alias("region"), "u", "v", _r("length"))


@query(_RECURSIVE + _RING + "SELECT region, id, row_number() OVER (PARTITION BY region ORDER BY pos DESC) - 1 AS nth FROM ring WHERE id % 3 = 0")
def boundary_leaf_order(spark, d) -> DataFrame:
    """Every third vertex of each border, from its start backwards."""
    t, _, _, _, a = _weighed(spark, d)
    r = stored(regions.boundary_rings(t, a).where("is_outer").select(F.col("region").alias("ring"), "pos", "id"), "rings")
    return D.cyclic_order(r, r.where("id % 3 = 0"), r.where("pos = 0")).select(F.col("ring").alias("region"), "id", "nth")


@query(_RECURSIVE + _RING + """, m AS (SELECT region, pos, id, id // 40 % 8 = 0 AS masked, count(*) OVER (PARTITION BY region) AS n, lag(id // 40 % 8 = 0) OVER (PARTITION BY region ORDER BY pos) AS was,
  last_value(id // 40 % 8 = 0) OVER (PARTITION BY region ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM ring),
b AS (SELECT *, coalesce(min(pos) FILTER (WHERE masked AND NOT coalesce(was, final)) OVER (PARTITION BY region), 0) AS b FROM m) SELECT region, (pos - b + n) % n AS at, id, masked FROM b""")
def boundary_mask_shift(spark, d) -> DataFrame:
    """Borders turned to where their run on a line between rows of regions begins."""
    t, _, _, _, a = _weighed(spark, d)
    r = stored(regions.boundary_rings(t, a).where("is_outer").select(F.col("region").alias("ring"), "pos", "id"), "rings")
    return D.masked_run(r, r.where("id div 40 % 8 = 0")).select(F.col("ring").alias("region"), "at", "id", "masked")


@query(_FACES + ", s AS (SELECT unnest([a, d, c, b]) AS p, unnest([d, c, b, a]) AS q FROM f WHERE region % 2 = 0) SELECT DISTINCT u, v, round(e.length, 6) AS length FROM s JOIN e ON u = least(p, q) AND v = greatest(p, q)")
def face_subgraph(spark, d) -> DataFrame:
    """The graph of the faces in every second region."""
    f = _faces(spark, d)[1]
    return D.ring_edges(f.join(_assigned(f).where("region % 2 = 0"), "face", "left_semi")).select("u", "v", _r("length"))


_EX = f", {_LINES}, q AS (SELECT face, region, unnest([ax, bx, cx_, dx]) AS x, unnest([ay, by_, cy_, dy]) AS y FROM f), ex AS (SELECT face, region, line, min(if(vertical, y, (x + k * y) / (1 + k * k))) AS low, max(if(vertical, y, (x + k * y) / (1 + k * k))) AS high FROM q, ln GROUP BY ALL) "


@query(_FACES + _EX + "SELECT face, line, round(low, 6) AS low, round(high, 6) AS high FROM ex")
def face_extremes(spark, d) -> DataFrame:
    return regions.ring_extremes(_faces(spark, d)[1]).select("face", "line", _r("low"), _r("high"))


@query(_FACES + _EX + "SELECT region, line, arg_min(face, (round(low, 6), face)) AS source, arg_max(face, (round(high, 6), -face)) AS sink FROM ex GROUP BY ALL")
def source_sink_faces(spark, d) -> DataFrame:
    f = _faces(spark, d)[1]
    return regions.outermost(regions.ring_extremes(f), _assigned(f))


@query(_FACES + _EX + ", t AS (SELECT region, line, arg_min(face, (round(low, 6), face)) AS one FROM ex GROUP BY ALL) SELECT region, line, arg_min(face, (round(low, 6), face)) AS source, arg_max(face, (round(high, 6), -face)) AS sink FROM ex WHERE face NOT IN (SELECT one FROM t) GROUP BY ALL")
def extremum_fallback(spark, d) -> DataFrame:
    """The outermost faces once all that were sources are taken."""
    f = _faces(spark, d)[1]
    x, a = stored(regions.ring_extremes(f), "extremes"), _assigned(f)
    return regions.outermost(x, a, regions.outermost(x, a).select(F.col("source").alias("face")).distinct())


def _comb(spark, d):
    """A tree: the lowest row, and columns upon it."""
    return T.vertices(spark, d).selectExpr("id", "CASE WHEN gx = 0 AND gy = 0 THEN NULL WHEN gy = 0 THEN id - 1 ELSE id - 40 END AS pred")


_TOPS = ", top AS (SELECT gx, max(gy) AS gy, max(id) AS id FROM v GROUP BY gx) "


@query(f"WITH {_V}{_TOPS}, n AS (SELECT gx, count(*) AS n FROM v GROUP BY gx) SELECT v.id, (CASE WHEN v.gy = 0 THEN (SELECT sum(n) FROM n WHERE n.gx >= v.gx) ELSE top.gy - v.gy + 1 END)::BIGINT AS size FROM v JOIN top USING (gx) WHERE v.gx > 0 OR v.gy > 0")
def euler_tour_sizes(spark, d) -> DataFrame:
    """Vertices below each vertex of the comb, from the tour around it."""
    return tours.subtree_sizes(stored(tours.euler_tour(_angular(spark, d), _comb(spark, d)), "tour")).select("id", "size")


@query(_ALL + _TOPS + "SELECT n.id AS before, t.id AS after, coalesce((SELECT sum(weight) FROM w WHERE (face // 4096) % 40 = t.gx), 0)::DOUBLE AS weight FROM top t JOIN top n ON n.gx = (t.gx + 1) % 40")
def tour_leaf_weights(spark, d) -> DataFrame:
    """Weight between the leaves of the comb: that of the faces between two columns."""
    t, f, w, _, _ = _weighed(spark, d)
    h = stored(_angular(spark, d), "angular")
    tour = stored(tours.euler_tour(h, _comb(spark, d)), "tour")
    return tours.leaf_weights(tour, tours.tour_faces(h, t, f, tour), w).select("before", "after", "weight")


@query(_GRAPH + """, s AS (SELECT v.gx AS path, h.src, if(dst = src - 1, 1, 2) AS src_side, dst, 0 AS dst_side, length FROM h JOIN v ON v.id = src WHERE v.gx % 10 = 5 AND abs(src - dst) = 1)
SELECT path, src, src_side, dst, dst_side, round(length, 6) AS length FROM s UNION ALL SELECT path, dst, dst_side, src, src_side, round(length, 6) FROM s
UNION ALL SELECT v.gx, src, k, dst, k, round(length, 6) FROM h JOIN v ON v.id = src, (VALUES (1), (2)) t(k) WHERE v.gx % 10 = 5 AND abs(src - dst) = 40""")
def split_path(spark, d) -> DataFrame:
    """The lattice cut open along four columns, each by itself."""
    h = stored(_angular(spark, d), "angular")
    t = stored(D.trace(h), "traced")
    path = T.vertices(spark, d).where("gx % 10 = 5").selectExpr("gx AS path", "gy AS pos", "id")
    outer = t.join(D.faces(t).where("is_external").select("face"), "face", "left_semi")
    return tours.split_path(h, path, outer).select("path", "src", "src_side", "dst", "dst_side", _r("length"))


@query(_FACES + "SELECT a.id, unnest([a.id + 1, a.id + 40, a.id - 1]) AS dst, unnest([0, 1, 2])::BIGINT AS nth FROM v a JOIN v t ON t.id = a.id + 40 WHERE a.gx BETWEEN 1 AND 38 AND EXISTS (SELECT 1 FROM v WHERE id = a.id + 1) AND EXISTS (SELECT 1 FROM v WHERE id = a.id - 1)")
def corner_sector(spark, d) -> DataFrame:
    """From the eastern street counter-clockwise to the western one, where there is a northern one."""
    h = _angular(spark, d)
    v = T.vertices(spark, d)
    arms = v.where("gx BETWEEN 1 AND 38").join(v.selectExpr("id - 40 AS id"), "id", "left_semi").selectExpr("id", "id + 1 AS first", "id - 1 AS last")
    arms = arms.join(v.selectExpr("id - 1 AS id"), "id", "left_semi").join(v.selectExpr("id + 1 AS id"), "id", "left_semi")
    return tours.sector(h, arms).select("id", "dst", F.col("at").alias("nth"))


@query(f"WITH {_V} SELECT id, (if(gx > 20, 39 - gx, abs(gx - 1)) + gy)::DOUBLE AS dist FROM v WHERE gy % 5 = 0")
def sssp_corners(spark, d) -> DataFrame:
    """Steps from the nearer of two lower corners to every fifth row, where column 20 may be left up and down only."""
    v = T.vertices(spark, d)
    c = v.where("gx = 20").selectExpr("id", f"explode(array(id - {T.COLUMNS}, id + {T.COLUMNS})) AS dst")
    half = tours.allowed(_half(spark, d).withColumn("length", F.lit(1.0)), c)
    return graph.shortest_paths(half, v.where("id IN (1, 39)").select("id")).join(v.where("gy % 5 = 0").select("id"), "id", "left_semi").select("id", "dist")


@query(_GRAPH + "SELECT count(*) AS edges, count(*) FILTER (WHERE length < 70) AS tiny FROM e")
def small_edges(spark, d) -> DataFrame:
    return graph.tiny_edges(T.edges(spark, d), 70.0)


@query("SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, count(*)::DOUBLE AS length, sum(l_linenumber)::BIGINT AS bandwidth FROM lineitem GROUP BY ALL")
def flow_arcs(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey AS u", "l_partkey + 1000000000 AS v", "cast(l_linenumber AS long) AS bandwidth")
    n = T.bipartite(spark, d).selectExpr("u", "v", "cast(length AS double) AS length")
    return graph.arcs(li.join(n, ["u", "v"]))


@query(f"WITH {_V} SELECT id, 10 + ('0x' || substr(md5('15:' || id), 1, 8))::BIGINT % 30 AS weight FROM v")
def default_weights(spark, d) -> DataFrame:
    return graph.default_weights(T.vertices(spark, d).select("id"))


_RUNS = """, rm AS (SELECT *, 'c' || (region % 5) AS city, region % 3 AS size FROM rw, (VALUES (1500), (3000)) t(most)),
rn AS (SELECT city, size, most, sum(n_faces)::BIGINT AS edges, sum(n_faces) / 64.0 AS time, max(n_faces)::BIGINT AS memory, count(*) AS regions,
  ceil(sum(weight) / most)::BIGINT AS ideal, avg(weight) AS average_weight FROM rm GROUP BY city, size, most),
rr AS (SELECT *, regions / nullif(ideal, 0) AS region_ratio, average_weight / most AS avg_load, time / nullif(edges, 0) AS time_per_edge FROM rn) """


def _runs(spark, d):
    _, _, w, _, a = _weighed(spark, d)
    r = regions.region_weights(w, a).withColumn("most", F.explode(F.array(F.lit(1500), F.lit(3000))))
    r = r.groupBy(F.expr("concat('c', region % 5)").alias("city"), F.expr("region % 3").alias("size"), "most")
    return r.agg(F.sum("n_faces").alias("edges"), (F.sum("n_faces") / 64).alias("time"), F.max("n_faces").alias("memory"), F.count("*").alias("regions"), F.ceil(F.sum("weight") / F.col("most")).alias("ideal"), F.avg("weight").alias("average_weight"))


@query(_ALL + _RUNS + "SELECT city, size, most, round(region_ratio, 6) AS region_ratio, round(avg_load, 6) AS avg_load, round(time_per_edge, 6) AS time_per_edge FROM rr")
def runs_rolled_up(spark, d) -> DataFrame:
    return regions.roll_up(_runs(spark, d)).select("city", "size", "most", _r("region_ratio"), _r("avg_load"), _r("time_per_edge"))


@query(_ALL + _RUNS + """, o AS (SELECT unnest(['max_time', 'max_memory', 'avg_time_per_edge', 'min_region_ratio', 'avg_region_ratio', 'max_region_ratio']) AS metric,
  unnest([max(time)::DOUBLE, max(memory)::DOUBLE, avg(time_per_edge), min(region_ratio), avg(region_ratio), max(region_ratio)]) AS value FROM rr) SELECT metric, round(value, 6) AS value FROM o UNION ALL SELECT 'avg_load_' || most, round(avg(avg_load), 6) FROM rr GROUP BY most""")
def runs_overall(spark, d) -> DataFrame:
    return regions.roll_up_all(stored(_runs(spark, d), "runs"))
