"""Searches inside one region, which depend on order: plain Python on adjacency lists."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

from roadcut.plans.planecut import Plane

Adjacency = dict[int, dict[int, float]]


def adjacency(rows) -> Adjacency:
    out: Adjacency = {}
    for a, b, w in rows:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {}).setdefault(a, w)
    return out


def connected(nodes: set[int], adj: Adjacency) -> list[set[int]]:
    """Components, largest first, then by least node."""
    left, out = set(nodes), []
    for s in sorted(nodes):
        if s not in left:
            continue
        left.discard(s)
        comp, todo = {s}, [s]
        while todo:
            for n in adj.get(todo.pop(), ()):
                if n in left:
                    left.discard(n)
                    comp.add(n)
                    todo.append(n)
        out.append(comp)
    return sorted(out, key=lambda c: (-len(c), min(c)))


def dijkstra(adj: Adjacency, sources, blocked=frozenset()) -> tuple[dict[int, float], dict[int, int]]:
    dist, pred, heap = {}, {}, [(0.0, s, -1) for s in sorted(sources)]
    heapq.heapify(heap)
    while heap:
        d, u, p = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        if p >= 0:
            pred[u] = p
        for v, w in adj.get(u, {}).items():
            if v not in dist and v not in blocked:
                heapq.heappush(heap, (d + w, v, u))
    return dist, pred


def grow(order: list[int], start: int, target: float, weight: dict[int, float], adj: Adjacency, taken: set[int], index: int, place: dict[int, int] | None = None) -> set[int]:
    """Nodes met breadth-first from start until their weight reaches the target, none of taken; a node may be entered only
    if its place in the order is less than half the region away from index."""
    if start in taken:
        return set()
    place = place or {v: i for i, v in enumerate(order)}
    far = max(1, len(order) / 2)
    out, total, todo, seen = set(), 0.0, deque([start]), {start}
    while todo and total < target:
        u = todo.popleft()
        out.add(u)
        total += weight[u]
        for v in sorted((v for v in adj.get(u, ()) if v not in seen and v not in taken), key=place.__getitem__):
            if abs(place[v] - index) < far:
                seen.add(v)
                todo.append(v)
    return out


def pockets(nodes: set[int], adj: Adjacency, source: set[int], sink: set[int]) -> tuple[set[int], set[int]]:
    """source and sink with what only one of them can reach without passing the other."""

    def reach(start: set[int], wall: set[int]) -> set[int]:
        seen, todo = set(start), list(start)
        while todo:
            for v in adj.get(todo.pop(), ()):
                if v in nodes and v not in seen and v not in wall:
                    seen.add(v)
                    todo.append(v)
        return seen

    a, b = reach(source, sink), reach(sink, source)
    return source | (a - b), sink | (b - a)


def max_flow(adj: Adjacency, source: set[int], sink: set[int]) -> tuple[float, set[int]]:
    """Value of the greatest flow between the sets, and the source side of a least cut (Dinic: levels, blocking flows)."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {s: {}, t: {}}
    for u, row in adj.items():
        cap.setdefault(u, {}).update(row)
    for v in source:
        cap[s][v], cap[v][s] = float("inf"), 0.0
    for v in sink:
        cap[v][t], cap[t][v] = float("inf"), 0.0
    flow = 0.0
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if t not in level:
            return flow, {u for u in level if u >= 0}
        arcs = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                flow += push
                first = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-9)
                del path[first + 1 :]
                # the arc is spent; the iterator of its start goes on from the next one
                continue
            for v in arcs[u]:
                if cap[u].get(v, 0.0) > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def bisect(nodes: list[tuple[int, float, float, float]], rows, share: float, plane: Plane | None = None) -> tuple[dict[int, int], float]:
    """Divides a region in two: source and sink sets at the ends of its longest direction, and a cut between them.

    nodes: face, cx, cy, weight. Returns part 0 or 1 of each face and the cut's length. With the region's plane graph the
    cut is a short and even one; without it, or where the sets touch no common rim, it is the least one by maximum
    flow. Falls back to halves by projection if a side would be empty.
    """
    weight, adj = {f: w for f, _, _, w in nodes}, adjacency(rows)
    order, source, sink = ends(nodes, adj, share)
    n = len(order)
    got = plane.balanced_cut(source, sink, weight) if plane else None
    if got is None or got[1] & sink:
        got = max_flow(adj, source, sink)
    value, side = got
    part = {f: 0 if f in side else 1 for f in order}
    if len(set(part.values())) < 2:
        half = set(order[: n // 2])
        part = {f: 0 if f in half else 1 for f in order}
        value = sum(w for a, row in adj.items() for b, w in row.items() if part[a] < part[b])
    return part, value


def ends(nodes: list[tuple[int, float, float, float]], adj: Adjacency, share: float) -> tuple[list[int], set[int], set[int]]:
    """A region's faces in order along its longest direction, and the sets grown from both ends to a share of its weight.
    A start that an earlier one has reached in vain isn't tried again."""
    from roadcut.operators.regions import LINES

    weight = {f: w for f, _, _, w in nodes}
    best, order = -1.0, []
    for k, vertical in LINES:
        p = {f: y if vertical else (x + k * y) / (1 + k * k) for f, x, y, _ in nodes}
        spread = max(p.values()) - min(p.values())
        if spread > best + 1e-9:
            best, order = spread, sorted(p, key=lambda f: (round(p[f], 6), f))
    target, n = share * sum(weight[f] for f in order), len(order)
    place = {v: i for i, v in enumerate(order)}

    def choose(indices, taken):
        top, top_w, tried = set(), -1.0, set()
        for i in indices:
            if order[i] in taken or order[i] in tried:
                continue
            got = grow(order, order[i], target, weight, adj, taken, i, place)
            tried |= got
            w = sum(weight[v] for v in sorted(got))
            if got and w > top_w:
                top, top_w = got, w
            if w >= target:
                break
        return top

    source = choose(range(n), set()) if n > 1 else set(order)
    if len(source) == n:
        source = {order[0]}
    sink = choose(range(n - 1, -1, -1), source)
    if not sink:
        source, sink = {order[0]}, {order[-1]}
    return order, *pockets(set(order), adj, source, sink)


def divided(nodes: list[tuple[int, float, float, float]], rows, plane_rows, most: float, share: float, whole: int) -> dict[int, int]:
    """Label of each face: the region is bisected, and so is each piece that weighs most or more, if it has no more than
    ``whole`` faces; larger pieces are left to the next round."""
    out, label, todo, first = {}, 0, [[n[0] for n in nodes]], True
    node, adj = {n[0]: n for n in nodes}, adjacency(rows)
    near: dict[int, list] = {}
    for r in plane_rows or ():
        near.setdefault(r[3], []).append(r)
    while todo:
        faces = todo.pop()
        heavy = sum(node[f][3] for f in sorted(faces)) >= most and len(faces) > 1
        if not heavy or not first and len(faces) > whole:
            out |= dict.fromkeys(faces, label)
            label += 1
            continue
        first, own = False, set(faces)
        inside = [(a, b, w) for a in faces for b, w in adj.get(a, {}).items() if a < b and b in own]
        plane = Plane([r for f in faces for r in near[f]]) if plane_rows else None
        part, _ = bisect([node[f] for f in sorted(faces)], inside, share, plane)
        for side in (0, 1):  # a side may fall apart: each piece goes on by itself
            todo += [sorted(c) for c in connected({f for f, p in part.items() if p == side}, adj)]
    return out


def bubbles_in_turn(nodes, rows, most: float) -> dict[int, int]:
    """Grows one region at a time from the leftmost free face, by the least rating, until none fits. A face that doesn't
    fit is passed over as long as another does."""
    weight, x = {f: w for f, _, _, w in nodes}, {f: cx for f, cx, _, _ in nodes}
    adj, out = adjacency(rows), {}
    whole = {f: sum(n.values()) for f, n in adj.items()}
    for f in sorted(x, key=lambda f: (x[f], f)):
        if f in out:
            continue
        label, total = f, weight[f]
        out[f] = label
        shared = {v: w for v, w in adj.get(f, {}).items() if v not in out}
        while shared:
            best = None
            for v, s in shared.items():
                if total + weight[v] <= most:
                    change = whole[v] - 2 * s
                    rating = ((most - total) * change * change / s if s else float("inf"), v)
                    if best is None or rating < best:
                        best = rating
            if best is None:
                break
            v = best[1]
            del shared[v]
            out[v] = label
            total += weight[v]
            for u, w in adj[v].items():
                if u not in out:
                    shared[u] = shared.get(u, 0.0) + w
    return out


class _Medoid:
    """The member with the least sum of distances to all members, kept up as members come."""

    def __init__(self) -> None:
        self.id, self.xy, self.sum, self.n = np.zeros(8, np.int64), np.zeros((8, 2)), np.zeros(8), 0

    def add(self, v: int, at: tuple[float, float]) -> int:
        if self.n == len(self.id):
            self.id, self.sum, self.xy = np.resize(self.id, 2 * self.n), np.resize(self.sum, 2 * self.n), np.resize(self.xy, (2 * self.n, 2))
        d = np.hypot(*(self.xy[: self.n] - at).T)
        self.sum[: self.n] += d
        self.id[self.n], self.xy[self.n], self.sum[self.n] = v, at, d.sum()
        self.n += 1
        s = np.round(self.sum[: self.n], 6)
        return int(self.id[: self.n][s == s.min()].min())


def bubbles_together(nodes, rows, seeds: list[int], most: float) -> dict[int, int]:
    """Grows all regions by a face each in rounds, by the least rating, seeds moving to their medoids; faces that no region
    can take under the cap start regions of their own, grown in turn."""
    weight, at = {f: w for f, _, _, w in nodes}, {f: (cx, cy) for f, cx, cy, _ in nodes}
    adj, out = adjacency(rows), {s: s for s in seeds}
    whole = {f: sum(n.values()) for f, n in adj.items()}
    total, seed, middle = {s: weight[s] for s in seeds}, {s: s for s in seeds}, {s: _Medoid() for s in seeds}
    near = {s: {v: w for v, w in adj.get(s, {}).items() if v not in out} for s in seeds}  # free faces around, with the shared border
    for s in seeds:
        middle[s].add(s, at[s])
    coefficient = (max(sum(weight[f] for f in sorted(weight)), 1e-9) / most) ** 0.5
    active = list(seeds)
    while active:
        still = []
        for b in active:
            (sx, sy), best, gone = at[seed[b]], None, []
            for v, s in near[b].items():
                if v in out or total[b] + weight[v] > most:  # a region never gets lighter: what doesn't fit now never will
                    gone.append(v)
                    continue
                d = ((at[v][0] - sx) ** 2 + (at[v][1] - sy) ** 2) ** 0.5
                rating = ((1 - weight[v] / most) ** 2 * (coefficient * (whole[v] - 2 * s) + d), v)
                if best is None or rating < best:
                    best = rating
            for v in gone:
                del near[b][v]
            if best is None:
                continue
            v = best[1]
            del near[b][v]
            out[v] = b
            total[b] += weight[v]
            for u, w in adj[v].items():
                if u not in out:
                    near[b][u] = near[b].get(u, 0.0) + w
            seed[b] = middle[b].add(v, at[v])
            still.append(b)
        active = still
    rest = [n for n in nodes if n[0] not in out]
    if rest:
        left = {n[0] for n in rest}
        out |= bubbles_in_turn(rest, [r for r in rows if r[0] in left and r[1] in left], most)
    return out


def dissolve(region: int, faces: dict[int, int], weight: dict[int, float], adj: Adjacency, total: dict[int, float], most: float) -> dict[int, int] | None:
    """Hands the faces of a region to its neighbours, those with the greatest affinity first; None if some face is left."""
    own, moved, load, heap = {f for f, r in faces.items() if r == region}, {}, dict(total), []

    def push(f: int) -> None:
        inner = sum(w for v, w in adj.get(f, {}).items() if v in own and v not in moved)
        outer: dict[int, float] = {}
        for v, w in adj.get(f, {}).items():
            r = moved.get(v, faces.get(v))
            if r is not None and r != region:
                outer[r] = outer.get(r, 0.0) + w
        for r, w in outer.items():
            heapq.heappush(heap, (-(w / (inner or 1.0)) * most / max(load[r], 1e-9), f, r))

    for f in own:
        push(f)
    while heap:
        _, f, r = heapq.heappop(heap)
        if f in moved or load[r] + weight[f] > most:
            continue
        moved[f] = r
        load[r] += weight[f]
        for v in adj.get(f, {}):
            if v in own and v not in moved:
                push(v)
    return moved if len(moved) == len(own) else None
