"""Cuts through a region's plane graph: ways from one stretch of its rim to the other, between two sets of faces."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

Edge = tuple[int, int]


@dataclass
class Frame:
    """What lies between a source and a sink that both touch one rim: the vertices of the two free stretches of that rim,
    each from the source to the sink, the faces along them, and the edges that a cut may use, with what crossing costs."""

    one: list[int]
    two: list[int]
    one_faces: list[int]
    two_faces: list[int]
    links: dict[int, list[tuple[int, float]]]


def ways(links: dict[int, list[tuple[int, float]]], start, allowed=None) -> tuple[dict[int, float], dict[int, int]]:
    """Shortest ways from a set of vertices: distance and predecessor (-1 at the start); allowed(a, b) may refuse edges."""
    dist, pred, heap = {}, {}, [(0.0, s, -1) for s in start]
    heapq.heapify(heap)
    while heap:
        d, u, p = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u], pred[u] = d, p
        for v, w in links.get(u, ()):
            if v not in dist and (allowed is None or allowed(u, v)):
                heapq.heappush(heap, (d + w, v, u))
    return dist, pred


def back(pred: dict[int, int], v: int) -> list[int]:
    """The way from v to its start."""
    out = [v]
    while pred[out[-1]] != -1:
        out.append(pred[out[-1]])
    return out


def edges_of(way: list[int]) -> set[Edge]:
    return {(min(e), max(e)) for e in zip(way, way[1:])}


class Plane:
    """Half-edges of a region's faces: rows (src, dst, length, face, x, y) with the place of src."""

    def __init__(self, rows):
        self.side: dict[Edge, int] = {}
        self.length: dict[Edge, float] = {}
        self.place: dict[int, tuple[float, float]] = {}
        self.ring: dict[int, list[Edge]] = {}
        for a, b, w, f, x, y in sorted(rows):
            self.side[a, b], self.length[a, b], self.place[a] = f, w, (x, y)
            self.ring.setdefault(f, []).append((a, b))
        self._rims: list[list[int]] | None = None

    def rims(self) -> list[list[int]]:
        """Vertices along each face that isn't of the region (the outside, holes), in the order of its half-edges."""
        if self._rims is not None:
            return self._rims
        out = {(b, a) for a, b in self.side if (b, a) not in self.side}
        around: dict[int, set[int]] = {a: set() for e in out for a in e}
        for a, b in self.side:
            if a in around:
                around[a].add(b)
            if b in around:
                around[b].add(a)

        def turn(a: int) -> list[int]:
            x, y = self.place[a]
            return sorted(around[a], key=lambda b: (math.atan2(self.place[b][1] - y, self.place[b][0] - x) % (2 * math.pi), b))

        after = {}
        for v in around:
            r = turn(v)
            for i, u in enumerate(r):
                if (u, v) in out:
                    after[u, v] = (v, r[(i + 1) % len(r)])
        self._rims, left = [], set(out)
        for e in sorted(out):
            cycle = []
            while e in left:
                left.discard(e)
                cycle.append(e[0])
                e = after[e]
            if cycle:
                self._rims.append(cycle)
        return self._rims

    def frame(self, source: set[int], sink: set[int]) -> Frame | None:
        """None where no rim touches both sets, or where they touch it in turns."""
        for cycle in self.rims():
            n = len(cycle)
            face = [self.side.get((cycle[(i + 1) % n], cycle[i])) for i in range(n)]
            kind = [1 if f in source else 2 if f in sink else 0 for f in face]
            marked = [i for i in range(n) if kind[i]]
            if not {1, 2} <= {kind[i] for i in marked}:
                continue
            shift = next(i for i, j in zip(marked, marked[-1:] + marked[:-1]) if kind[i] == 1 and kind[j] == 2)
            kind, face, cycle = kind[shift:] + kind[:shift], face[shift:] + face[:shift], cycle[shift:] + cycle[:shift]
            ones, twos = [i for i in range(n) if kind[i] == 1], [i for i in range(n) if kind[i] == 2]
            if ones[-1] > twos[0]:
                return None
            a, b, c = ones[-1] + 1, twos[0], twos[-1] + 1
            ring = cycle + cycle[:1]
            outer = {(u, v) for u, v in zip(ring, ring[1:])}
            return Frame(ring[a : b + 1], ring[c : n + 1][::-1], face[a:b], face[c:n][::-1], self._links(source, sink, outer))
        return None

    def _links(self, source: set[int], sink: set[int], outer: set[Edge]) -> dict[int, list[tuple[int, float]]]:
        links: dict[int, list[tuple[int, float]]] = {}
        for (a, b), f in self.side.items():
            g = self.side.get((b, a))
            if g is None:
                if (b, a) in outer:
                    continue
                w = 0.0  # along a hole
            elif a > b or f in source and g in source or f in sink and g in sink:
                continue
            else:
                w = 0.0 if f == g else self.length[a, b]
            links.setdefault(a, []).append((b, w))
            links.setdefault(b, []).append((a, w))
        return links

    def flood(self, start, wall: set[Edge], within: set[int] | None = None) -> set[int]:
        """Faces reached from start without crossing a wall or leaving within."""
        seen, todo = set(start), list(start)
        while todo:
            for a, b in self.ring[todo.pop()]:
                g = self.side.get((b, a))
                if g is not None and g not in seen and ((a, b) if a < b else (b, a)) not in wall and (within is None or g in within):
                    seen.add(g)
                    todo.append(g)
        return seen

    def crossed(self, wall: set[Edge]) -> float:
        """Length of the borders that a cut along these edges crosses."""
        return sum(self.length[e] for e in wall if self.side.get(e) is not None and self.side.get(e[::-1]) is not None and self.side[e] != self.side[e[::-1]])

    def least_cut(self, source: set[int], sink: set[int]) -> tuple[float, set[int]] | None:
        """Value of the least cut and the source's side; None without a frame.

        A cut between two sets of faces is a closed line around one of them. Where both touch one rim, it runs through what
        lies beyond that rim, so it is a way through the plane graph from one free stretch of the rim to the other.
        """
        fr = self.frame(source, sink)
        if fr is None:
            return None
        dist, pred = ways(fr.links, fr.one)
        ends = [(dist[v], v) for v in fr.two if v in dist]
        if not ends:
            return None
        return min(ends)[0], self.flood(source, edges_of(back(pred, min(ends)[1])))

    def balanced_cut(self, source: set[int], sink: set[int], weight: dict[int, float]) -> tuple[float, set[int]] | None:
        """Crossed length and source's side of a cut that is short and even at once; None without a frame.

        The shortest way from the source to the sink is crossed by every cut. Each of its vertices is a place to cross it:
        from there shortest ways run to the leaves on both stretches, on its own side of the way each; of all pairs of
        leaves that with the least sum of half its length and half the difference from an even cut counts. The vertex
        is sought by halving: towards the sink while the source's side is the lighter one. Where no way leads from the
        source to the sink but along the rim, it is the least cut.
        """
        fr = self.frame(source, sink)
        if fr is None:
            return None
        rim = {v for f in source for v, _ in self.ring[f]}
        goal = {v for f in sink for v, _ in self.ring[f]}
        dist, pred = ways(fr.links, sorted(v for v in rim if v in fr.links) or sorted(rim & goal))
        ends = [(dist[v], v) for v in goal if v in dist]
        if not ends:
            return self.least_cut(source, sink)
        way = back(pred, min(ends)[1])[::-1]
        wall = edges_of(way)
        free = set(self.ring) - source - sink
        sides = [self._beside(faces, wall, free) for faces in (fr.one_faces, fr.two_faces)]
        if sides[0] & sides[1]:
            return self.least_cut(source, sink)
        total = sum(weight.values())
        best, low, high = None, 0, len(way) - 1
        while low <= high:
            at = (low + high) // 2
            found = self._through(way, at, wall, fr, sides, source, sink, weight, total)
            if found is not None and (best is None or (found[0], at) < best[:2]):
                best = (found[0], at, found[2])
            if found is None or found[1] < total / 2:
                low = at + 1
            else:
                high = at - 1
        if best is None:
            return self.least_cut(source, sink)
        return self.crossed(best[2]), self.flood(source, best[2])

    def _beside(self, faces: list[int], wall: set[Edge], free: set[int]) -> set[int]:
        return self.flood({f for f in faces if f in free}, wall, free)

    def _through(self, way, at, wall, fr, sides, source, sink, weight, total):
        """(score, weight of the source's side, edges) of the best cut through way[at]."""
        v, found = way[at], []
        before, after = edges_of(way[: at + 1]), edges_of(way[at:])
        for own, other, stretch, faces in ((sides[0], sides[1], fr.one, fr.one_faces), (sides[1], sides[0], fr.two, fr.two_faces)):

            def allowed(a, b, other=other):
                return self.side.get((a, b)) not in other and self.side.get((b, a)) not in other or (min(a, b), max(a, b)) in wall

            dist, pred = ways(fr.links, [v], allowed)
            leaves = [i for i, u in enumerate(stretch) if u in dist]
            if not leaves:
                return None
            tree: set[Edge] = set()
            met = {v}
            for i in leaves:
                u = stretch[i]
                while u not in met:
                    met.add(u)
                    tree.add((min(u, pred[u]), max(u, pred[u])))
                    u = pred[u]
            found.append((leaves, [dist[stretch[i]] for i in leaves], self._left_of(own, tree | wall, before, after, source, sink, faces, weight), pred, stretch))
        (la, da, wa, pa, sa), (lb, db, wb, pb, sb) = found
        own = sum(weight[f] for f in source)
        length = np.array(da)[:, None] + np.array(db)[None]
        left = own + wa[la][:, None] + wb[lb][None]
        score = 0.5 * length + 0.5 * np.abs(0.5 * total - left)
        i, j = np.unravel_index(int(np.argmin(np.round(score, 9))), score.shape)
        return round(float(score[i, j]), 9), float(left[i, j]), edges_of(back(pa, sa[la[i]])) | edges_of(back(pb, sb[lb[j]]))

    def _left_of(self, own, wall, before, after, source, sink, faces, weight) -> np.ndarray:
        """For each vertex of a stretch the weight of own that lies on the source's side of the tree's way there."""
        first, last, part = set(), set(), {}
        label = 0
        for f in sorted(own):
            if f in part:
                continue
            for g in self.flood({f}, wall, own):
                part[g] = label
                for a, b in self.ring[g]:
                    h, e = self.side.get((b, a)), (a, b) if a < b else (b, a)
                    if e in before or h in source and e not in wall:
                        first.add(label)
                    elif e in after or h in sink and e not in wall:
                        last.add(label)
            label += 1
        load = np.zeros(label + 1)
        for g, p in part.items():
            load[p] += weight[g]
        out, seen = [sum(load[p] for p in first)], set(first) | last
        for f in faces:
            p = part.get(f)
            more = 0.0
            if p is not None and p not in seen:
                seen.add(p)
                more = load[p]
            out.append(out[-1] + more)
        return np.array(out)
