"""Safe routes around polygons: boundary detours, lattice search, tightening and smoothing.

Requests meet the obstacles near them in a join, requests with a clear straight line never leave it, and the
kernel below works on one blocked request and its few obstacles. Everything in the kernel is on a plane in
metres; a ring is an array of corners. Touching an obstacle or running along its edge is allowed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertiplan.functions.geo import METRES_PER_DEGREE, haversine_km
from vertiplan.operators import spatial as J
from vertiplan.operators.regions import without_loops
from vertiplan.session import checkpointed

# Corner-cutting settings (share of an edge, rounds) in order of strength, and the gentle ones tried last.
SMOOTHING = ((0.14, 1), (0.18, 1), (0.22, 2), (0.26, 1), (0.30, 1), (0.32, 2), (0.36, 2), (0.40, 2), (0.25, 3), (0.25, 4), (0.22, 3), (0.20, 2))
GENTLE = ((0.08, 1), (0.06, 1))
LIGHT = ((0.18, 2), (0.14, 1))
#: How much longer and wider a smoothed route may be: factor of the length, factor of the offset, metres of the offset.
GROWTH = (1.12, 1.22, 120.0)
#: Rounds and corners of a boundary detour, rounds of tightening.
MOST_FIXES, MOST_CORNERS, TIGHTENINGS = 12, 200, 8
#: Lattice search: spacing, nodes, and nodes that an end is tied to.
SPACING_M, MOST_NODES, MOST_TIES = 100.0, 10_000, 72
#: Score of a route: per km beyond the straight line, and per share of the line that it swings out beyond a free one.
EXCESS, BULGE, FREE_BULGE = 0.08, 0.52, 0.12
_EPS = 1e-6

Point = tuple[float, float]


class Obstacles:
    """Rings on a plane, and what crosses them."""

    def __init__(self, rings: list[list[Point]]) -> None:
        self.rings = [np.asarray(r, float) for r in rings if len(r) >= 3]
        self.boxes = [(*r.min(axis=0), *r.max(axis=0)) for r in self.rings]

    def holds(self, p: Point, i: int) -> bool:
        x0, y0, x1, y1 = self.boxes[i]
        if not (x0 < p[0] < x1 and y0 < p[1] < y1):
            return False
        a, b = self.rings[i], np.roll(self.rings[i], -1, axis=0)
        up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        if not up.any():
            return False
        a, b = a[up], b[up]
        at = a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        return int((at > p[0] + _EPS).sum()) % 2 == 1 and not (np.abs(at - p[0]) <= _EPS).any()

    def inside(self, p: Point) -> bool:
        return any(self.holds(p, i) for i in range(len(self.rings)))

    def cuts(self, a: Point, b: Point, i: int) -> list[tuple[float, float]]:
        """Parts of the segment, as shares of it, that run inside ring i."""
        x0, y0, x1, y1 = self.boxes[i]
        if max(a[0], b[0]) <= x0 or min(a[0], b[0]) >= x1 or max(a[1], b[1]) <= y0 or min(a[1], b[1]) >= y1:
            return []
        p, q = self.rings[i], np.roll(self.rings[i], -1, axis=0)
        d, e = np.array([b[0] - a[0], b[1] - a[1]]), q - p
        length = math.hypot(*d)
        if length < _EPS:
            return []
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        o = p - np.array(a)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (o[:, 0] * e[:, 1] - o[:, 1] * e[:, 0]) / cross, (o[:, 0] * d[1] - o[:, 1] * d[0]) / cross
        ok = (cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        at = [0.0, *sorted(t[ok].tolist()), 1.0]
        out: list[tuple[float, float]] = []
        for s, e_ in zip(at, at[1:]):
            m = (s + e_) / 2
            if (e_ - s) * length > 10 * _EPS and self.holds((a[0] + m * d[0], a[1] + m * d[1]), i):
                if out and out[-1][1] >= s:
                    out[-1] = (out[-1][0], e_)
                else:
                    out.append((s, e_))
        return out

    def blocks(self, a: Point, b: Point) -> bool:
        return any(self.cuts(a, b, i) for i in range(len(self.rings)))

    def clear(self, path: list[Point]) -> bool:
        return not any(self.blocks(a, b) for a, b in zip(path, path[1:]))

    def worst(self, a: Point, b: Point) -> tuple[int, float, float] | None:
        """(ring, start, end) of the longest overlap's ring and its first part inside."""
        best = None
        for i in range(len(self.rings)):
            if parts := self.cuts(a, b, i):
                size = sum(e - s for s, e in parts)
                if best is None or size > best[0]:
                    best = (size, i, *parts[0])
        return best and best[1:]


def length(path: list[Point]) -> float:
    return sum(math.dist(a, b) for a, b in zip(path, path[1:]))


def offset(path: list[Point]) -> float:
    """Greatest distance of a corner to the line between the ends."""
    (ax, ay), (bx, by) = path[0], path[-1]
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    out = 0.0
    for x, y in path:
        t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / size)) if size else 0.0
        out = max(out, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return out


def _outset(ring: np.ndarray, by: float) -> np.ndarray:
    """The ring with its corners moved outwards by about ``by``."""
    area = np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1])
    e = np.roll(ring, -1, axis=0) - ring
    n = np.stack([e[:, 1], -e[:, 0]], axis=1) / np.maximum(np.hypot(e[:, 0], e[:, 1]), 1e-12)[:, None] * (1 if area > 0 else -1)
    both = n + np.roll(n, 1, axis=0)
    size = np.maximum(np.hypot(both[:, 0], both[:, 1]), 0.2)
    return ring + both / size[:, None] * (2 * by / size)[:, None]


def around(obstacles: Obstacles, a: Point, b: Point) -> list[Point] | None:
    """One blocked segment led along the edge of the obstacle that it overlaps most, the shorter way round."""
    hit = obstacles.worst(a, b)
    if hit is None:
        return [a, b]
    ring = _outset(obstacles.rings[hit[0]], 0.01)
    own = Obstacles([ring.tolist()])
    parts = own.cuts(a, b, 0)
    if not parts:
        return None
    s, e = parts[0][0], parts[-1][1]
    enter, leave = ((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for t in (s, e))
    p, q = ring, np.roll(ring, -1, axis=0)

    def edge(at: Point) -> int:
        d = q - p
        t = np.clip(((np.array(at) - p) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-12), 0, 1)
        return int(np.hypot(*(p + t[:, None] * d - np.array(at)).T).argmin())

    n, i, j = len(ring), edge(enter), edge(leave)
    ahead = [tuple(ring[(i + 1 + k) % n].tolist()) for k in range((j - i) % n)]
    back = [tuple(ring[(i - k) % n].tolist()) for k in range((i - j) % n)]
    if i == j:  # in and out through one edge: the corner between lies inside
        ahead = back = [tuple(ring[(i + 1 + k) % n].tolist()) for k in range(n)]
        back = back[::-1]
    ways = [[a, enter, *w, leave, b] for w in (ahead, back)]
    return min(ways, key=length)


def boundary_detour(obstacles: Obstacles, a: Point, b: Point) -> list[Point] | None:
    """Along the obstacles' edges: the first blocked segment is led around, again and again."""
    path = [a, b]
    for _ in range(MOST_FIXES):
        at = next((k for k in range(len(path) - 1) if obstacles.blocks(path[k], path[k + 1])), None)
        if at is None:
            return path
        way = around(obstacles, path[at], path[at + 1])
        if way is None or len(path) + len(way) > MOST_CORNERS:
            return None
        path = path[:at] + way + path[at + 2 :]
    return path if obstacles.clear(path) else None


def tighten(obstacles: Obstacles, path: list[Point] | None) -> list[Point] | None:
    """Shortest visible subsequence of the corners, repeated until it no longer gets shorter."""
    if path is None:
        return None
    path = [p for k, p in enumerate(path) if not k or math.dist(p, path[k - 1]) > _EPS]
    for _ in range(TIGHTENINGS):
        n = len(path)
        best, before = [0.0] + [math.inf] * (n - 1), [0] * n
        for i in range(n):
            for j in range(i + 1, n):
                d = best[i] + math.dist(path[i], path[j])
                if d < best[j] - 1e-9 and (j == i + 1 or not obstacles.blocks(path[i], path[j])):
                    best[j], before[j] = d, i
        out = [n - 1]
        while out[-1]:
            out.append(before[out[-1]])
        shorter = [path[i] for i in out[::-1]]
        if len(shorter) == n:
            break
        path = shorter
    return path


def lattice_detour(obstacles: Obstacles, a: Point, b: Point) -> list[Point] | None:
    """A* over a lattice around both ends and the obstacles; its edges are tested when they are met."""
    boxes = np.array(obstacles.boxes).reshape(-1, 4)
    x0, y0 = min(a[0], b[0], *boxes[:, 0]) - 3 * SPACING_M, min(a[1], b[1], *boxes[:, 1]) - 3 * SPACING_M
    x1, y1 = max(a[0], b[0], *boxes[:, 2]) + 3 * SPACING_M, max(a[1], b[1], *boxes[:, 3]) + 3 * SPACING_M
    step = SPACING_M * max(1, math.ceil(math.sqrt((x1 - x0) * (y1 - y0) / SPACING_M**2 / MOST_NODES)))
    nx, ny = int((x1 - x0) / step) + 1, int((y1 - y0) / step) + 1

    def place(n: int) -> Point:
        return x0 + n % nx * step, y0 + n // nx * step

    def ties(p: Point) -> list[int]:
        reach = max(2000.0, 12 * step)
        near = sorted((math.dist(p, place(n)), n) for n in range(nx * ny) if math.dist(p, place(n)) <= reach)
        found: list[int] = []
        for _, n in near[: 8 * MOST_TIES]:
            if not obstacles.blocks(p, place(n)) and not obstacles.inside(place(n)):
                found.append(n)
                if len(found) == MOST_TIES:
                    break
        return found

    ends = set(ties(b))
    if not ends:
        return None
    best: dict[int, float] = {}
    before: dict[int, int] = {}
    heap: list[tuple[float, int]] = []
    for n in ties(a):
        best[n] = math.dist(a, place(n))
        heapq.heappush(heap, (best[n] + math.dist(place(n), b), n))
    done: set[int] = set()
    goal, through = math.inf, None
    while heap and heap[0][0] < goal:
        _, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        p = place(n)
        if n in ends and best[n] + math.dist(p, b) < goal:
            goal, through = best[n] + math.dist(p, b), n
        for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)):
            x, y = n % nx + i, n // nx + j
            if 0 <= x < nx and 0 <= y < ny and (m := y * nx + x) not in done:
                d = best[n] + math.dist(p, place(m))
                if d < best.get(m, math.inf) and not obstacles.inside(place(m)) and not obstacles.blocks(p, place(m)):
                    best[m], before[m] = d, n
                    heapq.heappush(heap, (d + math.dist(place(m), b), m))
    if through is None:
        return None
    path = [b, place(through)]
    while through in before:
        through = before[through]
        path.append(place(through))
    return [a, *path[::-1]]


def score(path: list[Point]) -> tuple[float, float]:
    """Lower is better: length over the straight line, the excess in km and how far the route swings out; ties by length."""
    chord = max(math.dist(path[0], path[-1]), 1e-6)
    size = length(path)
    return size / chord + EXCESS * max(0.0, size - chord) / 1000 + BULGE * max(0.0, offset(path) / chord - FREE_BULGE), size


def cut_corners(path: list[Point], share: float, rounds: int) -> list[Point]:
    share = min(0.45, max(0.06, share))
    for _ in range(rounds):
        if len(path) < 3:
            return path
        inner = [((1 - t) * a[0] + t * b[0], (1 - t) * a[1] + t * b[1]) for a, b in zip(path, path[1:]) for t in (share, 1 - share)]
        path = [path[0], *inner[1:-1], path[-1]]
    return path


def densified(path: list[Point], step: float, most: int) -> list[Point]:
    """Points every ``step`` metres at most; the step grows until there are ``most`` points at most."""
    step = max(20.0, step)
    while True:
        out = [path[0]]
        for a, b in zip(path, path[1:]):
            n = max(1, math.ceil(math.dist(a, b) / step - 1e-9))
            out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(1, n)] + [b]
        if len(out) <= max(8, most, len(path)):
            return out
        step *= 1.5


def polish(obstacles: Obstacles, path: list[Point]) -> list[Point]:
    """A rounder route where that stays clear and neither much longer nor much wider."""
    if len(path) < 3:
        return path
    start = densified(path, 320.0, 36) if len(path) <= 6 else path

    def strongest(path: list[Point]) -> list[Point]:
        clear = [c for c in (cut_corners(path, *s) for s in SMOOTHING) if obstacles.clear(c)]
        return clear[-1] if clear else next((c for c in (cut_corners(path, *s) for s in GENTLE) if obstacles.clear(c)), path)

    smooth = without_loops(strongest(start))
    smooth = without_loops(next((c for c in (cut_corners(smooth, *s) for s in LIGHT) if obstacles.clear(c)), smooth))
    wide = max(offset(path) * GROWTH[1], offset(path) + GROWTH[2])
    if length(smooth) > length(path) * GROWTH[0] or offset(smooth) > wide or not obstacles.clear(smooth):
        return path
    return smooth


def route(obstacles: Obstacles, a: Point, b: Point, lattice: bool = True) -> tuple[str, list[Point] | None]:
    """(status, path): ``clear`` for a straight line, ``boundary`` or ``lattice`` for a detour, by the better score,
    ``end_in_zone`` or ``no_path`` without one."""
    if obstacles.inside(a) or obstacles.inside(b):
        return "end_in_zone", None
    if not obstacles.blocks(a, b):
        return "clear", [a, b]
    ways = [("boundary", boundary_detour(obstacles, a, b))] + ([("lattice", lattice_detour(obstacles, a, b))] if lattice else [])
    ways = [(how, tighten(obstacles, path)) for how, path in ways if path is not None]
    ways = [(how, path) for how, path in ways if obstacles.clear(path)]
    if not ways:
        return "no_path", None
    how, path = min(ways, key=lambda w: score(w[1]))
    return how, polish(obstacles, tighten(obstacles, without_loops(path)) if obstacles.clear(without_loops(path)) else path)


#: Columns of a routed request.
ROUTED = "status string, path array<struct<lon:double,lat:double>>"


def _near(requests: DataFrame, rings: DataFrame, key: str, reach: float, cell: float) -> DataFrame:
    """(key, rings): of each request the rings whose boxes come within ``reach`` degrees of its own."""
    s = requests.selectExpr(key, f"least(ax, bx) - {reach} as xmin", f"greatest(ax, bx) + {reach} as xmax", f"least(ay, by) - {reach} as ymin", f"greatest(ay, by) + {reach} as ymax")
    own = J._box_cells(s, cell).select(key, "_cx", "_cy", *[F.col(c).alias(f"s{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
    box = rings.selectExpr("ring_id", "ring", "array_min(ring.x) as xmin", "array_max(ring.x) as xmax", "array_min(ring.y) as ymin", "array_max(ring.y) as ymax")
    near = own.join(J._box_cells(box, cell), ["_cx", "_cy"]).where("sxmin <= xmax and sxmax >= xmin and symin <= ymax and symax >= ymin")
    # a request crosses the box of itself and its reach only, so these are few
    return near.select(key, "ring_id", "ring").distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ring_id", "ring"))).alias("rings"))


def routed(requests: DataFrame, rings: DataFrame, key: str, lattice: bool = True, reach: float = 0.02, cell: float = 0.05) -> DataFrame:
    """requests (key, ax, ay, bx, by, ...), rings (ring_id, ring array<struct<x,y>>) -> (key, status, path, km): the safe
    route of each request around the rings near it. Only rows with a ring near their line reach the kernel. Null or
    missing coordinates have the status ``missing``; repeated requests are each routed."""
    near = checkpointed(_near(requests.select(key, "ax", "ay", "bx", "by").where("ax is not null and ay is not null and bx is not null and by is not null"), rings, key, reach, cell))
    every = requests.select(key, "ax", "ay", "bx", "by").join(near, key, "left")
    straight = F.array(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat")), F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat")))
    known = F.col("ax").isNotNull() & F.col("ay").isNotNull() & F.col("bx").isNotNull() & F.col("by").isNotNull()
    open_ = every.where("rings is null").select(key, F.when(known, "clear").otherwise("missing").alias("status"), F.when(known, straight).alias("path"))

    def run(frames):
        for f in frames:
            out = []
            for k, ax, ay, bx, by, found in zip(f[key], f["ax"], f["ay"], f["bx"], f["by"], f["rings"], strict=True):
                # at a pole the plane would have no width
                per_lon = METRES_PER_DEGREE * max(0.01, abs(math.cos(math.radians((ay + by) / 2))))
                obstacles = Obstacles([[(p["x"] * per_lon, p["y"] * METRES_PER_DEGREE) for p in r["ring"]] for r in found])
                status, path = route(obstacles, (ax * per_lon, ay * METRES_PER_DEGREE), (bx * per_lon, by * METRES_PER_DEGREE), lattice)
                ends = {0: (ax, ay), len(path or ()) - 1: (bx, by)}
                out.append((k, status, path and [dict(zip(("lon", "lat"), ends.get(i) or (x / per_lon, y / METRES_PER_DEGREE), strict=True)) for i, (x, y) in enumerate(path)]))
            yield pd.DataFrame(out, columns=[key, "status", "path"])

    kind = requests.schema[key].dataType.simpleString()
    blocked = every.where("rings is not null").select(key, "ax", "ay", "bx", "by", "rings").mapInPandas(run, f"{key} {kind}, {ROUTED}")
    both = open_.unionByName(blocked)
    at = lambda i: F.element_at("path", i.cast("int"))
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: haversine_km(at(i)["lat"], at(i)["lon"], at(i + 1)["lat"], at(i + 1)["lon"]))
    return both.withColumn("km", F.when(F.col("path").isNotNull(), F.aggregate(step, F.lit(0.0), lambda a, x: a + x)))


def boxes_as_rings(rects: DataFrame, key: str, grow: float = 0.0) -> DataFrame:
    """(ring_id, ring) of boxes (key, xmin, xmax, ymin, ymax), grown by ``grow`` degrees on all sides."""
    x0, x1, y0, y1 = F.col("xmin") - grow, F.col("xmax") + grow, F.col("ymin") - grow, F.col("ymax") + grow
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return rects.select(F.col(key).alias("ring_id"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))


def segments_of(routes: DataFrame, key: str) -> DataFrame:
    """(segment struct<key, i>, ax, ay, bx, by) of paths."""
    e = routes.where("path is not null").select(key, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    a, b = F.element_at("path", F.col("i")), F.element_at("path", F.col("i") + 1)
    return e.select(F.struct(key, "i").alias("segment"), a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by"))


def clear_routes(routes: DataFrame, edges: DataFrame, key: str, zone: str) -> DataFrame:
    """routes (key, path), polygon edges -> (key, clear): whether no segment of a route runs inside a polygon. A route
    without a path is not clear."""
    s = segments_of(routes, key)
    # half a metre is within what a detour may cut off a corner by rounding
    hit = J.blocked_segments(s, edges, "segment", zone).select(F.col(f"segment.{key}").alias(key)).distinct().withColumn("hit", F.lit(True))
    return routes.join(hit, key, "left").select(key, (F.col("path").isNotNull() & F.col("hit").isNull()).alias("clear"))


def with_modes(requests: DataFrame, strict: DataFrame, loose: DataFrame, key: str, buffered: DataFrame, core: DataFrame) -> DataFrame:
    """(key, mode, path, km): every request gets a line. ``routed`` around all rings, else around the loose ones, else
    straight: clear of the unbuffered polygons, clear of the core ones, or forced. buffered, core: polygon edges (zone_id)."""
    # what follows reads them several times, and each time would search every route anew
    s = checkpointed(routed(requests, strict, key).select(key, F.col("path").alias("p1"), F.col("km").alias("k1")))
    still = checkpointed(requests.join(s.where("p1 is null").select(key), key, "left_semi"))
    r = routed(still, loose, key).select(key, F.col("path").alias("p2"), F.col("km").alias("k2"))
    straight = F.array(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat")), F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat")))
    out = requests.select(key, "ax", "ay", "bx", "by").join(s, key, "left").join(r, key, "left")
    for name, walls in (("hit_all", buffered), ("hit_core", core)):
        hit = J.blocked_segments(still, walls, key, "zone_id").select(key).distinct().withColumn(name, F.lit(True))
        out = out.join(hit, key, "left")
    mode = F.when(F.coalesce("k1", "k2").isNotNull(), "routed").when(F.col("hit_all").isNull(), "straight_clear_buffer").when(F.col("hit_core").isNull(), "straight_clear_core_nfz").otherwise("forced_straight")
    return out.select(key, mode.alias("mode"), F.coalesce("p1", "p2", straight).alias("path"), F.coalesce("k1", "k2", haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))).alias("km"))


def with_lines(requests: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """(key, path, km): the route of each request, the straight line where it has none."""
    straight = F.array(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat")), F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat")))
    own = requests.select(key, "ax", "ay", "bx", "by").join(routes.select(key, "path", "km"), key, "left")
    return own.select(key, F.coalesce("path", straight).alias("path"), F.coalesce("km", haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))).alias("km"))
