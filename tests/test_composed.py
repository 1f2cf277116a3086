"""The composed placement, routing and placement kernels: brute force, invariants and fallbacks."""

import heapq
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertiplan.operators import facilities as P
from vertiplan.operators import graph as N
from vertiplan.operators import placement as O
from vertiplan.operators import routing as Z
from vertiplan.operators import spatial as J
from vertiplan.plans import api, composed, queries

SMALL = "/root/testdata/sf0.001"


def _clear(a, b, boxes, slack: float = 1e-9) -> bool:
    for x0, x1, y0, y1 in boxes:
        lo, hi = 0.0, 1.0
        for s, d, m, n in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
            if abs(d) < 1e-15:
                if s <= m or s >= n:
                    lo, hi = 1.0, 0.0
            else:
                t, u = sorted(((m - s) / d, (n - s) / d))
                lo, hi = max(lo, t), min(hi, u)
        if hi - lo > slack:
            return False
    return True


def _shortest(a: tuple[float, float], b: tuple[float, float], boxes: list[tuple[float, float, float, float]]) -> tuple[str, list[tuple[float, float]] | None]:
    """Shortest way from a to b around boxes: straight if clear, else over their corners."""
    if any(x0 < p[0] < x1 and y0 < p[1] < y1 for p in (a, b) for x0, x1, y0, y1 in boxes):
        return "end_in_zone", None
    if _clear(a, b, boxes):
        return "clear", [a, b]
    points = [a, b, *dict.fromkeys((x, y) for x0, x1, y0, y1 in boxes for x in (x0, x1) for y in (y0, y1))]
    best, before, heap, done = {0: 0.0}, {}, [(0.0, 0)], set()
    while heap:
        d, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        if i == 1:
            path = [1]
            while path[-1] in before:
                path.append(before[path[-1]])
            return "detour", [points[j] for j in path[::-1]]
        for j, to in enumerate(points):
            if j not in done and _clear(points[i], to, boxes):
                c = d + math.hypot((to[0] - points[i][0]) * math.cos(math.radians(to[1])), to[1] - points[i][1])
                if c < best.get(j, math.inf):
                    best[j], before[j] = c, i
                    heapq.heappush(heap, (c, j))
    return "no_path", None



def _km(a, b):
    (x1, y1), (x2, y2) = a, b
    s, t = math.sin(math.radians(y2 - y1) / 2), math.sin(math.radians(x2 - x1) / 2)
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(s * s + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * t * t)))


def _points(rng, n, lon=36.8, lat=55.3, spread=0.1):
    return [(i, lon + rng.uniform(0, spread), lat + rng.uniform(0, spread / 2)) for i in range(n)]


def test_routes_are_clear_and_hardly_longer_than_the_shortest():
    rng, ratios = random.Random(1), []
    for k in range(40):
        boxes = []
        for _ in range(rng.randint(1, 5)):
            x, y = rng.uniform(300, 3000), rng.uniform(-700, 700)
            boxes.append((x, x + rng.uniform(50, 500), y, y + rng.uniform(50, 700)))
        a, b = (0.0, 0.0), (3500.0, rng.uniform(-300, 300))
        o = Z.Obstacles([[(x0, y0), (x1, y0), (x1, y1), (x0, y1)] for x0, x1, y0, y1 in boxes])
        status, path = Z.route(o, a, b, lattice=k % 2 == 0)
        # the yardstick works in degrees at the equator, where its plane is this one
        best_status, best = _shortest(*[(p[0] * 1e-7, p[1] * 1e-7) for p in (a, b)], [tuple(v * 1e-7 for v in box) for box in boxes])
        assert status == "no_path" or (status == "clear") == (best_status == "clear")
        if path is not None:
            assert o.clear(path) and path[0] == a and path[-1] == b
            ratios.append(Z.length(path) / (sum(math.dist(p, q) for p, q in itertools.pairwise(best)) * 1e7))
    assert len(ratios) >= 38 and min(ratios) > 1 - 1e-4 and statistics.median(ratios) < 1.05 and max(ratios) < 1.6


def test_routes_around_a_hollow_shape():
    u = Z.Obstacles([[(1000, -400), (1400, -400), (1400, 300), (1300, 300), (1300, -300), (1100, -300), (1100, 300), (1000, 300)]])
    status, path = Z.route(u, (0, 0), (2000, 0))
    assert status in ("boundary", "lattice") and u.clear(path)
    assert Z.route(u, (1200, 0), (2000, 0))[0] in ("boundary", "lattice") and Z.route(u, (1050, 0), (2000, 0)) == ("end_in_zone", None)
    assert Z.route(Z.Obstacles([]), (0, 0), (1, 1)) == ("clear", [(0, 0), (1, 1)])
    # along an edge and over a corner nothing is blocked
    box = Z.Obstacles([[(0, 0), (10, 0), (10, 10), (0, 10)]])
    assert not box.blocks((-5, 0), (15, 0)) and not box.blocks((-5, 5), (5, -5)) and box.blocks((-1, 5), (1, 5))


def test_smoothing_stays_within_bounds():
    path = [(0.0, 0.0), (100.0, 900.0), (300.0, -200.0), (1000.0, 0.0)]
    o = Z.Obstacles([[(150, 0), (160, 0), (160, 300), (150, 300)]])
    smooth = Z.polish(o, path)
    assert o.clear(smooth) and Z.length(smooth) <= 1.12 * Z.length(path) and len(smooth) > len(path)
    assert len(Z.densified(path, 5.0, 36)) <= 36 and Z.densified(path, 320.0, 36)[0] == path[0]
    assert Z.cut_corners(path, 0.25, 1)[1] == pytest.approx((75.0, 675.0))


def test_routed_rows(spark):
    rings = spark.createDataFrame([(1, [(0.01, -0.01), (0.02, -0.01), (0.02, 0.01), (0.01, 0.01)])], "ring_id long, ring array<struct<x:double,y:double>>")
    rows = [(1, 0.0, 0.0, 0.03, 0.0), (2, 0.0, 0.05, 0.03, 0.05), (3, 0.015, 0.0, 0.03, 0.0), (4, None, 0.0, 1.0, 0.0), (5, 0.0, 0.0, 0.0, 0.0)]
    got = {r.edge: r for r in Z.routed(spark.createDataFrame(rows, "edge long, ax double, ay double, bx double, by double"), rings, "edge").collect()}
    assert [got[i].status for i in (2, 3, 4, 5)] == ["clear", "end_in_zone", "missing", "clear"] and got[1].status in ("boundary", "lattice")
    assert got[1].km > 3.33 and got[2].km == pytest.approx(_km((0, 0.05), (0.03, 0.05))) and got[3].path is None and got[4].path is None
    core = rings.limit(0)
    walls = spark.createDataFrame([(1, 0, 0, i, *e) for i, e in enumerate([(0.01, -0.01, 0.02, -0.01), (0.02, -0.01, 0.02, 0.01), (0.02, 0.01, 0.01, 0.01), (0.01, 0.01, 0.01, -0.01)])], "zone_id long, part_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    req = spark.createDataFrame([r for r in rows if r[0] in (1, 2, 3)], "edge long, ax double, ay double, bx double, by double")
    modes = {r.edge: r["mode"] for r in Z.with_modes(req, rings, core, "edge", walls, walls.limit(0)).collect()}
    assert modes == {1: "routed", 2: "routed", 3: "routed"}  # around nothing, edge 3 is straight
    modes = {r.edge: r["mode"] for r in Z.with_modes(req, rings, rings, "edge", walls, walls.limit(0)).collect()}
    assert modes[3] == "straight_clear_core_nfz"
    assert {r.edge: r["mode"] for r in Z.with_modes(req, rings, rings, "edge", walls, walls).collect()}[3] == "forced_straight"


@pytest.mark.parametrize(("lon", "lat"), [(36.8, 55.3), (179.95, 10.0), (0.0, 89.9), (20.0, -89.95), (-0.05, -0.05)])
def test_pairs_within_a_distance_anywhere(spark, lon, lat):
    rng = random.Random(3)
    p = [(i, (lon + rng.uniform(0, 0.2 if abs(lat) < 80 else 360) + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(0, 0.1)))) for i in range(150)]
    df = spark.createDataFrame([*p, (999, None, 1.0)], "id long, lon double, lat double")
    got = {(r.l_id, r.r_id) for r in J.within_km(df, df, 3.0, "id", "id").collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if _km(a[1:], b[1:]) <= 3.0}


def _coverage(rng, n=25, m=60):
    c, d = _points(rng, n), [(*x, float(rng.randint(1, 50))) for x in _points(rng, m)]
    return c, d


def test_greedy_rules_like_brute_force(spark):
    rng = random.Random(5)
    for _ in range(2):
        c, d = _coverage(rng)
        cs, ds = spark.createDataFrame(c, "candidate long, lon double, lat double"), spark.createDataFrame(d, "demand long, lon double, lat double, weight double")
        near = {x[0]: {y[0] for y in d if _km(x[1:], y[1:3]) <= 2.0} for x in c}
        weight, place = {y[0]: y[3] for y in d}, {x[0]: x[1:] for x in c}
        total = sum(weight.values())
        # coverage with a least distance
        covered, chosen = set(), []
        while sum(weight[y] for y in covered) / total < 0.7:
            free = [x for x in place if all(_km(place[x], place[z]) >= 1.5 for z in chosen) and x not in chosen]
            best = max(free, key=lambda x: (round(sum(weight[y] for y in near[x] - covered), 6), -x), default=None)
            if best is None or not near[best] - covered:
                break
            chosen.append(best)
            covered |= near[best]
        assert [r.candidate for r in P.cover(cs, ds, 2.0, 0.7, 1.5).orderBy("step").collect()] == chosen
        # medians
        best_km, chosen = dict.fromkeys(weight, 4.0), []
        for _ in range(3):
            free = [x for x in place if all(_km(place[x], place[z]) > 2.0 for z in chosen)]
            if not free:
                break
            best = max(free, key=lambda x: (round(sum(weight[y] * (4.0 - min(best_km[y], _km(place[x], d[y][1:3]))) for y in near[x]), 6), -x))
            chosen.append(best)
            for y in near[best]:
                best_km[y] = min(best_km[y], _km(place[best], d[y][1:3]))
        got = {r.step: r.candidate for r in P.medians(cs, ds, 3, 2.0).collect()}
        assert set(got.items()) <= set(enumerate(chosen, 1)) and got[1] == chosen[0]
        # A stations by all core demand, B stations by what is left
        least = float(np.quantile(list(weight.values()), 0.5))
        core = {y for y in weight if weight[y] >= least}
        mid = tuple(sum(y[i] * y[3] for y in d) / total for i in (1, 2))
        covered, chosen = set(), []
        for kind, ratio in (("charge_a", 0.2), ("charge_b", 0.5)):
            while len(chosen) < 6:
                def apart(x, kind=kind):
                    return 2.0 * ((0.4 if _km(place[x], mid) <= 2.0 else 0.8) if kind == "charge_a" else 0.5)
                free = [x for x in place if x not in [z for z, _ in chosen] and all(_km(place[x], place[z]) >= apart(x) for z, _ in chosen)]
                gain = {x: sum(weight[y] for y in (near[x] & core if kind == "charge_a" else near[x] - covered)) for x in free}
                best = max(gain, key=lambda x: (round(gain[x], 6), -x), default=None)
                if best is None or gain[best] <= 0:
                    break
                chosen.append((best, kind))
                covered |= near[best] & core if kind == "charge_a" else near[best]
                if sum(weight[y] for y in covered) / total >= ratio:
                    break
        rows = P.charge_by_coverage(cs, ds, 2.0, 0.2, 0.5, 6).orderBy("step").collect()
        assert [(r.candidate, r.station_type) for r in rows] == chosen


def test_reserve_station(spark):
    cs = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "candidate long, lon double, lat double")
    far = spark.createDataFrame([(1, 3.0, 3.0, 5.0)], "demand long, lon double, lat double, weight double")
    assert [(r.candidate, r.station_type, r.gain) for r in P.charge_by_coverage(cs, far, 1.0, 0.5, 0.5, 5).collect()] == [(2, "charge_a", 0.0)]
    assert P.charge_by_coverage(cs, far.limit(0), 1.0, 0.5, 0.5, 5).count() == 0
    assert [r.candidate for r in P.medians(cs, far.limit(0), 1, 1.0).collect()] == [1]


def test_betweenness_like_all_shortest_paths(spark):
    rng = random.Random(6)
    nodes = list(range(9))
    edges = [(a, b, float(rng.randint(1, 3))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.35]
    dist = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for a, b, w in edges:
        dist[a, b] = dist[b, a] = min(w, dist[a, b])
    for k, a, b in itertools.product(nodes, repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    next_to = {a: [(b, w) for x, y, w in edges for u, b in ((x, y), (y, x)) if u == a] for a in nodes}

    def paths(a, b):
        return [[b]] if a == b else [[a, *p] for c, w in next_to[a] if math.isclose(w + dist[c, b], dist[a, b]) for p in paths(c, b)]

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if dist[s, t] < math.inf:
            every = paths(s, t)
            for v in nodes:
                if v not in (s, t):
                    want[v] += sum(v in p for p in every) / len(every)
    got = {r.node: r.betweenness for r in P.betweenness(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert all(math.isclose(got[n], 2 * want[n] / (8 * 7), abs_tol=1e-9) for n in nodes)
    with pytest.raises(ValueError):
        P.betweenness(spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long, weight double"), most=4)


def test_repairs_join_parts_by_the_shortest_pairs(spark):
    rng = random.Random(7)
    pairs = [(a, b, float(w)) for w, (a, b) in enumerate(rng.sample(list(itertools.combinations(range(10), 2)), 30))]
    have = pairs[20:24]
    part = list(range(10))

    def join(a, b):
        old, new = part[a], part[b]
        part[:] = [new if x == old else x for x in part]

    for a, b, _ in have:
        join(a, b)
    want = []
    for a, b, w in sorted(pairs, key=lambda e: e[2]):
        if part[a] != part[b]:
            want.append((a, b, w))
            join(a, b)
    e = "a long, b long, weight double"
    got = N.repairs(spark.range(10).withColumnRenamed("id", "node"), spark.createDataFrame(have, e), spark.createDataFrame(pairs, e)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stations_without_a_roof(spark):
    centres = spark.createDataFrame([(1, 5.0, 0.0, 0.0), (2, 9.0, 0.1, 0.0), (3, 1.0, 0.2, 0.0)], "cluster long, weight double, lon double, lat double")
    regions = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "cluster long, region string")
    candidates = spark.createDataFrame([(10, 0.001, 0.0), (11, 0.002, 0.0)], "candidate long, lon double, lat double")
    hulls = spark.createDataFrame([(10, 1), (11, 1)], "candidate long, cluster long")
    members = spark.createDataFrame([(1, 100, 0.0, 0.0), (2, 101, 0.101, 0.0), (2, 102, 0.11, 0.0)], "cluster long, building_id long, lon double, lat double")
    got = {r.cluster: r for r in composed.forced_stations(centres, regions, candidates, hulls, members).collect()}
    assert (got[1].source_index, got[1].station_type) == (10, "charge_b") and (got[2].source_index, got[2].lon, got[2].station_type) == (-1, 0.101, "charge_a")
    assert got[3].source_index == 11  # no hull: the nearest roof of all


def test_trunks(spark):
    a = spark.createDataFrame([(i, 36.8 + 0.01 * i if i < 4 else 37.2 + 0.01 * i, 55.3) for i in range(7)], "a long, lon double, lat double")
    tree = composed.trunk_of(a, extra=0).collect()
    assert {(r.a, r.b) for r in tree} == {(i, i + 1) for i in range(6)}
    knn = composed.trunk_of(a, "knn", extra=0)
    label = N.components(a.select(F.col("a").alias("node")), knn.select("a", "b")).select("component").distinct().count()
    assert label == 1
    more = composed.trunk_of(a, extra=2, most_km=1.5).where("extra").collect()
    assert {(r.a, r.b) for r in more} <= {(i, i + 2) for i in range(5)}
    with pytest.raises(ValueError):
        composed.trunk_of(a, "star")


def test_trunk_of_all_pairs_without_them(spark, monkeypatch):
    """Stations in far parts, on a lattice with many equal distances, over a pole and in one place."""
    rng = random.Random(5)
    places = [(36.8 + 0.05 * (i % 6), 55.2 + 0.03 * (i // 6)) for i in range(36)]
    places += [(-120 + rng.random(), 10 + rng.random()) for _ in range(15)] + [(10 + 90.0 * i, 89.97) for i in range(4)] + [(150.0, -40.0)] * 3
    a = spark.createDataFrame([(3 * i, *p) for i, p in enumerate(places)], "a long, lon double, lat double").repartition(5)
    pairs = N.all_pairs(a, "a")
    want = {tuple(r) for r in N.spanning_forest(a.select(F.col("a").alias("node")), pairs).collect()}
    near = {tuple(r) for r in pairs.where("weight <= 3.5").collect()}

    def made(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(N, "all_pairs", made)
    got = composed.trunk_of(a, extra=2, most_km=3.5).collect()
    assert {(r.a, r.b, r.weight) for r in got if not r.extra} == want and len(want) == len(places) - 1
    assert {(r.a, r.b, r.weight) for r in got if r.extra} <= near - want
    assert composed.trunk_of(a.limit(1)).count() == composed.trunk_of(a.limit(0)).count() == 0



def test_neighbours_by_tiles_are_those_of_the_whole(spark):
    rng = random.Random(8)
    p = [(i, i % 4, 36.8 + rng.uniform(0, 0.3), 55.3 + rng.uniform(0, 0.3)) for i in range(400)]
    ids = spark.createDataFrame(p, "site long, cluster long, lon double, lat double")
    near = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a != b], "ca long, cb long")
    got = {(r.a, r.b) for r in O.global_neighbours(ids, near, 1.0).collect() if p[r.a][1] != p[r.b][1]}
    whole = O.triangulate(np.array([x[2:] for x in p]))
    assert got == {(a, b) for a, b in whole if p[a][1] != p[b][1] and _km(p[a][2:], p[b][2:]) <= 1.0}


def test_station_hulls(spark):
    stations = spark.createDataFrame([(1, 0.0, 0.0, 7), (2, 0.0, 0.0, None), (3, 0.5, 0.0, None)], "station long, lon double, lat double, cluster long")
    members = spark.createDataFrame([(1, 0.001, 0.0), (2, 0.002, 0.0), (3, 0.45, 0.0)], "cluster long, lon double, lat double")
    assert {r.station: r.cluster for r in P.station_hulls(stations, members, 1.0).collect()} == {1: 7, 2: 1, 3: 3}


def test_placement_layers(spark):
    layers = api.placement(spark, SMALL)
    a, b = layers["charge_a"].count(), layers["charge_b"].count()
    stations = {r.cluster for k in ("charge_a", "charge_b") for r in layers[k].collect()}
    assert a + b == len(stations) == 10 and layers["charge_a"].first().levels == [1, 2, 3, 4, 5]
    trunk = layers["trunk"].collect()
    ids = {r.cluster for r in layers["charge_a"].collect()}
    assert {x for r in trunk for x in (r.a, r.b)} <= ids and sum(not r.extra for r in trunk) == a - 1
    links = layers["branches"].collect()
    assert {r.b for r in links} == stations - ids and {r.a for r in links} <= ids and all(r.weight_km > 0 and len(r.path) > 1 for r in links)
    assert layers["metrics"].first().connected
    routes = queries.queries()["local_routes_clear"](spark, SMALL).collect()
    assert all(r.clear for r in routes)


def test_routes_over_the_pole_meet_obstacles(spark):
    box = [(0.01, 89.999), (0.02, 89.999), (0.02, 90.001), (0.01, 90.001)]
    rings = spark.createDataFrame([(1, box), (2, [(x, y + 3) for x, y in box])], "ring_id long, ring array<struct<x:double,y:double>>")
    rows = [(1, 0.0, 90.0, 0.03, 90.0), (2, 0.0, 93.0, 0.03, 93.0)]
    got = Z.routed(spark.createDataFrame(rows, "edge long, ax double, ay double, bx double, by double"), rings, "edge").collect()
    assert {r.status for r in got} <= {"boundary", "lattice"}


def test_modes_search_each_route_once(spark, tmp_path, monkeypatch):
    rings = spark.createDataFrame([(1, [(0.01, -0.01), (0.02, -0.01), (0.02, 0.01), (0.01, 0.01)])], "ring_id long, ring array<struct<x:double,y:double>>")
    rows = [(1, 0.0, 0.0, 0.03, 0.0), (2, 0.0, 0.001, 0.03, 0.001), (3, 0.015, 0.0, 0.03, 0.0)]  # the last starts in the ring
    req = spark.createDataFrame(rows, "edge long, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame([], "zone_id long, part_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    search, log = Z.route, str(tmp_path / "searched")

    def logged(obstacles, a, b, lattice=True):
        with open(log, "a") as f:
            f.write(f"{a} {b}\n")
        return search(obstacles, a, b, lattice)

    monkeypatch.setattr(Z, "route", logged)
    got = {r.edge: r["mode"] for r in Z.with_modes(req, rings, rings.limit(0), "edge", walls, walls).collect()}
    assert got == {1: "routed", 2: "routed", 3: "routed"}
    assert len(open(log).readlines()) == len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_many_greedy_picks(spark, seed):
    rng = random.Random(seed)
    c, d = _points(rng, 150, spread=0.2), [(i, x, y, rng.randint(1, 300) / 10) for i, x, y in _points(rng, 200, spread=0.2)]
    want, covered = [], set()
    for step in range(1, 81):
        rest = [p for p in c if p[0] not in [w[1] for w in want]]
        far = [p for p in rest if all(_km(p[1:], c[w[1]][1:]) >= 1.0 for w in want)]
        gain = {p[0]: round(sum(w for i, x, y, w in d if i not in covered and _km(p[1:], (x, y)) <= 2.0), 6) for p in far or rest}
        best = min(gain, key=lambda i: (-gain[i], i))
        want.append((step, best, round(gain[best], 3)))
        covered |= {i for i, x, y, _ in d if _km(c[best][1:], (x, y)) <= 2.0}
    candidates, demand = spark.createDataFrame(c, "candidate long, lon double, lat double"), spark.createDataFrame(d, "demand long, lon double, lat double, weight double")
    assert [tuple(r) for r in O.place_n(candidates, demand, 80, 2.0, 1.0).orderBy("step").collect()] == want
    assert [tuple(r) for r in O.place_n(candidates, demand, 5, 2.0, 1.0, one_task=0).orderBy("step").collect()] == want[:5]
