"""Graph operators on edge tables: components, spanning trees, DBSCAN, path search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertiplan.functions.geo import haversine_km
from vertiplan.operators import spatial as J
from vertiplan.session import checkpointed


#: Edges that a task holds beside a forest before it folds them into it.
HELD = 1_000_000


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of ``n`` over edges: roots go under smaller ones beside them, at least half each round."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        a, b = lo[lo != hi], hi[lo != hi]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    return root


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row numbers of the minimum spanning forest of edges in order of (w, a, b), by Boruvka's rounds."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.lexsort((b, a, w))
    x, y, rank = ends[: len(a)][order], ends[len(a) :][order], np.arange(len(a))
    root, chosen = np.arange(len(ids)), []
    while len(rank):
        ra, rb = root[x[rank]], root[y[rank]]
        rank, ra, rb = rank[ra != rb], ra[ra != rb], rb[ra != rb]
        best = np.full(len(ids), len(a))
        np.minimum.at(best, ra, rank)
        np.minimum.at(best, rb, rank)
        new = np.unique(best[best < len(a)])
        chosen.append(new)
        root = _roots(len(ids), root[x[new]], root[y[new]])[root]
    return order[np.concatenate([np.empty(0, int), *chosen])]


def _folded(frames, fold):
    """Rows of frames, folded whenever as many as are kept or ``HELD`` have come."""
    held, size, kept = [], 0, 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size > kept + max(kept, HELD):
            held = [fold(pd.concat(held, ignore_index=True))]
            size = kept = len(held[0])
    if held:
        yield fold(pd.concat(held, ignore_index=True))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (a, b) -> (node, component): the least node reachable.

    Every task folds its edges into one from each node to the least of its part, and one task folds these: it
    holds the nodes that have edges, never the edges.
    """

    def stars(f: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(f[["a", "b"]].to_numpy().T, return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = _roots(len(ids), a, b)
        keep = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[keep], "b": ids[root[keep]]})

    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(lambda x: _folded(x, stars), "a long, b long")
    label = checkpointed(ends.repartition(1).mapInPandas(lambda x: _folded(x, stars), "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component")))
    return nodes.select("node").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (a, b, weight) -> the minimum spanning forest's edges, ties by (weight, a, b).

    An edge that is not in the forest of some edges is not in that of all: every task keeps the forest of its own edges, and
    one task that of these; it holds as many edges as there are nodes, never all.
    """

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        return f.iloc[_forest(f["a"].to_numpy(), f["b"].to_numpy(), f["weight"].to_numpy())]

    e = edges.selectExpr("cast(least(a, b) as long) as a", "cast(greatest(a, b) as long) as b", "cast(weight as double) as weight").where("a <> b")
    e = e.mapInPandas(lambda x: _folded(x, fold), "a long, b long, weight double")
    return checkpointed(e.repartition(1).mapInPandas(lambda x: _folded(x, fold), "a long, b long, weight double"))


def dbscan(points: DataFrame, eps_m: float, least: int, latitude: float) -> DataFrame:
    """points (point_id, lon, lat) -> (point_id, cluster, core): density clusters on the plane of a latitude;
    noise has a null cluster.

    Cells of side eps / sqrt(2) hold points that are all neighbours. A cell with ``least`` points is all core,
    and its core points are one component, so components are found among cells: of two cells only
    the fact that some core points are near enough is kept, not the pairs.
    """
    import math

    per_lat, per_lon = 111_320.0, 111_320.0 * math.cos(math.radians(latitude))
    side = eps_m / math.sqrt(2) * (1 - 1e-12)
    p = checkpointed(points.select("point_id", (F.col("lon") * per_lon).alias("x"), (F.col("lat") * per_lat).alias("y")).withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)))
    counts = p.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    sparse = p.join(counts, ["cx", "cy"]).where(F.col("n") < least)
    near = F.explode(F.expr("filter(flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> named_struct('i', i, 'j', j)))), o -> abs(o.i) + abs(o.j) < 4)"))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("o", near).withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j")).drop("o")

    other = p.selectExpr("point_id as q", "x as qx", "y as qy", "cx", "cy")
    close = F.col("qx").isNotNull() & ((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 <= eps_m * eps_m)
    degree = around(sparse.select("point_id", "x", "y", "cx", "cy")).join(other, ["cx", "cy"]).where(close).groupBy("point_id").agg(F.count("*").alias("d")).where(F.col("d") >= least)
    core_ids = p.join(counts.where(F.col("n") >= least), ["cx", "cy"], "left_semi").select("point_id").union(degree.select("point_id"))
    core = checkpointed(p.join(core_ids, "point_id", "left_semi"))
    cell = F.struct("cx", "cy")
    cells = core.groupBy("cx", "cy").agg(F.min("point_id").alias("node"))
    named = core.join(cells, ["cx", "cy"])
    q = named.selectExpr("node as b", "x as qx", "y as qy", "cx", "cy")
    links = around(named.select(F.col("node").alias("a"), "x", "y", "cx", "cy")).join(q, ["cx", "cy"]).where("a < b").where(close).select("a", "b").distinct()
    label = components(cells.select("node"), links)
    labelled = named.join(label, "node").select("point_id", "x", "y", "cx", "cy", F.col("component").alias("cluster"))
    border = around(p.join(core_ids, "point_id", "left_anti")).join(labelled.selectExpr("x as qx", "y as qy", "cx", "cy", "cluster"), ["cx", "cy"]).where(close).groupBy("point_id").agg(F.min("cluster").alias("cluster"))
    out = labelled.select("point_id", "cluster", F.lit(True).alias("core")).union(border.select("point_id", "cluster", F.lit(False)))
    return points.select("point_id").join(out, "point_id", "left").select("point_id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def all_pairs(nodes: DataFrame, key: str) -> DataFrame:
    """(a, b, weight) of all pairs of the stations (key, lon, lat) of one city. The pairs are the result.

    A block holds about 256 stations as one row, fewer where these make less than 64 blocks. Every two blocks meet in a join, whose
    rows are opened into pairs where they are. The join is a merge, since copies of blocks look small to the optimizer, which
    would broadcast them; its tasks are as many as give each some 4 million pairs.
    """
    n = nodes.count()
    k = max(1, min(n, 64), -(-n // 256))
    own = nodes.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(k)).cast("int").alias("own"), F.struct(F.col(key).alias("id"), "lon", "lat").alias("s"))
    blocks = own.repartition(k, "own").groupBy("own").agg(F.collect_list("s").alias("s"))
    tasks = max(1, -(-n * n // 8_000_000))
    a = blocks.select(F.col("own").alias("i"), F.explode(F.sequence("own", F.lit(k - 1))).alias("j"), F.col("s").alias("p")).repartition(tasks, "i", "j")
    b = blocks.select(F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("s").alias("q")).repartition(tasks, "i", "j")
    met = a.join(b.hint("merge"), ["i", "j"]).selectExpr("i", "j", "q", "inline(p) as (x, ax, ay)").selectExpr("i", "j", "x", "ax", "ay", "inline(q) as (y, bx, by)").where("i < j or x < y")
    km = haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))
    # not round(): it goes over decimals, which takes as long as all the rest
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.floor(km * 1e6 + 0.5) / 1e6).alias("weight"))


def near_pairs(nodes: DataFrame, key: str, km: float) -> DataFrame:
    """Those of ``all_pairs`` with a weight up to ``km``."""
    p = J.within_km(nodes.select(key, "lon", "lat"), nodes.select(key, "lon", "lat"), km + 1e-6, key, key).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    return p.select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), F.round("km", 6).alias("weight")).where(F.col("weight") <= km)


def spanning_tree(nodes: DataFrame, key: str, km: float = 8.0) -> DataFrame:
    """(a, b, weight): the least spanning tree of ``all_pairs`` of stations (key, lon, lat), without all pairs.

    The tree's edges up to a weight are the forest of all pairs up to it. So a reach that starts at ``km`` grows fourfold until
    one part is left, and each time only pairs across the parts before are new. One end of such a pair lies outside
    the largest part, so they are searched from there alone.
    """
    points = checkpointed(nodes.select(F.col(key).cast("long").alias("node"), "lon", "lat"))
    ids, n = points.select("node"), points.count()
    tree = spanning_forest(ids, near_pairs(points, "node", km))
    while n - tree.count() > 1 and km < 20_100:
        km *= 4
        at = checkpointed(points.join(components(ids, tree), "node"))
        largest = at.groupBy("component").count().orderBy(F.desc("count"), "component").first()["component"]
        p = J.within_km(at.where(F.col("component") != largest), at, km + 1e-6, "node", "node").where("l_component <> r_component")
        p = p.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"), F.round("km", 6).alias("weight")).where(F.col("weight") <= km)
        tree = spanning_forest(ids, tree.unionByName(p))
    return tree


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def bridges(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least pair (a, b, weight) between each two components."""
    la = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    lb = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    across = pairs.join(la, "a").join(lb, "b").where("ca <> cb")
    return across.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("weight", "a", "b")).alias("e")).select("ca", "cb", "e.a", "e.b", "e.weight")


def repairs(nodes: DataFrame, have: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, weight): of ``pairs`` those that join the parts that the edges ``have`` leave, always the shortest one next. A
    part's distances to others do not change as it grows, so this is a least spanning forest over the parts."""
    label = checkpointed(components(nodes, have))
    between = checkpointed(bridges(label, pairs.select("a", "b", "weight")))
    forest = spanning_forest(label.select(F.col("component").alias("node")).distinct(), between.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "weight"))
    return between.join(forest.select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"], "left_semi").select("a", "b", "weight")


def shortest_paths(requests: DataFrame, nodes: DataFrame, edges: DataFrame, most_nodes: int = 10_000) -> DataFrame:
    """requests (request_id, source, target) -> (request_id, status, km, path) by A* with the great-circle bound.

    nodes (node, lon, lat), edges (a, b, weight): a grid of at most ``most_nodes``, checked, which every
    task receives; requests are spread over tasks.
    """
    if (n := nodes.count()) > most_nodes:
        raise ValueError(f"{n} nodes; a grid for path search has at most {most_nodes}")
    where = {r["node"]: (r["lon"], r["lat"]) for r in nodes.select("node", "lon", "lat").collect()}
    next_to: dict = {}
    for r in edges.select("a", "b", "weight").collect():
        next_to.setdefault(r["a"], []).append((r["b"], r["weight"]))
        next_to.setdefault(r["b"], []).append((r["a"], r["weight"]))
    shared = nodes.sparkSession.sparkContext.broadcast((where, next_to))

    def bound(a: tuple[float, float], b: tuple[float, float]) -> float:
        s, t = np.sin(np.radians(b[1] - a[1]) / 2), np.sin(np.radians(b[0] - a[0]) / 2)
        return float(2 * 6371.0 * np.arcsin(np.sqrt(min(1.0, s * s + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * t * t))))

    def search(source, target):
        where, next_to = shared.value
        if source not in where or target not in where:
            return "missing", None, None
        best, before, heap, done = {source: 0.0}, {}, [(bound(where[source], where[target]), source)], set()
        while heap:
            _, at = heapq.heappop(heap)
            if at == target:
                path = [at]
                while at in before:
                    at = before[at]
                    path.append(at)
                return "success", best[target], path[::-1]
            if at in done:
                continue
            done.add(at)
            for to, w in next_to.get(at, ()):
                d = best[at] + w
                if d < best.get(to, float("inf")):
                    best[to], before[to] = d, at
                    heapq.heappush(heap, (d + bound(where[to], where[target]), to))
        return "no_path", None, None

    def run(frames):
        for f in frames:
            found = [search(s, t) for s, t in zip(f["source"], f["target"], strict=True)]
            yield pd.DataFrame({"request_id": f["request_id"], "status": [x[0] for x in found], "km": [x[1] for x in found], "path": [x[2] for x in found]})

    return requests.select("request_id", "source", "target").mapInPandas(run, "request_id long, status string, km double, path array<long>")


def best_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
