"""Regions, hull membership, claims and matchings: sequential rules of the model as parallel rounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertiplan.operators import spatial as J
from vertiplan.session import checkpointed


def claim(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (cluster, candidate, km) -> those that remain when every cluster in order of its id takes its n
    nearest candidates that none before it took (ties to the smaller candidate).

    Clusters take their turns in one task, which reads the pairs in this order and holds only what is taken: the pairs
    are moved once and never written again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(frames):
        taken: set = set()
        now, left = None, 0
        for f in frames:
            kept = []
            for i, (cluster, candidate) in enumerate(zip(f["cluster"].tolist(), f["candidate"].tolist())):
                if cluster != now:
                    now, left = cluster, n
                if left and candidate not in taken:
                    taken.add(candidate)
                    left -= 1
                    kept.append(i)
            yield f.iloc[kept]

    return pairs.select("cluster", "candidate", "km").repartition(1).sortWithinPartitions("cluster", "km", "candidate").mapInPandas(run, f"cluster {kinds['cluster']}, candidate {kinds['candidate']}, km {kinds['km']}")


def matching(edges: DataFrame, most: int, one_task: int = 2_000_000) -> DataFrame:
    """edges (a, b, weight) -> those that a pass in order of (weight, a, b) adds while both ends have fewer than
    ``most``. Up to ``one_task`` edges are passed in one task. Of more, parallel rounds come to the same: an edge that comes before
    all others of both its ends is added in any case, so each round adds all of these at once."""
    left, chosen = checkpointed(edges.select("a", "b", "weight")), None

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["weight", "a", "b"]).drop_duplicates(["a", "b"])
        have: dict[int, int] = {}
        kept = []
        for i, (a, b) in enumerate(zip(f["a"].tolist(), f["b"].tolist())):
            if have.get(a, 0) < most and have.get(b, 0) < most:
                have[a], have[b] = have.get(a, 0) + 1, have.get(b, 0) + 1
                kept.append(i)
        return f.iloc[kept][["a", "b", "weight"]]

    while (n := left.count()) > (one_task if chosen is None else 0):
        ends = left.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("node"))
        first = ends.groupBy("node").agg(F.min(F.struct("weight", "a", "b")).alias("e"))
        both = checkpointed(first.groupBy("e").count().where("count = 2").select("e.a", "e.b", "e.weight"))
        chosen = both if chosen is None else checkpointed(chosen.union(both))
        full = chosen.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().where(F.col("count") >= most).select("node")
        rest = left.join(both.select("a", "b"), ["a", "b"], "left_anti")
        rest = rest.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
        left = checkpointed(rest.select("a", "b", "weight"))
    if chosen is None:
        return checkpointed(left.withColumn("city", F.lit(0)).groupBy("city").applyInPandas(run, left.schema)) if n else left
    return chosen


def principal_regions(points: DataFrame, key: str) -> DataFrame:
    """(key, region): points in equal shares along the first principal axis of their places; their number is
    the root of the number of points, 2 to 8."""
    m = points.agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"), F.var_pop("lon").alias("cxx"), F.var_pop("lat").alias("cyy"), F.covar_pop("lon", "lat").alias("cxy"), F.count("*").alias("n"))
    m = m.withColumn("angle", 0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))).withColumn("k", F.greatest(F.lit(2), F.least(F.lit(8), F.bround(F.sqrt("n")).cast("int"))))
    along = points.join(F.broadcast(m.select("mx", "my", "angle", "k"))).withColumn("t", (F.col("lon") - F.col("mx")) * F.cos("angle") + (F.col("lat") - F.col("my")) * F.sin("angle"))
    q = along.agg(F.percentile("t", F.array(*[F.lit(i / 840) for i in range(841)])).alias("q"))
    # 840 is divisible by every possible number of regions
    return along.join(F.broadcast(q)).select(key, F.expr("size(filter(sequence(1, k - 1), i -> q[cast(840 / k as int) * i] <= t))").alias("region"))


def packed(cluster: np.ndarray, lon: np.ndarray, lat: np.ndarray, size: int) -> np.ndarray:
    """Region numbers of places in their order of precedence: the first without one takes the ``size - 1`` nearest without
    one (ties to the smaller cluster), and so on. Free places lie in cubes in space, dealt anew when half of them are
    taken, and cubes are searched around a place until nothing nearer can lie outside."""
    lon, lat = np.radians(lon), np.radians(lat)
    place = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    region, free, left, regions = np.full(len(cluster), -1), np.empty(0, int), len(cluster), 0
    cubes: dict[tuple[int, int, int], np.ndarray] = {}
    side = 1.0
    for i in range(len(cluster)):
        if region[i] >= 0:
            continue
        if 2 * left <= len(free) or not len(free):
            free = np.flatnonzero(region < 0)
            side = max(1e-9, float(np.ptp(place[free], axis=0).max()) / max(1.0, math.sqrt(len(free) / 4)))
            at = np.floor(place[free] / side).astype(int)
            order = np.lexsort(at.T)
            cuts = np.flatnonzero(np.any(np.diff(at[order], axis=0) != 0, axis=1)) + 1
            cubes = {tuple(at[part[0]].tolist()): free[part] for part in np.split(order, cuts)}
        x, y, z = np.floor(place[i] / side).astype(int).tolist()
        reach, near = 1, None
        while near is None:
            steps = range(-reach, reach + 1)
            if len(steps) ** 3 > len(cubes):
                found, least = free, math.inf
            else:
                parts = [c for dx in steps for dy in steps for dz in steps if (c := cubes.get((x + dx, y + dy, z + dz))) is not None]
                found, least = np.concatenate(parts), (reach * side) ** 2 / 4 * (1 - 1e-9) - 2e-15
            found = found[region[found] < 0]
            a = np.sin((lat[found] - lat[i]) / 2) ** 2 + np.cos(lat[found]) * np.cos(lat[i]) * np.sin((lon[found] - lon[i]) / 2) ** 2
            if least == math.inf or np.count_nonzero(a < least) >= size:
                near = found[np.lexsort((cluster[found], np.round(a, 15)))[:size]]
            reach += 1
        region[near] = regions
        regions += 1
        left -= len(near)
    return region


def repack(clusters: DataFrame, size: int = 5) -> DataFrame:
    """clusters (cluster, weight, lon, lat) -> (cluster, region): the heaviest cluster without a region takes the
    ``size - 1`` nearest without one, and so on. A sequence over the clusters of one city, in one task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["weight", "cluster"], ascending=[False, True])
        region = packed(f["cluster"].to_numpy(), f["lon"].to_numpy(), f["lat"].to_numpy(), size)
        return pd.DataFrame({"cluster": f["cluster"], "region": [f"nearest_{r}" for r in region]})

    return clusters.select("cluster", "weight", "lon", "lat").withColumn("city", F.lit(0)).groupBy("city").applyInPandas(run, "cluster long, region string")


def in_hulls(points: DataFrame, members: DataFrame, point_id: str, cluster: str, km: float) -> DataFrame:
    """(point_id, cluster): clusters with a member within ``km``: a hull is the union of discs around its members."""
    p = J.within_km(points.select(point_id, "lon", "lat"), members.select(cluster, "lon", "lat"), km, point_id, cluster)
    return p.select(F.col(f"l_{point_id}").alias(point_id), F.col(f"r_{cluster}").alias(cluster)).distinct()


def hull_owner(inside: DataFrame, weights: DataFrame, point_id: str, cluster: str) -> DataFrame:
    """(point_id, cluster): of the hulls over a point the heaviest cluster's, ties to the smaller id."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col(cluster).alias("c")))
    return inside.join(weights.select(cluster, "weight"), cluster).groupBy(point_id).agg(best.alias("b")).select(point_id, F.col("b.c").alias(cluster))


def site_sizes(area: Column, apartments: Column, others: Column, asked: Column, large_city: Column) -> tuple[Column, Column]:
    """Buildings a site of apartment houses and of others, by hull area (m2), counts, the size asked for and
    whether the city has a hull over 3 km2."""
    wide, mixed = area > 3_000_000, (apartments > 0) & (others > 0)
    asked = F.greatest(F.lit(1), F.coalesce(F.nullif(asked, F.lit(0)), F.lit(60)))
    dense = F.when(wide | large_city, 5).otherwise(2)
    return F.when(apartments > 0, dense), F.when(others > 0, F.when(wide | mixed, asked).otherwise(3))


def interior_points(edges: DataFrame, key: str) -> DataFrame:
    """(key, part_id, lon, lat) inside each part: the middle of the widest stretch at its mid-height."""
    box = J.boxes(edges, key).select(key, "part_id", ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    cross = edges.join(box, [key, "part_id"]).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))).withColumn("x", at)
    w = Window.partitionBy(key, "part_id").orderBy("x")
    spans = cross.withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("x").over(w)).where("i % 2 = 1 and next is not null")
    best = F.max(F.struct((F.col("next") - F.col("x")).alias("width"), (-F.col("x")).alias("left"), ((F.col("x") + F.col("next")) / 2).alias("lon"), "y"))
    return spans.groupBy(key, "part_id").agg(best.alias("b")).select(key, "part_id", F.col("b.lon").alias("lon"), F.col("b.y").alias("lat"))


def clipped(segments: DataFrame, rects: DataFrame, segment_id: str, key: str, cell: float = 0.05) -> DataFrame:
    """(segment_id, key, t0, t1): the part of each segment inside each box, by its parameters."""
    s = segments.select(segment_id, "ax", "ay", "bx", "by")
    own = J._box_cells(s.withColumn("xmin", F.least("ax", "bx")).withColumn("xmax", F.greatest("ax", "bx")).withColumn("ymin", F.least("ay", "by")).withColumn("ymax", F.greatest("ay", "by")), cell).select(segment_id, "_cx", "_cy")
    near = own.join(J._box_cells(rects.select(key, "xmin", "xmax", "ymin", "ymax"), cell), ["_cx", "_cy"]).drop("_cx", "_cy").distinct().join(s, segment_id)
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, m, n in (("ax", "bx", "xmin", "xmax"), ("ay", "by", "ymin", "ymax")):
        d, a, m, n = F.col(b) - F.col(a), F.col(a), F.col(m), F.col(n)
        between = (a > m) & (a < n)
        lo.append(F.when(d != 0, F.least((m - a) / d, (n - a) / d)).when(between, 0.0).otherwise(2.0))
        hi.append(F.when(d != 0, F.greatest((m - a) / d, (n - a) / d)).when(between, 1.0).otherwise(-2.0))
    return near.select(segment_id, key, F.greatest(*lo).alias("t0"), F.least(*hi).alias("t1")).where("t1 - t0 > 1e-9")


def without_loops(path: list[tuple[float, float]], passes: int = 16) -> list[tuple[float, float]]:
    """A polyline whose first crossing of non-adjacent segments is cut out, again and again."""
    path = [p for i, p in enumerate(path) if not i or p != path[i - 1]]
    for _ in range(passes):
        for i in range(len(path) - 3):
            (x1, y1), (x2, y2) = path[i], path[i + 1]
            hit = None
            for j in range(i + 2, len(path) - 1):
                (x3, y3), (x4, y4) = path[j], path[j + 1]
                d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
                if abs(d) < 1e-15:
                    continue
                t, u = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / d, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    hit = (j, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
                    break
            if hit:
                path = path[: i + 1] + [hit[1]] + path[hit[0] + 1 :]
                break
        else:
            return path
    return path


def route_score(length: Column, chord: Column, bulge: Column) -> Column:
    """Lower is better: length over chord, the excess in km, and how far the route swings out."""
    return length / chord + 0.08 * F.greatest(F.lit(0.0), length - chord) + 0.52 * F.greatest(F.lit(0.0), bulge - 0.12)
