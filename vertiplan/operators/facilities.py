"""Where stations, garages and workshops go: forced and greedy placement, medians, betweenness, branches."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertiplan.functions.geo import haversine_km
from vertiplan.operators import spatial as J
from vertiplan.session import checkpointed

#: Nodes of a trunk network in one task.
MOST_TRUNK = 5000


def _km(lon: str, lat: str, to_lon, to_lat):
    return haversine_km(F.col(lat), F.col(lon), to_lat, to_lon)


def core(demand: DataFrame, quantile: float | None = 0.5) -> DataFrame:
    """One row (lon, lat, least): the weighted middle of demand (lon, lat, weight), and the weight from which on a row
    belongs to its core; without a quantile above 0 all do, one of 1 or more counts as the median."""
    w = F.sum("weight")
    q = 0.5 if quantile is not None and quantile >= 1 else quantile
    least = F.percentile("weight", F.lit(float(q))) if q is not None and q > 0 else F.min("weight")
    return demand.agg((F.sum(F.col("lon") * F.col("weight")) / w).alias("lon"), (F.sum(F.col("lat") * F.col("weight")) / w).alias("lat"), least.alias("least"))


def spacing(kind: str, radius: float, to_core, *, a: float = 0.8, core_a: float | None = 0.4, core_radius: float = 1.0, b: float = 0.5):
    """Least distance (km) of a new station to those before: for A stations another one near the core, ``to_core`` away
    from it; B stations have one of their own."""
    if kind != "charge_a":
        return F.lit(max(0.0, b) * radius)
    inner = a if core_a is None else core_a
    return F.when((F.lit(core_radius) > 0) & (to_core <= core_radius * radius), max(0.0, inner) * radius).otherwise(max(0.0, a) * radius)


def coverage_pairs(candidates: DataFrame, demand: DataFrame, km: float) -> DataFrame:
    """(candidate, demand, weight, km) of what a candidate covers."""
    p = J.within_km(candidates.select("candidate", "lon", "lat"), demand.select("demand", "lon", "lat", "weight"), km, "candidate", "demand")
    return p.select(F.col("l_candidate").alias("candidate"), F.col("r_demand").alias("demand"), F.col("r_weight").alias("weight"), "km")


def charge_by_coverage(candidates: DataFrame, demand: DataFrame, radius: float, ratio_a: float, ratio_b: float, most: int, quantile: float | None = 0.5, core_reach: float = 0.0, **spaced) -> DataFrame:
    """(step, candidate, station_type, gain): A stations by the core demand in their radius, whoever covers it, then B
    stations by what is uncovered, each time the best candidate that keeps its distance (ties to the smaller id) until
    the share ``ratio_*`` is covered, nothing is gained or ``most`` stand. If none stands, the one
    candidate with the most core demand does, the nearest to the middle among equals. ``core_reach``: radii from the
    middle within which A stations lie, 0 for any."""
    spark = candidates.sparkSession
    middle = core(demand, quantile).first()
    if middle["lon"] is None or candidates.isEmpty():
        return spark.createDataFrame([], "step int, candidate long, station_type string, gain double")
    lon, lat, least = F.lit(middle["lon"]), F.lit(middle["lat"]), F.lit(middle["least"])
    places = checkpointed(candidates.select("candidate", "lon", "lat", _km("lon", "lat", lon, lat).alias("to_core")))
    pairs = checkpointed(coverage_pairs(candidates, demand, radius).withColumn("core", F.col("weight") >= least))
    total = demand.agg(F.sum("weight")).first()[0] or 0.0
    chosen: list[tuple] = []
    covered_weight, open_ = 0.0, pairs
    for kind, ratio in (("charge_a", ratio_a), ("charge_b", ratio_b)):
        free = places
        if kind == "charge_a" and core_reach > 0:
            free = free.where(F.col("to_core") <= core_reach * radius)
        for _, c, _, _, clon, clat in chosen:
            free = free.where((F.col("candidate") != c) & (_km("lon", "lat", F.lit(clon), F.lit(clat)) >= spacing(kind, radius, F.col("to_core"), **spaced)))
        free = checkpointed(free)
        while len(chosen) < most:
            scored = pairs.where("core") if kind == "charge_a" else open_
            gain = scored.groupBy("candidate").agg(F.sum("weight").alias("gain")).where("gain > 0")
            best = free.join(gain, "candidate").orderBy(F.desc(F.round("gain", 6)), "candidate").first()
            if best is None:
                break
            chosen.append((len(chosen) + 1, best["candidate"], kind, round(best["gain"], 3), best["lon"], best["lat"]))
            taken = open_.where(F.col("candidate") == best["candidate"])
            taken = checkpointed((taken.where("core") if kind == "charge_a" else taken).select("demand", "weight"))
            covered_weight += taken.agg(F.sum("weight")).first()[0] or 0.0
            open_ = checkpointed(open_.join(taken.select("demand"), "demand", "left_anti"))
            free = checkpointed(free.where((F.col("candidate") != best["candidate"]) & (_km("lon", "lat", F.lit(best["lon"]), F.lit(best["lat"])) >= spacing(kind, radius, F.col("to_core"), **spaced))))
            if total and covered_weight / total >= ratio:
                break
    if not chosen:
        best = reserve(places, pairs).first()
        chosen = [(1, best["candidate"], "charge_a", round(best["gain"], 3), None, None)]
    return spark.createDataFrame([c[:4] for c in chosen], "step int, candidate long, station_type string, gain double")


def reserve(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (candidate, gain): most core demand, then nearest to the middle. places (candidate, to_core), pairs
    (candidate, weight, core)."""
    gain = pairs.where("core").groupBy("candidate").agg(F.sum("weight").alias("gain"))
    return places.join(gain, "candidate", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0))).orderBy(F.desc(F.round("gain", 6)), "to_core", "candidate").select("candidate", "gain").limit(1)


def cover(candidates: DataFrame, demand: DataFrame, radius: float, ratio: float, separation: float, most: int = 100) -> DataFrame:
    """(step, candidate, gain): greedy picks by uncovered weight, at least ``separation`` km apart, until ``ratio`` is covered."""
    pairs = checkpointed(coverage_pairs(candidates, demand, radius))
    total, done, chosen = demand.agg(F.sum("weight")).first()[0] or 0.0, 0.0, []
    free, open_ = checkpointed(candidates.select("candidate", "lon", "lat")), pairs
    while len(chosen) < most and total and done / total < ratio:
        gain = open_.groupBy("candidate").agg(F.sum("weight").alias("gain")).where("gain > 0")
        best = free.join(gain, "candidate").orderBy(F.desc(F.round("gain", 6)), "candidate").first()
        if best is None:
            break
        chosen.append((len(chosen) + 1, best["candidate"], round(best["gain"], 3)))
        done += best["gain"]
        open_ = checkpointed(open_.join(open_.where(F.col("candidate") == best["candidate"]).select("demand"), "demand", "left_anti"))
        free = checkpointed(free.where((F.col("candidate") != best["candidate"]) & (_km("lon", "lat", F.lit(best["lon"]), F.lit(best["lat"])) >= separation)))
    return candidates.sparkSession.createDataFrame(chosen, "step int, candidate long, gain double")


def medians(candidates: DataFrame, demand: DataFrame, k: int, radius: float) -> DataFrame:
    """(step, candidate, served): k greedy medians more than ``radius`` apart. Demand costs its distance to the nearest one,
    twice the radius beyond it; ties to the smaller id. Of several, those stay that serve 5 % of
    all demand or three tenths of what the greatest serves. Without demand the first k candidates."""
    if demand.isEmpty():
        return first_rows(candidates, k).select(F.row_number().over(Window.orderBy("candidate")).alias("step"), "candidate", F.lit(0.0).alias("served"))
    pairs = checkpointed(coverage_pairs(candidates, demand, radius).withColumn("best", F.lit(2 * radius)))
    free, chosen, now = checkpointed(candidates.select("candidate", "lon", "lat")), [], pairs
    while len(chosen) < k:
        saved = now.groupBy("candidate").agg(F.sum(F.col("weight") * (2 * radius - F.least("km", "best"))).alias("saved"))
        best = free.join(saved, "candidate", "left").orderBy(F.desc(F.round(F.coalesce("saved", F.lit(0.0)), 6)), "candidate").first()
        if best is None:
            break
        chosen.append((len(chosen) + 1, best["candidate"]))
        own = pairs.where(F.col("candidate") == best["candidate"]).select("demand", F.col("km").alias("own"))
        now = checkpointed(now.join(own, "demand", "left").withColumn("best", F.least("best", F.coalesce("own", "best"))).drop("own"))
        free = checkpointed(free.where(_km("lon", "lat", F.lit(best["lon"]), F.lit(best["lat"])) > radius))
    steps = candidates.sparkSession.createDataFrame(chosen, "step int, candidate long")
    nearest = pairs.join(F.broadcast(steps), "candidate").groupBy("demand").agg(F.min(F.struct("km", "step", "weight")).alias("n"))  # at most k rows
    served = steps.join(nearest.groupBy(F.col("n.step").alias("step")).agg(F.sum("n.weight").alias("served")), "step", "left").withColumn("served", F.coalesce("served", F.lit(0.0)))
    total = demand.agg(F.sum("weight").alias("total"))
    shares = served.join(F.broadcast(served.agg(F.max("served").alias("greatest"), F.count("*").alias("n")))).join(F.broadcast(total))  # one-row tables
    keep = (F.col("n") == 1) | (F.col("served") >= 0.05 * F.col("total")) | (F.col("served") >= 0.3 * F.col("greatest"))
    return shares.where(keep).select("step", "candidate", F.round("served", 3).alias("served"))


def first_rows(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.orderBy("candidate").limit(k)


def betweenness(nodes: DataFrame, edges: DataFrame, most: int = MOST_TRUNK) -> DataFrame:
    """(node, betweenness): share of shortest paths (by weight) through each node, ends left out, over the number of pairs.
    A trunk of at most ``most`` nodes, checked, is one task's."""
    if (n := nodes.count()) > most:
        raise ValueError(f"{n} nodes; betweenness is for trunks of at most {most}")
    parts = nodes.select("node", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight")).union(edges.select("a", "b", F.col("weight").cast("double")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        next_to: dict = {x: [] for x in f["node"][f["b"].isna()].astype(int)}
        for a, b, w in f[f["b"].notna()].itertuples(index=False, name=None):
            a, b = int(a), int(b)
            next_to[a].append((b, w))
            next_to[b].append((a, w))
        total = dict.fromkeys(next_to, 0.0)
        for s in sorted(next_to):
            dist, paths, before, order, heap = {}, {s: 1.0}, {s: []}, [], [(0.0, s)]
            best = {s: 0.0}
            while heap:
                d, v = heapq.heappop(heap)
                if v in dist:
                    continue
                dist[v] = d
                order.append(v)
                for to, w in next_to[v]:
                    e = d + w
                    if to not in dist and e < best.get(to, float("inf")) - 1e-12:
                        best[to], paths[to], before[to] = e, paths[v], [v]
                        heapq.heappush(heap, (e, to))
                    elif to not in dist and abs(e - best[to]) <= 1e-12:
                        paths[to] += paths[v]
                        before[to].append(v)
            share = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
                if v != s:
                    total[v] += share[v]
        scale = (n - 1) * (n - 2) if n > 2 else 1
        return pd.DataFrame({"node": list(total), "betweenness": [x / scale for x in total.values()]})

    return parts.withColumn("city", F.lit(0)).groupBy("city").applyInPandas(lambda f: run(f[["node", "b", "weight"]]), "node long, betweenness double")


def workshops_by_rank(candidates: DataFrame, nodes: DataFrame, central: DataFrame, k: int, radius: float) -> DataFrame:
    """(rank, candidate): candidates by the betweenness of their nearest trunk node (ties to the smaller id), each more than
    ``radius`` km from those before; k at most. nodes (node, lon, lat), central (node, betweenness)."""
    near = J.nearest(candidates, nodes, "candidate", "node").select("candidate", "node")
    free = checkpointed(candidates.select("candidate", "lon", "lat").join(near, "candidate", "left").join(central, "node", "left").withColumn("score", F.coalesce("betweenness", F.lit(0.0))))
    chosen: list[tuple] = []
    while len(chosen) < k and (best := free.orderBy(F.desc(F.round("score", 9)), "candidate").first()) is not None:
        chosen.append((len(chosen) + 1, best["candidate"]))
        free = checkpointed(free.where(_km("lon", "lat", F.lit(best["lon"]), F.lit(best["lat"])) > radius))
    return candidates.sparkSession.createDataFrame(chosen, "rank int, candidate long")


def facility_branches(facilities: DataFrame, a_stations: DataFrame) -> DataFrame:
    """facilities (facility, kind, lon, lat, ...), a_stations (a, lon, lat) -> every facility with its nearest A station and
    the straight line to it: (facility, kind, a, km, ax, ay, bx, by). There is no greatest length."""
    near = J.nearest(facilities.select("facility", "lon", "lat"), a_stations, "facility", "a").select("facility", "a", "km")
    own = facilities.select("facility", "kind", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    return own.join(near, "facility").join(a_stations.select("a", F.col("lon").alias("bx"), F.col("lat").alias("by")), "a").select("facility", "kind", "a", "km", "ax", "ay", "bx", "by")


def allowed_branches(b_stations: DataFrame, a_stations: DataFrame, each: int = 4) -> DataFrame:
    """(b, a, km): the ``each`` nearest B stations of every A station, and the nearest A of every B."""
    from_a = J.nearest(a_stations, b_stations, "a", "b", each).select("b", "a", "km")
    return from_a.union(J.nearest(b_stations, a_stations, "b", "a").select("b", "a", "km")).groupBy("b", "a").agg(F.min("km").alias("km"))


def station_hulls(stations: DataFrame, members: DataFrame, km: float) -> DataFrame:
    """stations (station, lon, lat, cluster: forced or null), members (cluster, lon, lat) -> (station, cluster): the forced
    one; else of the hulls (discs of ``km`` around members) that hold it the one with the nearest member; else the cluster
    with the nearest middle. Ties to the smaller cluster."""
    near = J.within_km(stations.select("station", "lon", "lat"), members.select("cluster", "lon", "lat"), km, "station", "cluster")
    inside = near.groupBy(F.col("l_station").alias("station")).agg(F.min(F.struct(F.round("km", 6).alias("km"), F.col("r_cluster").alias("cluster"))).alias("held"))
    left = stations.join(inside, "station", "left_anti").where("cluster is null").select("station", "lon", "lat")
    middles = members.groupBy("cluster").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))
    far = J.nearest(left, middles, "station", "cluster").select("station", F.col("cluster").alias("nearest"))
    return stations.select("station", "cluster").join(inside, "station", "left").join(far, "station", "left").select("station", F.coalesce("cluster", "held.cluster", "nearest").alias("cluster"))
