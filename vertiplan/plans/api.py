"""The planner's entry points: each takes a session and a city folder and returns named DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertiplan.functions import geo as G
from vertiplan.operators import graph as N
from vertiplan.operators import placement as O
from vertiplan.plans import composed, network, scalar
from vertiplan.sources import osm
from vertiplan.sources import tables as S


def city_map(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"boundary": osm.boundary(None, None, S.hotspots(spark, sf_dir)), "no_fly_zones": S.zones(spark, sf_dir), "bounds": scalar.city_bounds(spark, sf_dir)}


def buildings_export(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"buildings": scalar.buildings_export(spark, sf_dir), "flight_levels": scalar.flight_levels(spark, sf_dir), "height_stats": scalar.height_stats(spark, sf_dir)}


def demand_clusters(spark: SparkSession, sf_dir: str, method: str = "dbscan", eps_m: float = 180.0, min_samples: int = 15) -> DataFrame:
    """Demand points (region, part, lon, lat, weight, n): density regions, split by weight and radius; or the
    grid's cells. Parameters always count, whatever is cached."""
    if method == "grid":
        return network.demand_grid(spark, sf_dir)
    if method != "dbscan":
        raise ValueError(f"unknown method {method}")
    b = scalar.described(spark, sf_dir).where(F.when(F.col("btag") == "", "yes").otherwise(F.col("btag")).isin(scalar.B.DEMAND_TAGS))
    latitude = b.agg(F.avg("lat")).first()[0] or 55.0
    region = N.dbscan(b.select(F.col("building_id").alias("point_id"), "lon", "lat"), max(600.0, 6 * eps_m), max(6, 2 * min_samples), latitude).where("cluster is not null")
    points = b.join(region.select(F.col("point_id").alias("building_id"), F.col("cluster").alias("region")), "building_id").select("region", "building_id", "lon", "lat", "weight")
    parts = O.split_groups(points, "region", "building_id", latitude)
    return points.join(parts, ["region", "building_id"]).groupBy("region", "part").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.least(F.lit(10_000.0), F.bround(F.sum("weight"))).alias("weight"), F.count("*").alias("n"))


def local_paths(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """Local edges of each flight level 1 to 3 (cluster, a, b, km), without near-parallel ones."""
    sites = network.lex_chunks(spark, sf_dir, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk"))
    edges = O.with_ends(network.parallel_suppression(spark, sf_dir), sites).withColumn("edge_id", F.monotonically_increasing_id())
    blocked = network.J.blocked_segments(edges, S.rings(S.zones(spark, sf_dir), "zone_id"), "edge_id", "zone_id").select("edge_id").distinct()
    clear = edges.join(blocked, "edge_id", "left_anti")
    tall = scalar.described(spark, sf_dir).groupBy("hotspot_id").agg(F.max("height_m").alias("h"))
    km = G.haversine_km(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))
    return {level: clear.join(tall.where(F.col("h") < altitude - scalar.B.CLEARANCE_M).select(F.col("hotspot_id").alias("cluster")), "cluster", "left_semi").select("cluster", "a", "b", km.alias("km")) for level, altitude in enumerate(scalar.B.ALTITUDES_M[:3], 1)}


def placement(spark: SparkSession, sf_dir: str, observer: Callable[[str, int], None] | None = None) -> dict[str, DataFrame]:
    """Layers of a whole plan, each made from the ones before: stations, capacity, garages, trunk, branches, local links and
    metrics. ``observer`` is told each stage's name and the share done in percent."""
    steps = (
        ("clusters", lambda: composed.cluster_regions(spark, sf_dir)),
        ("stations", lambda: composed.charge_stations(spark, sf_dir)),
        ("trunk", lambda: composed.trunk_lines(spark, sf_dir)),
        ("branches", lambda: composed.branches(spark, sf_dir)),
        ("garages", lambda: composed.garages(spark, sf_dir)),
        ("local", lambda: composed.local_lines(spark, sf_dir)),
    )
    for i, (name, make) in enumerate(steps):
        if observer:
            observer(name, 100 * i // len(steps))
        make()
    out = composed.station_layers(spark, sf_dir) | {"capacity": network.charging_capacity(spark, sf_dir), "garages": composed.garages(spark, sf_dir), "metrics": composed.placement_totals(spark, sf_dir)}
    if observer:
        observer("done", 100)
    return out


def save(layers: dict[str, DataFrame], catalog: osm.CityCatalog) -> None:
    for name, df in layers.items():
        catalog.save(name, df)


def load_saved(catalog: osm.CityCatalog, names: tuple[str, ...]) -> dict[str, DataFrame | None]:
    return {name: catalog.load(name) for name in names}
