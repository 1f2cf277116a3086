"""Queries over space and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vertiplan.functions import buildings as B
from vertiplan.functions import geo as G
from vertiplan.operators import graph as N
from vertiplan.operators import placement as O
from vertiplan.operators import routing as Z
from vertiplan.operators import spatial as J
from vertiplan.plans.scalar import ATTRIBUTES, _list, described, sql
from vertiplan.sources import tables as S
from vertiplan.sources import osm

CHARGE_KM, FACILITY_KM, SEPARATION_KM = 1.6, 3.2, 0.4

_KM = "2 * 6371.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def km(a: str, b: str) -> str:
    return _KM.format(a=a, b=b)


def demand_grid(spark, d, cell: float = 250.0):
    x, y = G.utm(F.col("lon"), F.col("lat"), 37)
    b = described(spark, d).where(F.when(F.col("btag") == "", "yes").otherwise(F.col("btag")).isin(B.DEMAND_TAGS))
    g = b.select("building_id", "weight", F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy")).groupBy("cx", "cy").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("building_id").alias("first"))
    g = g.where("n >= 2 and weight > 0")
    return g.select((F.col("cx") * cell + cell / 2).alias("x"), (F.col("cy") * cell + cell / 2).alias("y"), F.round("weight", 3).alias("weight"), "n", "first")


def demand_cells(spark, d):
    """The same aggregation on a lattice of degrees."""
    b = described(spark, d)
    g = b.groupBy(F.floor(F.col("lon") / 0.005).alias("cx"), F.floor(F.col("lat") / 0.0025).alias("cy")).agg(F.round(F.sum("weight"), 3).alias("weight"), F.count("*").alias("n"), F.min("building_id").alias("first")).where("n >= 2")
    return g.withColumn("cluster_id", F.sum(F.lit(1)).over(Window.partitionBy("cx").orderBy("first")))


def building_in_district(spark, d):
    dist = osm.admin_districts(S.districts(spark, d))
    found = J.points_in_polygons(S.buildings(spark, d), S.rings(dist, "district_id"), "building_id", "district_id", 0.05)
    first = found.groupBy("building_id").agg(F.min("district_id").alias("district_id"))
    return S.buildings(spark, d).select("building_id").join(first, "building_id", "left").select("building_id", F.coalesce(F.col("district_id").cast("string"), F.concat(F.lit("unassigned_"), F.col("building_id"))).alias("region"))


def building_not_in_zone(spark, d):
    b = S.buildings(spark, d)
    inside = J.points_in_polygons(b, S.rings(S.zones(spark, d), "zone_id"), "building_id", "zone_id")
    return b.join(inside, "building_id", "left_anti").select("building_id")


def building_in_zone(spark, d):
    return J.points_in_polygons(S.buildings(spark, d), S.rings(S.zones(spark, d), "zone_id"), "building_id", "zone_id")


def _footprints(b):
    half = "sqrt(area_m2) / 2 / 111320.0e0"
    return b.selectExpr("building_id as other_id", "height_m", f"lon - {half} as xmin", f"lon + {half} as xmax", f"lat - {half} as ymin", f"lat + {half} as ymax")


def max_height_at_point(spark, d):
    b = described(spark, d)
    f = _footprints(b)
    hit = J.points_in_polygons(b, S.rings(f, "other_id"), "building_id", "other_id", 0.002).join(f.select("other_id", "height_m"), "other_id")
    most = hit.groupBy("building_id").agg(F.max("height_m").alias("h"))
    return b.select("building_id").join(most, "building_id", "left").select("building_id", F.round(F.coalesce("h", F.lit(0.0)), 3).alias("height_m"))


def exactly_one_hull(spark, d):
    near = J.within_km(S.buildings(spark, d).select("building_id", "lon", "lat"), S.hotspots(spark, d), CHARGE_KM, "building_id", "hotspot_id")
    one = near.groupBy(F.col("l_building_id").alias("building_id")).agg(F.count_distinct("r_hotspot_id").alias("n"), F.min("r_hotspot_id").alias("hotspot_id"))
    return S.buildings(spark, d).select("building_id").join(one, "building_id", "left").select("building_id", F.when(F.col("n") == 1, F.col("hotspot_id")).alias("hotspot_id"))


def nearest_hotspot(spark, d):
    n = J.nearest(S.buildings(spark, d), S.hotspots(spark, d), "building_id", "hotspot_id")
    return n.select("building_id", "hotspot_id", F.round("km", 6).alias("km"))


def knn_edges(spark, d):
    h = S.hotspots(spark, d)
    n = J.nearest(h, h.withColumnRenamed("hotspot_id", "other_id"), "hotspot_id", "other_id", 2, FACILITY_KM, same=True)
    return n.select(F.least("hotspot_id", "other_id").alias("a"), F.greatest("hotspot_id", "other_id").alias("b"), F.round("km", 6).alias("km")).distinct()


def nearest_margin(spark, d):
    n = J.nearest(S.buildings(spark, d), S.hotspots(spark, d), "building_id", "hotspot_id", 2, 6.0)
    w = n.withColumn("next", F.lead("km").over(Window.partitionBy("building_id").orderBy("rank")))
    return w.where("rank = 1 and next is not null").select("building_id", "hotspot_id", F.round(F.col("next") - F.col("km"), 6).alias("margin"))


def coverage_pairs(spark, d):
    b = described(spark, d).select("building_id", "lon", "lat", "weight")
    p = J.within_km(S.hotspots(spark, d), b, CHARGE_KM, "hotspot_id", "building_id")
    return p.groupBy(F.col("l_hotspot_id").alias("hotspot_id")).agg(F.round(F.sum("r_weight"), 3).alias("weight"), F.count("*").alias("n"))


def hull_gap_pairs(spark, d):
    g = J.box_gaps(S.zones(spark, d), "zone_id", 0.12, 0.12)
    return g.select("a", "b", F.round("gap", 9).alias("gap"))


def complete_graph(spark, d):
    """Every pair of stations is the result."""
    return N.all_pairs(S.hotspots(spark, d), "hotspot_id").withColumnRenamed("weight", "km")


def _stations(spark, d):
    return S.hotspots(spark, d).withColumn("station_type", F.when(F.col("hotspot_id") % 5 == 0, "charge_a").otherwise("charge_b")).where("hotspot_id % 7 <> 3")


def semi_covered_demand(spark, d):
    w = described(spark, d).join(_stations(spark, d).select("hotspot_id"), "hotspot_id", "left_semi")
    return w.groupBy("hotspot_id").agg(F.round(F.sum("weight"), 3).alias("weight"))


def unserved_demand(spark, d):
    w = described(spark, d).join(_stations(spark, d).select("hotspot_id"), "hotspot_id", "left_anti")
    return w.groupBy("hotspot_id").agg(F.round(F.sum("weight"), 3).alias("weight"), F.count("*").alias("n"))


def coverage_ratio(spark, d):
    s = _stations(spark, d).select("hotspot_id", F.lit(1).alias("served"))
    w = described(spark, d).join(s, "hotspot_id", "left")
    return w.agg(F.round(F.sum(F.when(F.col("served") == 1, F.col("weight")).otherwise(0.0)) / F.sum("weight"), 9).alias("ratio"), F.count_distinct("hotspot_id").alias("clusters"), F.count_distinct(F.when(F.col("served") == 1, F.col("hotspot_id"))).alias("served"))


def best_per_cluster(spark, d):
    return N.best_per_key(described(spark, d), "hotspot_id", F.desc("weight"), "building_id").select("hotspot_id", "building_id", F.round("weight", 4).alias("weight"))


def _clusters(spark, d):
    w = F.sum("weight")
    return described(spark, d).groupBy("hotspot_id").agg(w.alias("weight"), F.count("*").alias("n"), (F.sum(F.col("lon") * F.col("weight")) / w).alias("lon"), (F.sum(F.col("lat") * F.col("weight")) / w).alias("lat"))


def cluster_weight(spark, d):
    return _clusters(spark, d).select("hotspot_id", F.round("weight", 3).alias("weight"), "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def subcluster_rows(spark, d):
    """A weight near a half is rounded as its doubles add up in order of buildings; their exact sum can be a half where theirs
    is not. One task adds up a cluster."""
    b = described(spark, d).select("hotspot_id", "weight", "lon", "lat", G.running_sum(F.col("weight"), "hotspot_id", "building_id").alias("sum"), F.row_number().over(Window.partitionBy("hotspot_id").orderBy("building_id")).alias("at"))
    return b.groupBy("hotspot_id").agg(F.least(F.lit(10000.0), F.bround(F.max_by("sum", "at"))).alias("weight"), F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


def charging_capacity(spark, d):
    c = _clusters(spark, d).withColumn("raw", F.col("weight") * 0.02).withColumn("total", F.bround(F.round("raw", 6)).cast("long"))
    cargo, monitoring, service = B.split_by_type(F.col("total"))
    return c.select("hotspot_id", F.round("raw", 4).alias("raw"), "total", cargo.alias("cargo"), monitoring.alias("monitoring"), service.alias("service"))


def garage_link_capacity(spark, d):
    """Drones of an A station and of the B stations linked to it, three in ten of them."""
    cap = charging_capacity(spark, d).select("hotspot_id", "total")
    s = _stations(spark, d).join(cap, "hotspot_id")
    link = J.nearest(s.where("station_type = 'charge_b'").select("hotspot_id", "lon", "lat"), s.where("station_type = 'charge_a'").select(F.col("hotspot_id").alias("a_id"), "lon", "lat"), "hotspot_id", "a_id")
    b = link.join(cap, "hotspot_id").groupBy("a_id").agg(F.sum("total").alias("linked"))
    a = s.where("station_type = 'charge_a'").select(F.col("hotspot_id").alias("a_id"), "total").join(b, "a_id", "left")
    return a.select("a_id", (F.col("total") + F.coalesce("linked", F.lit(0))).alias("drones"), F.bround((F.col("total") + F.coalesce("linked", F.lit(0))) * 0.3, 0).cast("long").alias("capacity"))


def main_cluster(spark, d):
    c = _clusters(spark, d).withColumn("region", F.floor(F.col("hotspot_id") % 32 / 8) + 4 * F.floor(F.col("hotspot_id") / 128))
    w = F.sum("weight")
    m = c.groupBy("region").agg((F.sum(F.col("lon") * F.col("weight")) / w).alias("mx"), (F.sum(F.col("lat") * F.col("weight")) / w).alias("my"))
    j = c.join(m, "region").withColumn("km", G.haversine_km(F.col("my"), F.col("mx"), F.col("lat"), F.col("lon")))
    return N.best_per_key(j, "region", "km", F.desc("weight"), "hotspot_id").select("region", "hotspot_id", F.round("km", 5).alias("km"))


def quantile_regions(spark, d, k: int = 4):
    c = _clusters(spark, d)
    edges = c.agg(F.percentile("lon", F.array(*[F.lit(i / k) for i in range(1, k)])).alias("q"))
    return c.join(F.broadcast(edges)).select("hotspot_id", F.expr("size(filter(q, e -> e <= lon))").alias("region"))


def lex_chunks(spark, d, size: int = 5):
    r = F.row_number().over(Window.partitionBy("hotspot_id").orderBy("lon", "lat", "building_id")) - 1
    return S.buildings(spark, d).withColumn("chunk", F.floor(r / size)).groupBy("hotspot_id", "chunk").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count("*").alias("n"))


def site_merge(spark, d):
    b = S.buildings(spark, d).select(F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), (F.col("building_id") % 9 == 0).alias("is_station"), "building_id")
    return b.groupBy("lon", "lat").agg(F.bool_or("is_station").alias("is_station"), F.min("building_id").alias("first"), F.count("*").alias("n"))


def rooftop_candidates(spark, d):
    return S.buildings(spark, d).where(B.tag("building").isin("apartments", "dormitory")).select("building_id")


def ground_candidates(spark, d):
    t = B.tag("building")
    return S.buildings(spark, d).where(~t.isin("apartments", "dormitory") & (t.isin(B.GROUND_TAGS) | (t == "office") | (F.col("area_m2") > 400))).select("building_id")


def garage_candidates(spark, d):
    return O.workshop_candidates(S.buildings(spark, d), S.landuses(spark, d))


def _local_edges(spark, d):
    """Links of each hotspot to its next in the row and in the column, as segments."""
    h = S.hotspots(spark, d)
    n = h.select(F.col("hotspot_id").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    a = h.select(F.col("hotspot_id").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.explode(F.array(F.lit(1), F.lit(32), F.lit(33))).alias("step"))
    return a.withColumn("b", F.col("a") + F.col("step")).join(n, "b").selectExpr("a * 100 + step as edge_id", "a", "b", "ax", "ay", "bx", "by")


def segment_blocked(spark, d):
    return J.blocked_segments(_local_edges(spark, d), S.rings(S.zones(spark, d), "zone_id"), "edge_id", "zone_id")


def clear_edges(spark, d):
    e = _local_edges(spark, d)
    return e.join(segment_blocked(spark, d).select("edge_id").distinct(), "edge_id", "left_anti").select("edge_id", "a", "b")


def edge_clearance(spark, d):
    e = _local_edges(spark, d)
    return J.cluttered_segments(e, S.rings(S.zones(spark, d), "zone_id"), "edge_id", "zone_id")


def roof_filter(spark, d):
    """Edges whose both ends stand on roofs under 90 metres: the heaviest building of each hotspot is its roof."""
    roof = N.best_per_key(described(spark, d), "hotspot_id", F.desc("weight"), "building_id").select("hotspot_id", "height_m")
    e = _local_edges(spark, d).select("edge_id", "a", "b")
    low = roof.where("height_m < 90").select("hotspot_id")
    return e.join(low.withColumnRenamed("hotspot_id", "a"), "a", "left_semi").join(low.withColumnRenamed("hotspot_id", "b"), "b", "left_semi").select("edge_id")


def echelon_edges(spark, d):
    """Edges by flight level: those whose roofs leave the level's clearance stay."""
    levels = spark.createDataFrame([(1, 35.0), (2, 62.5), (3, 90.0)], "level int, least double")
    roof = described(spark, d).groupBy("hotspot_id").agg(F.max_by("height_m", F.struct("weight", -F.col("building_id"))).alias("h"))
    e = clear_edges(spark, d).join(F.broadcast(levels))
    e = e.join(roof.select(F.col("hotspot_id").alias("a"), F.col("h").alias("ha")), "a").join(roof.select(F.col("hotspot_id").alias("b"), F.col("h").alias("hb")), "b")
    return e.where("ha < least and hb < least").groupBy("level").agg(F.count("*").alias("edges"), F.sum("edge_id").alias("checksum"))


def air_grid_nodes(spark, d):
    return O.air_grid(S.zones(spark, d), *O.grid_box(S.hotspots(spark, d)), step=0.01)[0].select("node", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def air_grid_edges(spark, d):
    return O.air_grid(S.zones(spark, d), *O.grid_box(S.hotspots(spark, d)), step=0.01)[1].select("a", "b", F.round("weight", 6).alias("weight"))


def _near_edges(spark, d, km: float):
    h = S.hotspots(spark, d)
    p = J.within_km(h, h, km, "hotspot_id", "hotspot_id").where("l_hotspot_id < r_hotspot_id")
    return p.select(F.col("l_hotspot_id").alias("a"), F.col("r_hotspot_id").alias("b"), F.col("km").alias("weight"))


def network_components(spark, d):
    e = _near_edges(spark, d, 3.4).where("(a + b) % 3 <> 0")
    return N.components(S.hotspots(spark, d).select(F.col("hotspot_id").alias("node")), e)


def component_bridges(spark, d):
    label = network_components(spark, d)
    return N.bridges(label, _near_edges(spark, d, 6.0)).select("ca", "cb", "a", "b", F.round("weight", 6).alias("km"))


def node_degree(spark, d):
    return N.degrees(knn_edges(spark, d))


def mst(spark, d):
    h = S.hotspots(spark, d)
    e = _near_edges(spark, d, 6.0).withColumn("weight", F.round("weight", 6))
    return N.spanning_forest(h.select(F.col("hotspot_id").alias("node")), e)


def dbscan_regions(spark, d):
    p = S.buildings(spark, d).select(F.col("building_id").alias("point_id"), "lon", "lat")
    return N.dbscan(p, 1080.0, 30, 55.4)


def neighbour_counts(spark, d):
    b = S.buildings(spark, d).select("building_id", "lon", "lat")
    p = J.within_km(b, b, 0.4, "building_id", "building_id")
    return p.groupBy(F.col("l_building_id").alias("building_id")).agg(F.count("*").alias("n"))


def astar_paths(spark, d):
    nodes, edges = O.air_grid(S.zones(spark, d), *O.grid_box(S.hotspots(spark, d)), step=0.02)
    ids = nodes.agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    req = ids.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("request_id"), "lo", "hi").selectExpr("cast(request_id as long) as request_id", "lo as source", "cast(lo + (hi - lo) * (request_id + 1) div 8 as long) as target")
    return N.shortest_paths(req, nodes, edges)


def greedy_coverage(spark, d):
    b = described(spark, d).select("building_id", "lon", "lat", "weight")
    pairs = J.within_km(S.hotspots(spark, d), b, CHARGE_KM, "hotspot_id", "building_id").select(F.col("l_hotspot_id").alias("candidate"), F.col("r_building_id").alias("demand"), F.col("r_weight").alias("weight"))
    return O.greedy_cover(pairs, b.agg(F.sum("weight")).first()[0], 0.6, 12)


def place_facilities(spark, d):
    b = described(spark, d).select("building_id", "lon", "lat", "weight")
    return O.place_n(S.hotspots(spark, d).withColumnRenamed("hotspot_id", "candidate"), b.withColumnRenamed("building_id", "demand"), 6, FACILITY_KM, SEPARATION_KM)


def forced_placement(spark, d):
    """One A station in the main cluster of each region, one B in every other cluster."""
    c = _clusters(spark, d).select("hotspot_id", "weight", "lon", "lat")
    a = main_cluster(spark, d).select("hotspot_id", F.lit("charge_a").alias("kind"))
    best = N.best_per_key(described(spark, d).where(F.col("btag").isin("apartments", "dormitory")).join(c.select("hotspot_id", F.col("lon").alias("cx"), F.col("lat").alias("cy")), "hotspot_id").withColumn("km", G.haversine_km(F.col("cy"), F.col("cx"), F.col("lat"), F.col("lon"))), "hotspot_id", F.round("km", 6), "building_id")
    return c.select("hotspot_id").join(a, "hotspot_id", "left").join(best.select("hotspot_id", "building_id"), "hotspot_id", "left").select("hotspot_id", F.coalesce("kind", F.lit("charge_b")).alias("station_type"), F.coalesce("building_id", F.lit(-1).cast("long")).alias("building_id"))


def assignment(spark, d):
    s = _stations(spark, d)
    return O.assign(s.where("station_type = 'charge_b'").select(F.col("hotspot_id").alias("b"), "lon", "lat"), s.where("station_type = 'charge_a'").select(F.col("hotspot_id").alias("a"), "lon", "lat"), 4)


def kmeans_split(spark, d):
    b = described(spark, d).select("hotspot_id", "building_id", "lon", "lat", "weight")
    return O.split_groups(b, "hotspot_id", "building_id", 55.4)


def voronoi_edges(spark, d):
    sites = lex_chunks(spark, d, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk"))
    return O.delaunay_edges(sites.select(F.col("hotspot_id").alias("cluster"), "site", "lon", "lat"))


def parallel_suppression(spark, d):
    return O.suppress_parallel(O.with_ends(voronoi_edges(spark, d), lex_chunks(spark, d, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk"))))


def detour_routes(spark, d):
    return Z.routed(_local_edges(spark, d), Z.boxes_as_rings(S.zones(spark, d), "zone_id"), "edge_id").select("edge_id", "status", F.round("km", 6).alias("km"), F.size("path").alias("points"))


def zone_kinds(spark, d):
    return osm.zone_kinds(osm.features(spark, d)).groupBy("zone_kind").agg(F.count("*").alias("n"))


def admin_districts(spark, d):
    return osm.admin_districts(S.districts(spark, d)).select("district_id", "admin_level")


def landuse_parts(spark, d):
    return S.landuses(spark, d).where(F.col("landuse").isin("industrial", "garages", "brownfield")).groupBy("landuse").agg(F.count("*").alias("n"), F.round(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), 9).alias("area"))


def placement_key(spark, d):
    return osm.placement_key(spark.createDataFrame([("city", "drive", True, 1.6, 4)], "city string, network string, simplify boolean, radius double, per_a int"))


def chaikin_paths(spark, d):
    p = S.hotspots(spark, d).withColumn("path", F.expr("array(struct(lon as x, lat as y), struct(lon + 0.01e0 as x, lat as y), struct(lon + 0.01e0 as x, lat + 0.02e0 as y))"))
    return p.select("hotspot_id", F.posexplode(G.chaikin(F.col("path"))).alias("i", "p")).select("hotspot_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def path_lengths(spark, d):
    """Densified paths and their running length by haversine."""
    p = S.hotspots(spark, d).withColumn("path", F.expr("array(struct(lon as x, lat as y), struct(lon + 0.01e0 as x, lat as y), struct(lon + 0.01e0 as x, lat + 0.02e0 as y))"))
    e = p.select("hotspot_id", F.posexplode(G.densify(F.col("path"), 0.0041)).alias("i", "p"))
    w = Window.partitionBy("hotspot_id").orderBy("i")
    step = G.haversine_km(F.lag("p.y").over(w), F.lag("p.x").over(w), F.col("p.y"), F.col("p.x"))
    run = e.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("km", F.sum("step").over(w))
    return run.groupBy("hotspot_id").agg(F.count("*").alias("points"), F.round(F.max("km"), 6).alias("km"))


def cross_track(spark, d):
    b = S.buildings(spark, d)
    h = S.hotspots(spark, d).select("hotspot_id", F.col("lon").alias("hx"), F.col("lat").alias("hy"))
    off = G.points_offset_m(F.col("lon"), F.col("lat"), F.col("hx"), F.col("hy"), F.col("hx") + 0.01, F.col("hy") + 0.005)
    return b.join(h, "hotspot_id").groupBy("hotspot_id").agg(F.round(F.max(off), 9).alias("offset"))


def geojson_points(spark, d):
    return osm.geojson(S.hotspots(spark, d), "hotspot_id")


def union_stations(spark, d):
    s = _stations(spark, d).select("hotspot_id", "station_type")
    g = place_facilities(spark, d).select(F.col("candidate").alias("hotspot_id"), F.lit("garage").alias("station_type"))
    return s.unionByName(g).groupBy("station_type").agg(F.count("*").alias("n"))


def convex_hull(spark, d):
    h = osm.convex_hull(S.hotspots(spark, d))
    return h.select("seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def placement_metrics(spark, d):
    """One row: stations by type, garages, share of demand in served clusters, network edges and whether it is connected."""
    placed = forced_placement(spark, d)
    counts = placed.agg(F.count_if(F.col("station_type") == "charge_a").alias("charge_a"), F.count_if(F.col("station_type") == "charge_b").alias("charge_b"), F.count_if(F.col("building_id") < 0).alias("interior"))
    ratio = coverage_ratio(spark, d).select("ratio")
    edges = mst(spark, d).agg(F.count("*").alias("trunk_edges"), F.round(F.sum("weight"), 4).alias("trunk_km"))
    garages = place_facilities(spark, d).agg(F.count("*").alias("garages"))
    local = clear_edges(spark, d).agg(F.count("*").alias("local_edges"))
    # one-row tables
    return counts.join(F.broadcast(ratio)).join(F.broadcast(edges)).join(F.broadcast(garages)).join(F.broadcast(local))


_D = ("hotspot", "building", ATTRIBUTES)
_CL = "cl as (select hotspot_id, sum(weight) as weight, count(*) as n, sum(lon * weight) / sum(weight) as lon, sum(lat * weight) / sum(weight) as lat from demand group by hotspot_id)"
_ST = "st as (select *, case when hotspot_id % 5 = 0 then 'charge_a' else 'charge_b' end as station_type from hotspot where hotspot_id % 7 <> 3)"
_SEG = "seg as (select a.hotspot_id * 100 + step as edge_id, a.hotspot_id as a, b.hotspot_id as b, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_ from hotspot a, (values (1), (32), (33)) s(step), hotspot b where b.hotspot_id = a.hotspot_id + step)"
# Liang-Barsky clipping against rectangles
_CLIP = """clip as (select edge_id, zone_id, greatest(0, case when bx <> ax then least((xmin - ax) / (bx - ax), (xmax - ax) / (bx - ax)) when ax > xmin and ax < xmax then 0 else 2 end, case when by_ <> ay then least((ymin - ay) / (by_ - ay), (ymax - ay) / (by_ - ay)) when ay > ymin and ay < ymax then 0 else 2 end) as t0,
 least(1, case when bx <> ax then greatest((xmin - ax) / (bx - ax), (xmax - ax) / (bx - ax)) when ax > xmin and ax < xmax then 1 else -2 end, case when by_ <> ay then greatest((ymin - ay) / (by_ - ay), (ymax - ay) / (by_ - ay)) when ay > ymin and ay < ymax then 1 else -2 end) as t1 from seg, zone)"""
_BLOCK = "blocked as (select distinct edge_id, zone_id from clip where t1 - t0 > 1e-9)"
_NEAR = f"near as (select a.hotspot_id as a, b.hotspot_id as b, {km('a', 'b')} as km from hotspot a, hotspot b where a.hotspot_id < b.hotspot_id)"
_COMP = "comp as (select node, min(other) as component from reach group by node)"
_REACH = "recursive nothing as (select 1), link as (select a, b from near where km <= 3.4 and (a + b) % 3 <> 0 union all select b, a from near where km <= 3.4 and (a + b) % 3 <> 0), reach as (select hotspot_id as node, hotspot_id as other from hotspot union select r.node, l.b from reach r join link l on l.a = r.other)"


def _recursive(body: str) -> str:
    return "with recursive " + ", ".join([S.CTES["hotspot"], _NEAR, _REACH.removeprefix("recursive nothing as (select 1), "), _COMP]) + " " + body


QUERIES = {
    "demand_grid": (demand_grid, None),
    "demand_cells": (demand_cells, sql("select *, row_number() over (partition by cx order by first) as cluster_id from (select cast(floor(lon / 0.005e0) as bigint) as cx, cast(floor(lat / 0.0025e0) as bigint) as cy, round(sum(weight), 3) as weight, count(*) as n, min(building_id) as first from demand group by 1, 2) where n >= 2", *_D)),
    "building_in_district": (building_in_district, sql("select building_id, coalesce(cast(min(district_id) as varchar), concat('unassigned_', building_id)) as region from building b left join (select distinct district_id, xmin, xmax, ymin, ymax from district) d on lon > xmin and lon < xmax and lat > ymin and lat < ymax group by building_id", "building", "district")),
    "building_not_in_zone": (building_not_in_zone, sql("select building_id from building b where not exists (select 1 from zone where lon > xmin and lon < xmax and lat > ymin and lat < ymax)", "building", "zone")),
    "building_in_zone": (building_in_zone, sql("select building_id, zone_id from building b join zone on lon > xmin and lon < xmax and lat > ymin and lat < ymax", "building", "zone")),
    "max_height_at_point": (max_height_at_point, sql("select a.building_id, round(coalesce(max(b.height_m), 0), 3) as height_m from attr a left join attr b on abs(a.lon - b.lon) < sqrt(b.area_m2) / 2 / 111320.0e0 and abs(a.lat - b.lat) < sqrt(b.area_m2) / 2 / 111320.0e0 and b.lon between a.lon - 0.001 and a.lon + 0.001 group by a.building_id", *_D)),
    "exactly_one_hull": (exactly_one_hull, sql(f"select b.building_id, case when count(h.hotspot_id) = 1 then min(h.hotspot_id) end as hotspot_id from building b left join hotspot h on {km('b', 'h')} <= 1.6 group by b.building_id", "hotspot", "building")),
    "nearest_hotspot": (nearest_hotspot, sql(f"select building_id, hotspot_id, round(km, 6) as km from (select building_id, h.hotspot_id, {km('b', 'h')} as km, row_number() over (partition by building_id order by {km('b', 'h')}, h.hotspot_id) as r from building b, hotspot h) where r = 1", "hotspot", "building")),
    "knn_edges": (knn_edges, sql(f"select distinct least(x, y) as a, greatest(x, y) as b, round(km, 6) as km from (select *, row_number() over (partition by x order by km, y) as r from (select a.hotspot_id as x, b.hotspot_id as y, {km('a', 'b')} as km from hotspot a, hotspot b where a.hotspot_id <> b.hotspot_id) where km <= 3.2) where r <= 2", "hotspot")),
    "nearest_margin": (nearest_margin, sql(f"select building_id, hotspot_id, round(nxt - km, 6) as margin from (select *, lead(km) over (partition by building_id order by km, hotspot_id) as nxt, row_number() over (partition by building_id order by km, hotspot_id) as r from (select building_id, h.hotspot_id, {km('b', 'h')} as km from building b, hotspot h) where km <= 6) where r = 1 and nxt is not null", "hotspot", "building")),
    "coverage_pairs": (coverage_pairs, sql(f"select h.hotspot_id, round(sum(weight), 3) as weight, count(*) as n from hotspot h join demand b on {km('h', 'b')} <= 1.6 group by h.hotspot_id", *_D)),
    "hull_gap_pairs": (hull_gap_pairs, sql("select a, b, round(gap, 9) as gap from (select a.zone_id as a, b.zone_id as b, sqrt(pow(greatest(0, b.xmin - a.xmax, a.xmin - b.xmax), 2) + pow(greatest(0, b.ymin - a.ymax, a.ymin - b.ymax), 2)) as gap from zone a, zone b where a.zone_id < b.zone_id) where gap <= 0.12", "zone")),
    "complete_graph": (complete_graph, sql("select a, b, round(km, 6) as km from near", "hotspot", _NEAR)),
    "semi_covered_demand": (semi_covered_demand, sql("select hotspot_id, round(sum(weight), 3) as weight from demand where hotspot_id in (select hotspot_id from st) group by hotspot_id", *_D, _ST)),
    "unserved_demand": (unserved_demand, sql("select hotspot_id, round(sum(weight), 3) as weight, count(*) as n from demand where hotspot_id not in (select hotspot_id from st) group by hotspot_id", *_D, _ST)),
    "coverage_ratio": (coverage_ratio, sql("select round(sum(case when s.hotspot_id is not null then weight else 0 end) / sum(weight), 9) as ratio, count(distinct d.hotspot_id) as clusters, count(distinct s.hotspot_id) as served from demand d left join st s on d.hotspot_id = s.hotspot_id", *_D, _ST)),
    "best_per_cluster": (best_per_cluster, sql("select hotspot_id, building_id, round(weight, 4) as weight from (select *, row_number() over (partition by hotspot_id order by weight desc, building_id) as r from demand) where r = 1", *_D)),
    "cluster_weight": (cluster_weight, sql("select hotspot_id, round(weight, 3) as weight, n, round(lon, 6) as lon, round(lat, 6) as lat from cl", *_D, _CL)),
    "subcluster_rows": (subcluster_rows, sql("select hotspot_id, least(10000.0e0, round_even(sum(weight), 0)) as weight, count(*) as n, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from demand group by hotspot_id", *_D)),
    "charging_capacity": (charging_capacity, sql("select hotspot_id, raw, total, cargo - least(o, cargo) as cargo, monitoring - least(o - least(o, cargo), monitoring) as monitoring, greatest(0, total - cargo - monitoring) as service from (select *, greatest(0, cargo + monitoring - total) as o from (select *, cast(round_even(total * 0.75e0, 0) as bigint) as cargo, cast(round_even(total * 0.15e0, 0) as bigint) as monitoring from (select hotspot_id, round(weight * 0.02e0, 4) as raw, cast(round_even(round(weight * 0.02e0, 6), 0) as bigint) as total from cl)))", *_D, _CL)),
    "garage_link_capacity": (garage_link_capacity, sql(f"select a_id, drones, cast(round_even(drones * 0.3e0, 0) as bigint) as capacity from (select a.hotspot_id as a_id, cast(ca.total + coalesce(sum(cb.total), 0) as bigint) as drones from st a join cap ca on ca.hotspot_id = a.hotspot_id left join lk on lk.a_id = a.hotspot_id left join cap cb on cb.hotspot_id = lk.b_id where a.station_type = 'charge_a' group by a.hotspot_id, ca.total)", *_D, _CL, _ST, "cap as (select hotspot_id, cast(round_even(round(weight * 0.02e0, 6), 0) as bigint) as total from cl)", f"lk as (select b_id, a_id from (select b.hotspot_id as b_id, a.hotspot_id as a_id, row_number() over (partition by b.hotspot_id order by {km('b', 'a')}, a.hotspot_id) as r from st b, st a where b.station_type = 'charge_b' and a.station_type = 'charge_a') where r = 1)")),
    "main_cluster": (main_cluster, sql(f"select region, hotspot_id, round(km, 5) as km from (select region, c.hotspot_id, {km('m', 'c')} as km, row_number() over (partition by region order by {km('m', 'c')}, c.weight desc, c.hotspot_id) as r from (select *, cast(floor(hotspot_id % 32 / 8) + 4 * floor(hotspot_id / 128) as bigint) as region from cl) c join (select cast(floor(hotspot_id % 32 / 8) + 4 * floor(hotspot_id / 128) as bigint) as region, sum(lon * weight) / sum(weight) as lon, sum(lat * weight) / sum(weight) as lat from cl group by 1) m using (region)) where r = 1", *_D, _CL)),
    "quantile_regions": (quantile_regions, sql("select hotspot_id, cast((lon >= q[1])::integer + (lon >= q[2])::integer + (lon >= q[3])::integer as integer) as region from cl, (select quantile_cont(lon, [0.25, 0.5, 0.75]) as q from cl)", *_D, _CL)),
    "lex_chunks": (lex_chunks, sql("select hotspot_id, chunk, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat, count(*) as n from (select *, cast(floor((row_number() over (partition by hotspot_id order by lon, lat, building_id) - 1) / 5) as bigint) as chunk from building) group by hotspot_id, chunk", "building")),
    "site_merge": (site_merge, sql("select round(lon, 2) as lon, round(lat, 2) as lat, bool_or(building_id % 9 = 0) as is_station, min(building_id) as first, count(*) as n from building group by 1, 2", "building")),
    "rooftop_candidates": (rooftop_candidates, sql("select building_id from building where lower(trim(building)) in ('apartments', 'dormitory')", "building")),
    "ground_candidates": (ground_candidates, sql(f"select building_id from (select *, lower(trim(coalesce(building, ''))) as t from building) where t not in ('apartments', 'dormitory') and (t in {_list(B.GROUND_TAGS)} or t = 'office' or area_m2 > 400)", "building")),
    "garage_candidates": (garage_candidates, sql(f"select distinct building_id as candidate_id, building_id, area_m2 from building b join landuse on lon > xmin and lon < xmax and lat > ymin and lat < ymax where lower(trim(building)) in {_list(B.WORKSHOP_TAGS)} and lower(trim(building)) not in {_list(B.NOT_WORKSHOP_TAGS)} and area_m2 >= case lower(trim(building)) when 'garage' then 20 when 'garages' then 60 else 250 end", "building", "landuse")),
    "segment_blocked": (segment_blocked, sql("select edge_id, zone_id from blocked", "hotspot", "zone", _SEG, _CLIP, _BLOCK)),
    "clear_edges": (clear_edges, sql("select edge_id, a, b from seg where edge_id not in (select edge_id from blocked)", "hotspot", "zone", _SEG, _CLIP, _BLOCK)),
    "edge_clearance": (edge_clearance, sql("select edge_id from blocked union select edge_id from seg, zone, range(0, 8) r(i) where ax + (bx - ax) * i / 7 > xmin and ax + (bx - ax) * i / 7 < xmax and ay + (by_ - ay) * i / 7 > ymin and ay + (by_ - ay) * i / 7 < ymax", "hotspot", "zone", _SEG, _CLIP, _BLOCK)),
    "roof_filter": (roof_filter, sql("select edge_id from seg where a in (select hotspot_id from low) and b in (select hotspot_id from low)", *_D, _SEG, "low as (select hotspot_id from (select *, row_number() over (partition by hotspot_id order by weight desc, building_id) as r from demand) where r = 1 and height_m < 90)")),
    "echelon_edges": (echelon_edges, sql("select cast(level as integer) as level, count(*) as edges, cast(sum(edge_id) as bigint) as checksum from seg join roof ra on ra.hotspot_id = seg.a join roof rb on rb.hotspot_id = seg.b join (values (1, 35.0), (2, 62.5), (3, 90.0)) l(level, least_m) on ra.height_m < least_m and rb.height_m < least_m where edge_id not in (select edge_id from blocked) group by level", *_D, "zone", _SEG, _CLIP, _BLOCK, "roof as (select hotspot_id, height_m from (select *, row_number() over (partition by hotspot_id order by weight desc, building_id) as r from demand) where r = 1)")),
    "air_grid_nodes": (air_grid_nodes, None),
    "air_grid_edges": (air_grid_edges, None),
    "network_components": (network_components, _recursive("select node, component from comp")),
    "component_bridges": (component_bridges, _recursive("select ca, cb, a, b, round(km, 6) as km from (select *, row_number() over (partition by ca, cb order by km, a, b) as r from (select least(x.component, y.component) as ca, greatest(x.component, y.component) as cb, a, b, km from near join comp x on x.node = a join comp y on y.node = b where x.component <> y.component and km <= 6)) where r = 1")),
    "node_degree": (node_degree, sql(f"select node, count(*) as degree from (select unnest([a, b]) as node from (select distinct least(x, y) as a, greatest(x, y) as b from (select *, row_number() over (partition by x order by km, y) as r from (select a.hotspot_id as x, b.hotspot_id as y, {km('a', 'b')} as km from hotspot a, hotspot b where a.hotspot_id <> b.hotspot_id) where km <= 3.2) where r <= 2)) group by node", "hotspot")),
    "mst": (mst, None),
    "dbscan_regions": (dbscan_regions, None),
    "neighbour_counts": (neighbour_counts, sql(f"select a.building_id, count(*) as n from building a join building b on b.lat between a.lat - 0.004 and a.lat + 0.004 and {km('a', 'b')} <= 0.4 group by a.building_id", "building")),
    "astar_paths": (astar_paths, None),
    "greedy_coverage": (greedy_coverage, None),
    "place_facilities": (place_facilities, None),
    "forced_placement": (forced_placement, sql(f"select c.hotspot_id, case when m.hotspot_id is not null then 'charge_a' else 'charge_b' end as station_type, coalesce(r.building_id, -1) as building_id from cl c left join mains m on m.hotspot_id = c.hotspot_id left join (select hotspot_id, building_id from (select d.hotspot_id, d.building_id, row_number() over (partition by d.hotspot_id order by round({km('c', 'd')}, 6), d.building_id) as n from demand d join cl c on c.hotspot_id = d.hotspot_id where d.btag in ('apartments', 'dormitory')) where n = 1) r on r.hotspot_id = c.hotspot_id", *_D, _CL, f"mains as (select hotspot_id from (select region, c.hotspot_id, row_number() over (partition by region order by {km('m', 'c')}, c.weight desc, c.hotspot_id) as n from (select *, cast(floor(hotspot_id % 32 / 8) + 4 * floor(hotspot_id / 128) as bigint) as region from cl) c join (select cast(floor(hotspot_id % 32 / 8) + 4 * floor(hotspot_id / 128) as bigint) as region, sum(lon * weight) / sum(weight) as lon, sum(lat * weight) / sum(weight) as lat from cl group by 1) m using (region)) where n = 1)")),
    "assignment": (assignment, None),
    "kmeans_split": (kmeans_split, None),
    "voronoi_edges": (voronoi_edges, None),
    "parallel_suppression": (parallel_suppression, None),
    "detour_routes": (detour_routes, None),
    "zone_kinds": (zone_kinds, "select zone_kind, count(*) as n from (select case when p_partkey % 17 = 0 then 'aerodrome' when p_partkey % 19 = 0 then 'military' when p_partkey % 23 = 1 then 'nuclear' when p_partkey % 23 = 0 then 'power_plant' when p_partkey % 17 = 2 then 'park' when p_partkey % 19 = 1 then 'recreation' when p_partkey % 17 = 4 then 'school' when p_partkey % 17 = 5 then 'clinic' when p_partkey % 17 = 6 then 'fuel' when p_partkey % 29 = 0 then 'station' end as zone_kind from part) where zone_kind is not null group by zone_kind"),
    "admin_districts": (admin_districts, sql("select district_id, min(admin_level) as admin_level from (select *, try_cast(admin_level as integer) as l from district) where l between 6 and 10 group by district_id", "district")),
    "landuse_parts": (landuse_parts, sql("select landuse, count(*) as n, round(sum((xmax - xmin) * (ymax - ymin)), 9) as area from landuse group by landuse", "landuse")),
    "placement_key": (placement_key, "select concat('placement:', sha1('{\"city\":\"city\",\"network\":\"drive\",\"per_a\":4,\"radius\":1.6,\"simplify\":true}'), ':44') as key"),
    "chaikin_paths": (chaikin_paths, sql("select hotspot_id, cast(i as integer) as i, round(lon + dx, 6) as x, round(lat + dy, 6) as y from hotspot, (values (0, 0.0e0, 0.0e0), (1, 0.0075e0, 0.0e0), (2, 0.01e0, 0.005e0), (3, 0.01e0, 0.02e0)) p(i, dx, dy)", "hotspot")),
    "path_lengths": (path_lengths, sql(f"select hotspot_id, cast(9 as bigint) as points, round({km('h', 'p')} + {km('p', 'q')}, 6) as km from hotspot h, lateral (select h.lon + 0.01e0 as lon, h.lat as lat) p, lateral (select h.lon + 0.01e0 as lon, h.lat + 0.02e0 as lat) q", "hotspot")),
    "cross_track": (cross_track, sql("select hotspot_id, round(max(sqrt(pow(px - t * 0.01e0, 2) + pow(py - t * 0.005e0, 2))), 9) as offset from (select *, greatest(0e0, least(1e0, (px * 0.01e0 + py * 0.005e0) / (0.01e0 * 0.01e0 + 0.005e0 * 0.005e0))) as t from (select b.hotspot_id, b.lon - h.lon as px, b.lat - h.lat as py from building b join hotspot h using (hotspot_id))) group by hotspot_id", "hotspot", "building")),
    "convex_hull": (convex_hull, None),
    "placement_metrics": (placement_metrics, None),
    "geojson_points": (geojson_points, None),
    "union_stations": (union_stations, None),
}
