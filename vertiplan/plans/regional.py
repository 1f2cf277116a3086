"""Queries over regions, hulls, claims and links between clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vertiplan.functions import geo as G
from vertiplan.operators import graph as N
from vertiplan.operators import regions as R
from vertiplan.operators import spatial as J
from vertiplan.plans import network as W
from vertiplan.plans.scalar import described, sql
from vertiplan.sources import tables as S


def _sites(spark, d):
    return W.lex_chunks(spark, d, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk"))


def candidate_claims(spark, d):
    p = J.within_km(S.hotspots(spark, d), W.rooftop_candidates(spark, d).join(S.buildings(spark, d).select("building_id", "lon", "lat"), "building_id"), 3.0, "hotspot_id", "building_id")
    return R.claim(p.select(F.col("l_hotspot_id").alias("cluster"), F.col("r_building_id").alias("candidate"), F.round("km", 6).alias("km")), 4)


def redundant_edges(spark, d):
    near = W._near_edges(spark, d, 3.4).withColumn("weight", F.round("weight", 6))
    return R.matching(near.join(W.mst(spark, d).select("a", "b"), ["a", "b"], "left_anti"), 2)


def principal_regions(spark, d):
    return R.principal_regions(W._clusters(spark, d), "hotspot_id").select("hotspot_id", "region")


def repacked_regions(spark, d):
    return R.repack(W._clusters(spark, d).select(F.col("hotspot_id").alias("cluster"), F.round("weight", 3).alias("weight"), "lon", "lat"))


def _zone_centres(spark, d):
    return R.interior_points(S.rings(S.zones(spark, d), "zone_id"), "zone_id").select("zone_id", "lon", "lat")


def zone_centres(spark, d):
    return _zone_centres(spark, d).select("zone_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def hull_members(spark, d):
    return R.in_hulls(_zone_centres(spark, d), S.buildings(spark, d), "zone_id", "hotspot_id", 0.4)


def hull_owners(spark, d):
    return R.hull_owner(hull_members(spark, d), W._clusters(spark, d).withColumn("weight", F.round("weight", 3)), "zone_id", "hotspot_id")


def site_sizes(spark, d):
    c = described(spark, d).groupBy("hotspot_id").agg(F.count_if(F.col("demand") == "apartment").alias("apartments"), F.count_if(F.col("demand") != "apartment").alias("others"))
    a, o = R.site_sizes((F.col("hotspot_id") % 5 * 1_000_000).cast("double"), F.col("apartments"), F.col("others"), F.col("hotspot_id") % 3 * 20, F.lit(False))
    return c.select("hotspot_id", a.alias("apartment_size"), o.cast("long").alias("other_size"))


def fill_grid(spark, d):
    """Lattice points within 400 m of a building of their hotspot, outside zones."""
    at = F.explode(F.expr("flatten(transform(sequence(-3, 3), i -> transform(sequence(-3, 3), j -> named_struct('i', i, 'j', j))))"))
    g = S.hotspots(spark, d).withColumn("o", at).selectExpr("hotspot_id * 100 + (o.i + 3) * 7 + o.j + 3 as fill_id", "hotspot_id", "lon + o.i * 0.0041e0 as lon", "lat + o.j * 0.003e0 as lat")
    b = S.buildings(spark, d).select("building_id", F.col("hotspot_id").alias("h"), "lon", "lat")
    near = J.within_km(g, b, 0.4, "fill_id", "building_id").where("l_hotspot_id = r_h").select(F.col("l_fill_id").alias("fill_id"), F.col("l_hotspot_id").alias("hotspot_id"), F.col("l_lon").alias("lon"), F.col("l_lat").alias("lat")).distinct()
    inside = J.points_in_polygons(near, S.rings(S.zones(spark, d), "zone_id"), "fill_id", "zone_id").select("fill_id")
    kept = near.join(inside, "fill_id", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("hotspot_id").orderBy("fill_id"))).where("n <= 500")
    return kept.select("fill_id", "hotspot_id", F.lit(1.0).alias("weight"))


def clipped_segments(spark, d):
    c = R.clipped(W._local_edges(spark, d), S.zones(spark, d), "edge_id", "zone_id")
    return c.select("edge_id", "zone_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


def third_cluster_filter(spark, d):
    """Edges that cross no zone but those of their own two hotspots."""
    e = W._local_edges(spark, d)
    third = W.segment_blocked(spark, d).join(e.select("edge_id", "a", "b"), "edge_id").where("zone_id <> a and zone_id <> b").select("edge_id").distinct()
    return e.join(third, "edge_id", "left_anti").select("edge_id", "a", "b")


def small_cluster_links(spark, d):
    s = _sites(spark, d).select("site", "hotspot_id", "lon", "lat")
    p = J.within_km(s, s, 0.45, "site", "site").where("l_hotspot_id = r_hotspot_id and l_site <> r_site")
    r = p.withColumn("n", F.row_number().over(Window.partitionBy("l_site").orderBy(F.round("km", 6), "r_site"))).where("n <= 2")
    return r.select(F.least("l_site", "r_site").alias("a"), F.greatest("l_site", "r_site").alias("b"), F.round("km", 6).alias("km")).distinct()


def gap_bridges(spark, d):
    s = _sites(spark, d).select("site", "hotspot_id", "lon", "lat")
    p = J.within_km(s, s, 2.0, "site", "site").where("l_hotspot_id < r_hotspot_id")
    best = F.min(F.struct(F.round("km", 6).alias("km"), F.col("l_site").alias("a"), F.col("r_site").alias("b")))
    return p.groupBy(F.col("l_hotspot_id").alias("ca"), F.col("r_hotspot_id").alias("cb")).agg(best.alias("e")).select("ca", "cb", "e.a", "e.b", "e.km")


def cluster_radius_pairs(spark, d):
    c = W._clusters(spark, d).select("hotspot_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    p = J.within_km(c, c, 3.0, "hotspot_id", "hotspot_id").where("l_hotspot_id < r_hotspot_id")
    return p.select(F.col("l_hotspot_id").alias("a"), F.col("r_hotspot_id").alias("b"), F.round("km", 5).alias("km"))


def separated_candidates(spark, d):
    h = S.hotspots(spark, d)
    chosen = h.where("hotspot_id % 10 = 0")
    close = J.within_km(h, chosen, 2.6, "hotspot_id", "hotspot_id").select(F.col("l_hotspot_id").alias("hotspot_id")).distinct()
    return h.join(close, "hotspot_id", "left_anti").select("hotspot_id")


def route_scores(spark, d):
    b = S.buildings(spark, d)
    length, chord, bulge = 1 + F.col("building_id") % 13 * 0.25, 1 + F.col("building_id") % 7 * 0.1, F.col("building_id") % 5 * 0.08
    s = b.select(F.col("hotspot_id"), "building_id", F.round(R.route_score(length, chord, bulge), 6).alias("score"), length.alias("length"))
    return N.best_per_key(s, "hotspot_id", "score", "length", "building_id").select("hotspot_id", "building_id", "score")


def safe_graph(spark, d):
    """Grid nodes and edges that stay when the parks are closed too."""
    parks = S.zones(spark, d).where("zone_kind = 'park'")
    nodes = S.hotspots(spark, d).select(F.col("hotspot_id").alias("node"), (F.col("lon") + 0.006).alias("lon"), (F.col("lat") + 0.0035).alias("lat"))
    bad = J.points_in_polygons(nodes, S.rings(parks, "zone_id"), "node", "zone_id").select("node")
    e = W._local_edges(spark, d).join(W.segment_blocked(spark, d).select("edge_id").distinct(), "edge_id", "left_anti")
    return e.join(bad.withColumnRenamed("node", "a"), "a", "left_anti").join(bad.withColumnRenamed("node", "b"), "b", "left_anti").select("edge_id")


def hotspot_area(spark, d):
    """Box area of each hotspot's buildings on the web Mercator plane, and whether it is large."""
    x, y = G.mercator(F.col("lon"), F.col("lat"))
    a = S.buildings(spark, d).select("hotspot_id", x.alias("x"), y.alias("y")).groupBy("hotspot_id").agg(F.round((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e6, 4).alias("km2"))
    return a.withColumn("large", F.col("km2") > 3)


_D = W._D
_SITE = "site as (select hotspot_id * 1000 + chunk as site, hotspot_id, avg(lon) as lon, avg(lat) as lat from (select *, cast(floor((row_number() over (partition by hotspot_id order by lon, lat, building_id) - 1) / 12) as bigint) as chunk from building) group by hotspot_id, chunk)"
# lex_chunks rounds its centres to six places
_SITE = _SITE.replace("avg(lon) as lon", "round(avg(lon), 6) as lon").replace("avg(lat) as lat", "round(avg(lat), 6) as lat")
_CENTRE = "centre as (select zone_id, (xmin + xmax) / 2 as lon, (ymin + ymax) / 2 as lat from zone)"
_HULL = f"hull as (select distinct c.zone_id, b.hotspot_id from centre c join building b on {W.km('c', 'b')} <= 0.4)"

QUERIES = {
    "candidate_claims": (candidate_claims, None),
    "redundant_edges": (redundant_edges, None),
    "principal_regions": (principal_regions, sql("select hotspot_id, cast((select count(*) from range(1, k) r(i) where list_extract(q, cast(840 / k * i + 1 as integer)) <= t) as integer) as region from (select hotspot_id, k, (lon - mx) * cos(angle) + (lat - my) * sin(angle) as t from cl, ax), (select quantile_cont(t, list_transform(range(0, 841), lambda i: i / 840.0e0)) as q from (select (lon - mx) * cos(angle) + (lat - my) * sin(angle) as t from cl, ax))", *_D, W._CL, "ax as (select avg(lon) as mx, avg(lat) as my, 0.5e0 * atan2(2 * covar_pop(lon, lat), var_pop(lon) - var_pop(lat)) as angle, cast(greatest(2, least(8, round_even(sqrt(count(*)), 0))) as integer) as k from cl)")),
    "repacked_regions": (repacked_regions, None),
    "zone_centres": (zone_centres, sql("select zone_id, round(lon, 6) as lon, round(lat, 6) as lat from centre", "zone", _CENTRE)),
    "hull_members": (hull_members, sql("select zone_id, hotspot_id from hull", "hotspot", "building", "zone", _CENTRE, _HULL)),
    "hull_owners": (hull_owners, sql("select zone_id, hotspot_id from (select zone_id, h.hotspot_id, row_number() over (partition by zone_id order by round(weight, 3) desc, h.hotspot_id) as r from hull h join cl on cl.hotspot_id = h.hotspot_id) where r = 1", *_D, "zone", _CENTRE, _HULL, W._CL)),
    "site_sizes": (site_sizes, sql("select hotspot_id, cast(case when apartments > 0 then case when hotspot_id % 5 > 3 then 5 else 2 end end as integer) as apartment_size, cast(case when others > 0 then case when hotspot_id % 5 > 3 or apartments > 0 then case when hotspot_id % 3 = 0 then 60 else hotspot_id % 3 * 20 end else 3 end end as bigint) as other_size from (select hotspot_id, count(*) filter (demand = 'apartment') as apartments, count(*) filter (demand <> 'apartment') as others from kind group by hotspot_id)", *_D)),
    "fill_grid": (fill_grid, sql(f"select g.fill_id, g.hotspot_id, 1.0e0 as weight from (select hotspot_id * 100 + (i + 3) * 7 + j + 3 as fill_id, hotspot_id, lon + i * 0.0041e0 as lon, lat + j * 0.003e0 as lat from hotspot, range(-3, 4) a(i), range(-3, 4) b(j)) g where exists (select 1 from building b where b.hotspot_id = g.hotspot_id and {W.km('g', 'b')} <= 0.4) and not exists (select 1 from zone where g.lon > xmin and g.lon < xmax and g.lat > ymin and g.lat < ymax)", *_D, "zone")),
    "clipped_segments": (clipped_segments, sql("select edge_id, zone_id, round(t0, 6) as t0, round(t1, 6) as t1 from clip where t1 - t0 > 1e-9", "hotspot", "zone", W._SEG, W._CLIP)),
    "third_cluster_filter": (third_cluster_filter, sql("select edge_id, a, b from seg where not exists (select 1 from blocked k where k.edge_id = seg.edge_id and k.zone_id <> a and k.zone_id <> b)", "hotspot", "zone", W._SEG, W._CLIP, W._BLOCK)),
    "small_cluster_links": (small_cluster_links, sql(f"select distinct least(x, y) as a, greatest(x, y) as b, km from (select *, row_number() over (partition by x order by km, y) as r from (select a.site as x, b.site as y, round({W.km('a', 'b')}, 6) as km, {W.km('a', 'b')} as exact from site a join site b on a.hotspot_id = b.hotspot_id and a.site <> b.site) where exact <= 0.45) where r <= 2", "building", _SITE)),
    "gap_bridges": (gap_bridges, sql(f"select ca, cb, a, b, km from (select *, row_number() over (partition by ca, cb order by km, a, b) as r from (select a.hotspot_id as ca, b.hotspot_id as cb, a.site as a, b.site as b, round({W.km('a', 'b')}, 6) as km, {W.km('a', 'b')} as exact from site a join site b on a.hotspot_id < b.hotspot_id and abs(a.lat - b.lat) < 0.02) where exact <= 2) where r = 1", "building", _SITE)),
    "cluster_radius_pairs": (cluster_radius_pairs, sql(f"select a.hotspot_id as a, b.hotspot_id as b, round({W.km('a', 'b')}, 5) as km from rc a join rc b on a.hotspot_id < b.hotspot_id and {W.km('a', 'b')} <= 3.0", *_D, W._CL, "rc as (select hotspot_id, round(lon, 6) as lon, round(lat, 6) as lat from cl)")),
    "separated_candidates": (separated_candidates, sql(f"select hotspot_id from hotspot h where not exists (select 1 from hotspot c where c.hotspot_id % 10 = 0 and {W.km('h', 'c')} <= 2.6)", "hotspot")),
    "route_scores": (route_scores, sql("select hotspot_id, building_id, score from (select *, row_number() over (partition by hotspot_id order by score, length, building_id) as r from (select hotspot_id, building_id, length, round(length / chord + 0.08e0 * greatest(0e0, length - chord) + 0.52e0 * greatest(0e0, bulge - 0.12e0), 6) as score from (select hotspot_id, building_id, 1 + building_id % 13 * 0.25e0 as length, 1 + building_id % 7 * 0.1e0 as chord, building_id % 5 * 0.08e0 as bulge from building))) where r = 1", "building")),
    "safe_graph": (safe_graph, sql("select edge_id from seg where edge_id not in (select edge_id from blocked) and a not in (select node from bad) and b not in (select node from bad)", "hotspot", "zone", W._SEG, W._CLIP, W._BLOCK, "bad as (select hotspot_id as node from hotspot h where exists (select 1 from zone where zone_kind = 'park' and h.lon + 0.006e0 > xmin and h.lon + 0.006e0 < xmax and h.lat + 0.0035e0 > ymin and h.lat + 0.0035e0 < ymax))")),
    "hotspot_area": (hotspot_area, sql("select hotspot_id, km2, km2 > 3 as large from (select hotspot_id, round((max(radians(lon)) - min(radians(lon))) * 6378137.0e0 * (max(ln(tan(radians(lat) / 2 + pi() / 4))) - min(ln(tan(radians(lat) / 2 + pi() / 4)))) * 6378137.0e0 / 1e6, 4) as km2 from building group by hotspot_id)", "building")),
}
