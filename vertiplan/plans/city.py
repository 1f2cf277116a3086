"""Queries over the city's sources, shapes, paths and limits, and their SQL; SQL for lattices, projections and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from vertiplan.functions import buildings as B
from vertiplan.functions import geo as G
from vertiplan.operators import facilities as P
from vertiplan.operators import placement as O
from vertiplan.operators import regions as R
from vertiplan.operators import routing as Z
from vertiplan.operators import spatial as J
from vertiplan.plans import composed as C
from vertiplan.plans import network as W
from vertiplan.plans.scalar import _list, described, flight_levels, sql
from vertiplan.session import checkpointed
from vertiplan.sources import osm
from vertiplan.sources import tables as S


def _feature_points(spark, d):
    """Tagged features at points beside the hotspots."""
    n = S.hotspots(spark, d).agg(F.count("*").alias("n"))
    f = osm.features(spark, d).join(F.broadcast(n))  # one row
    at = S.hotspots(spark, d).withColumnRenamed("lon", "hx").withColumnRenamed("lat", "hy")
    f = f.withColumn("hotspot_id", F.col("feature_id") % F.col("n")).join(at, "hotspot_id")
    return f.withColumn("lon", F.col("hx") + (F.col("feature_id") % 17 - 8) * 0.001).withColumn("lat", F.col("hy") + (F.col("feature_id") % 13 - 6) * 0.0008).drop("n", "hx", "hy", "hotspot_id")


def zone_shapes(spark, d):
    """The shape of each no-fly feature: the nearest building's footprint, else a circle; some kinds are always circles."""
    z = osm.zone_kinds(_feature_points(spark, d)).select("feature_id", "zone_kind", "buffered", "lon", "lat")
    return osm.zone_shapes(z, S.buildings(spark, d).select("building_id", "lon", "lat"))


def substation_circles(spark, d):
    f = _feature_points(spark, d).withColumn("power", F.when(F.col("feature_id") % 23 == 5, "substation").otherwise(F.col("power")))
    return osm.substations(f).select("feature_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "radius")


def boundary_box(spark, d):
    """The last fallback of the boundary: the box of the nodes."""
    return osm.box_ring(S.hotspots(spark, d)).select("seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _roads(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("trunk", "primary", "secondary", "tertiary", "footway")]), (F.col("edge_id") % 5 + 1).cast("int"))
    return W._local_edges(spark, d).select("edge_id", "a", "b", F.col("ax").alias("lon"), F.col("ay").alias("lat")).withColumn("highway", kinds)


def roads_in_box(spark, d):
    return osm.roads(_roads(spark, d), 36.7, 37.5, 55.0, 57.0).select("edge_id", "highway")


def roads_nearby(spark, d):
    """Where the box holds none: those of the network within 10 km of its centre."""
    return osm.roads(_roads(spark, d), 10.0, 10.1, 55.25, 55.35, centre=(36.9, 55.25)).select("edge_id", "highway")


def landuse_clipped(spark, d):
    """Landuse parts cut to the city's box."""
    box = S.hotspots(spark, d).agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat"))])
    p = S.landuses(spark, d).join(F.broadcast(box))  # one row
    p = p.select("landuse_id", F.greatest("xmin", "x0").alias("xmin"), F.least("xmax", "x1").alias("xmax"), F.greatest("ymin", "y0").alias("ymin"), F.least("ymax", "y1").alias("ymax")).where("xmin < xmax and ymin < ymax")
    return p.select("landuse_id", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


def degree_reach(spark, d):
    """Kilometres as degrees at each hotspot, its UTM code, and the middle latitude where it has none."""
    h = S.hotspots(spark, d).withColumn("lat", F.when(F.col("hotspot_id") % 4 != 1, F.col("lat")))
    own = F.coalesce("lat", F.lit(G.DEFAULT_LATITUDE))
    south = F.when(F.col("hotspot_id") % 2 == 0, own).otherwise(-own)
    return h.select("hotspot_id", F.round(G.km_to_degrees(F.lit(2.5), own), 9).alias("degrees"), G.utm_epsg(F.col("lon") * (F.col("hotspot_id") % 5), south).alias("epsg"))


def footprint_areas(spark, d):
    """Area of each building's square on the UTM plane."""
    half = F.sqrt("area_m2") / 2 / 111320.0
    b = S.buildings(spark, d).select("building_id", "lon", "lat", half.alias("h"))
    corners = [G.utm(F.col("lon") + i * F.col("h"), F.col("lat") + j * F.col("h"), 37) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    (x0, y0), *rest = corners
    from_first = [(x - x0, y - y0) for x, y in rest]
    cross = sum((x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(from_first, from_first[1:], strict=False)), F.lit(0.0))
    return b.select("building_id", F.round(cross / 2, 1).alias("area_m2"))


def route_threshold(spark, d):
    """Height from which on buildings are in the way of routes: the fourth level's altitude, or the highest there is, less the clearance."""
    lv = flight_levels(spark, d)
    return lv.where("level <= 4").agg((F.max("altitude_m") - B.CLEARANCE_M).alias("least"))


def _zigzag(spark, d):
    """A path per hotspot that doubles points and crosses itself."""
    return S.hotspots(spark, d).withColumn("path", F.expr("array(struct(lon as x, lat as y), struct(lon as x, lat as y), struct(lon + 0.02e0 as x, lat as y), struct(lon + 0.02e0 as x, lat + 0.01e0 as y), struct(lon + 0.01e0 as x, lat + 0.01e0 as y), struct(lon + 0.01e0 as x, lat - 0.01e0 as y), struct(lon + 0.03e0 as x, lat - 0.01e0 as y))"))


def loop_free_paths(spark, d):
    """Paths without their loops: corners and length of what is left."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def cut(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: [{"x": x, "y": y} for x, y in R.without_loops([(q["x"], q["y"]) for q in p])])

    p = _zigzag(spark, d).select("hotspot_id", F.posexplode(cut("path")).alias("i", "p"))
    return p.select("hotspot_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def distinct_neighbours(spark, d):
    """Paths without points equal to the one before."""
    w = Window.partitionBy("hotspot_id").orderBy("i")
    p = _zigzag(spark, d).select("hotspot_id", F.posexplode("path").alias("i", "p")).withColumn("last", F.lag("p").over(w))
    return p.where("last is null or p <> last").select("hotspot_id", F.row_number().over(w).alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def smooth_paths(spark, d):
    """Two rounds of corner cutting at a quarter."""
    p = S.hotspots(spark, d).withColumn("path", F.expr("array(struct(lon as x, lat as y), struct(lon + 0.01e0 as x, lat as y), struct(lon + 0.01e0 as x, lat + 0.02e0 as y))"))
    p = p.withColumn("path", G.chaikin(F.col("path"))).withColumn("path", G.chaikin(F.col("path")))
    return p.select("hotspot_id", F.posexplode("path").alias("i", "p")).select("hotspot_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def capped_points(spark, d):
    """At most 8 points of each densified path, the first ones."""
    p = S.hotspots(spark, d).withColumn("path", F.expr("array(struct(lon as x, lat as y), struct(lon + 0.01e0 as x, lat as y), struct(lon + 0.01e0 as x, lat + 0.02e0 as y))"))
    e = p.select("hotspot_id", F.posexplode(G.densify(F.col("path"), 0.0021)).alias("i", "p"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("hotspot_id").orderBy("i"))).where("n <= 8").select("hotspot_id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def first_candidates(spark, d):
    return P.first_rows(S.hotspots(spark, d).select(F.col("hotspot_id").alias("candidate")), 7)


def demand_without_fill(spark, d):
    """Demand rows that are no fill points; a missing flag is none."""
    c = S.hotspots(spark, d).withColumn("is_cluster_fill", F.when(F.col("hotspot_id") % 3 == 0, True).when(F.col("hotspot_id") % 3 == 1, False))
    return C.without_fill(c).select("hotspot_id")


def global_best(spark, d):
    """The one heaviest cluster, ties to the smaller."""
    return C._centres(spark, d).orderBy(F.desc("weight"), "cluster").limit(1).select("cluster", "weight")


def hull_points(spark, d):
    """Whether zone centres lie in the hull that is asked for; where no hull is asked for they do."""
    z = S.zones(spark, d).select("zone_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("lat"), F.when(F.col("zone_id") % 4 != 1, F.col("zone_id")).alias("asked"))
    held = R.in_hulls(z.select("zone_id", "lon", "lat"), S.buildings(spark, d), "zone_id", "hotspot_id", 0.4)
    return z.join(held.select("zone_id", F.col("hotspot_id").alias("asked"), F.lit(True).alias("held")), ["zone_id", "asked"], "left").select("zone_id", (F.col("asked").isNull() | F.coalesce("held", F.lit(False))).alias("inside"))


def cluster_hulls(spark, d):
    """Hulls as predicates: lattice points within a cluster's reach, inside the city's box and outside zones."""
    at = F.explode(F.expr("flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> named_struct('i', i, 'j', j))))"))
    g = S.hotspots(spark, d).withColumn("o", at).selectExpr("hotspot_id * 100 + (o.i + 2) * 5 + o.j + 2 as point_id", "lon + o.i * 0.0031e0 as lon", "lat + o.j * 0.0023e0 as lat")
    box = S.hotspots(spark, d).agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat"))])
    g = g.join(F.broadcast(box)).where("lon >= x0 and lon <= x1 and lat >= y0 and lat <= y1").select("point_id", "lon", "lat")  # one row
    held = R.in_hulls(g, S.buildings(spark, d), "point_id", "hotspot_id", 0.1)
    inside = J.points_in_polygons(g, S.rings(S.zones(spark, d), "zone_id"), "point_id", "zone_id").select("point_id")
    return held.join(inside, "point_id", "left_anti")


def station_candidates(spark, d):
    """Candidates of every type by one entry; an unknown type has none."""
    out = None
    for kind in ("rooftop", "ground", "garage", "harbour"):
        own = O.station_candidates(described(spark, d), S.zones(spark, d), S.landuses(spark, d), kind).withColumn("type", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("type").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("checksum"))


def route_status(spark, d):
    """Requests by what their straight line meets: nothing, an end in a zone, or a way around that is needed."""
    r = Z.routed(W._local_edges(spark, d), Z.boxes_as_rings(S.zones(spark, d), "zone_id"), "edge_id", lattice=False)
    return r.select("edge_id", F.when(F.col("status").isin("clear", "end_in_zone"), F.col("status")).otherwise("around").alias("status"))


def echelon_edges_by_level(spark, d):
    """Local edges of the first three levels whose both ends are lower than the level leaves."""
    roof = described(spark, d).groupBy("hotspot_id").agg(F.percentile_approx("height_m", F.lit(0.5), F.lit(100000)).alias("h"))
    lv = flight_levels(spark, d).where("level <= 3").selectExpr("level", f"altitude_m - {B.CLEARANCE_M} as least")
    e = W.clear_edges(spark, d).join(F.broadcast(lv))  # three rows
    for x in ("a", "b"):
        e = e.join(roof.select(F.col("hotspot_id").alias(x), F.col("h").alias(f"h{x}")), x)
    return e.where("ha < least and hb < least").select("level", "edge_id")


def node_places(spark, d):
    """Coordinates of graph nodes: lon and lat, else x and y, else none."""
    n = S.hotspots(spark, d).select("hotspot_id", F.when(F.col("hotspot_id") % 3 == 0, F.col("lon")).alias("lon"), F.when(F.col("hotspot_id") % 3 == 0, F.col("lat")).alias("lat"), F.when(F.col("hotspot_id") % 3 == 1, F.col("lon")).alias("x"), F.when(F.col("hotspot_id") % 3 == 1, F.col("lat")).alias("y"))
    return n.select("hotspot_id", F.coalesce("lon", "x").alias("lon"), F.coalesce("lat", "y").alias("lat"))


def trunk_features(spark, d):
    """Local edges as GeoJSON lines, straight where they have no path."""
    e = W._local_edges(spark, d).select("edge_id", "a", "b", F.lit(1.5).alias("weight"), F.lit("routed").alias("mode"), "ax", "ay", "bx", "by", F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("path"))
    return osm.geojson_lines(e)


def voronoi_global(spark, d):
    """Neighbours over all sites: those of one hotspot, and those of two whose boxes are near, up to 2 km."""
    sites = C.stage(spark, d, "sites", lambda s, x: W.lex_chunks(s, x, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk")).select("site", F.col("hotspot_id").alias("cluster"), "lon", "lat"))
    box = sites.groupBy("cluster").agg(F.min("lon").alias("xmin"), F.max("lon").alias("xmax"), F.min("lat").alias("ymin"), F.max("lat").alias("ymax"))
    near = J.box_gaps(box, "cluster", 0.02, 0.12).select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    return O.global_neighbours(sites, near, 2.0)


def voronoi_clipped(spark, d):
    """Neighbours within each hotspot whose link stays within the hull: its middle is near a building of the hotspot."""
    sites = W.lex_chunks(spark, d, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk"))
    e = O.with_ends(W.voronoi_edges(spark, d), sites.select("site", "lon", "lat")).withColumn("edge", F.col("a") * 1_000_000 + F.col("b"))
    m = e.select("edge", "cluster", "a", "b", ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat"))
    held = R.in_hulls(m.select("edge", "lon", "lat"), S.buildings(spark, d), "edge", "hotspot_id", 0.2)
    return m.join(held.select("edge", F.col("hotspot_id").alias("cluster")), ["edge", "cluster"], "left_semi").select("cluster", "a", "b")


def inter_cluster_detours(spark, d):
    """Links between hotspots led around zones along their edges only: how many have a way."""
    r = Z.routed(W._local_edges(spark, d), Z.boxes_as_rings(S.zones(spark, d), "zone_id"), "edge_id", lattice=False)
    return r.agg(F.count_if(F.col("path").isNotNull()).alias("ok"), F.count_if(F.col("path").isNull()).alias("failed"))


def kind_centroids(spark, d):
    """Sites of each hotspot and kind: groups of about 20 buildings in order of their places."""
    b = described(spark, d).select("hotspot_id", (F.col("demand") == "apartment").alias("apartment"), "building_id", "lon", "lat")
    r = F.row_number().over(Window.partitionBy("hotspot_id", "apartment").orderBy("lon", "lat", "building_id")) - 1
    g = b.withColumn("chunk", F.floor(r / 20)).groupBy("hotspot_id", "apartment", "chunk")
    return g.agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count("*").alias("n"))


def level_metrics(spark, d):
    """Edges and touched hotspots by level, and sums of texts that may be no numbers."""
    e = echelon_edges_by_level(spark, d).join(W._local_edges(spark, d).select("edge_id", "a", "b"), "edge_id")
    counts = e.select("level", "edge_id", F.explode(F.array("a", "b")).alias("hotspot_id")).groupBy("level").agg(F.count_distinct("edge_id").alias("edges"), F.count_distinct("hotspot_id").alias("touched"))
    total = S.buildings(spark, d).agg(F.sum(F.col("building_levels").try_cast("double")).alias("storeys"))
    return counts.join(F.broadcast(total))  # one row


_UTM = G.utm_sql("{x}", "{y}", 37)


def utm_text(x: str, y: str) -> tuple[str, str]:
    return _UTM[0].replace("{x}", x).replace("{y}", y), _UTM[1].replace("{x}", x).replace("{y}", y)


_X, _Y = utm_text("lon", "lat")
_KIND = "case when aeroway in ('heliport') then 'aerodrome' when landuse = 'military' then 'military' when power = 'nuclear' then 'nuclear' when power = 'plant' then 'power_plant' when leisure = 'park' then 'park' when landuse = 'recreation_ground' then 'recreation' when amenity = 'school' then 'school' when amenity = 'clinic' then 'clinic' when amenity = 'fuel' then 'fuel' when railway = 'station' then 'station' end"
_FEATURE = f"""feature as (select p_partkey as feature_id, case p_partkey % 17 when 0 then 'heliport' end as aeroway, case p_partkey % 17 when 2 then 'park' end as leisure, case p_partkey % 17 when 4 then 'school' when 5 then 'clinic' when 6 then 'fuel' end as amenity,
 case p_partkey % 19 when 0 then 'military' when 1 then 'recreation_ground' end as landuse, case p_partkey % 23 when 0 then 'plant' when 1 then 'nuclear' end as power, case p_partkey % 29 when 0 then 'station' end as railway,
 h.lon + (p_partkey % 17 - 8) * 0.001e0 as lon, h.lat + (p_partkey % 13 - 6) * 0.0008e0 as lat from part join hotspot h on h.hotspot_id = p_partkey % (select count(*) from hotspot))"""
_GRID = """box as (select min(lon) - 0.01e0 as x0, max(lon) + 0.01e0 as x1, min(lat) - 0.01e0 as y0, max(lat) + 0.01e0 as y1 from hotspot),
dims as (select *, 0.01e0 * greatest(1, ceil(sqrt((x1 - x0) / 0.01e0 * ((y1 - y0) / 0.01e0) / 10000))) as step from box), size as (select *, cast(trunc((x1 - x0) / step) as bigint) + 1 as nx, cast(trunc((y1 - y0) / step) as bigint) + 1 as ny from dims),
lattice as (select iy * nx + ix as node, ix, iy, x0 + ix * step as lon, y0 + iy * step as lat from size, range(0, 100000) a(ix), range(0, 100000) b(iy) where ix < nx and iy < ny),
free as (select * from lattice l where not exists (select 1 from zone where l.lon > xmin and l.lon < xmax and l.lat > ymin and l.lat < ymax)),
seg as (select a.node * (select nx * ny from size) + b.node as edge_id, a.node as a, b.node as b, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_ from free a, (values (1, 0), (0, 1), (1, 1), (1, -1)) s(i, j), free b where b.ix = a.ix + s.i and b.iy = a.iy + s.j)"""
_OPEN = f"open_edge as (select a, b, round(2 * 6371.0e0 * asin(sqrt(pow(sin(radians(by_ - ay) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2))), 6) as weight from seg where edge_id not in (select edge_id from blocked))"
_PATH3 = "(select hotspot_id, unnest([{i: 0, x: lon, y: lat}, {i: 1, x: lon, y: lat}, {i: 2, x: lon + 0.02e0, y: lat}, {i: 3, x: lon + 0.02e0, y: lat + 0.01e0}, {i: 4, x: lon + 0.01e0, y: lat + 0.01e0}, {i: 5, x: lon + 0.01e0, y: lat - 0.01e0}, {i: 6, x: lon + 0.03e0, y: lat - 0.01e0}]) as p from hotspot)"
_ZONE_FREE = "not exists (select 1 from zone where b.lon > xmin and b.lon < xmax and b.lat > ymin and b.lat < ymax)"


def _greedy_sql(n: int, km: float, apart: float) -> str:
    """The greedy placement as n steps."""
    parts = [f"reach as (select h.hotspot_id as candidate, b.building_id as demand, b.weight from hotspot h join demand b on b.lat between h.lat - {km / 111.0} and h.lat + {km / 111.0} and {W.km('h', 'b')} <= {km})", "got0 as (select cast(-1 as bigint) as candidate, 0e0 as gain, 0e0 as lon, 0e0 as lat where false)"]
    for i in range(1, n + 1):
        gain = f"(select r.candidate, sum(r.weight) as g from reach r where not exists (select 1 from reach t join got{i - 1} k on k.candidate = t.candidate where t.demand = r.demand) group by r.candidate)"
        parts.append(f"got{i} as (select * from got{i - 1} union all (select h.hotspot_id, coalesce(g, 0), h.lon, h.lat from hotspot h left join {gain} s on s.candidate = h.hotspot_id where h.hotspot_id not in (select candidate from got{i - 1}) order by exists (select 1 from got{i - 1} k where {W.km('h', 'k')} < {apart}), round(coalesce(g, 0), 6) desc, h.hotspot_id limit 1))")
    return ", ".join(parts)


# a triangle belongs if no site is in the circle through its corners: a determinant whose sign follows the corners' turn
_CIRCLE = """tri as (select a.hotspot_id as cluster, a.site as a, b.site as b, c.site as c, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_, c.lon as cx, c.lat as cy,
 (b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon) as turn from site a join site b on b.hotspot_id = a.hotspot_id and b.site > a.site join site c on c.hotspot_id = a.hotspot_id and c.site > b.site),
seen as (select t.cluster, t.a, t.b, t.c, sign(turn) as way, ax - s.lon as px, ay - s.lat as py, bx - s.lon as qx, by_ - s.lat as qy, cx - s.lon as rx, cy - s.lat as ry from tri t join site s on s.hotspot_id = t.cluster and s.site <> t.a and s.site <> t.b and s.site <> t.c where abs(turn) > 5e-13),
hit as (select distinct cluster, a, b, c from seen where way * (px * (qy * (rx * rx + ry * ry) - (qx * qx + qy * qy) * ry) - py * (qx * (rx * rx + ry * ry) - (qx * qx + qy * qy) * rx) + (px * px + py * py) * (qx * ry - qy * rx)) > 1e-21),
face as (select cluster, a, b, c from tri anti join hit using (cluster, a, b, c) where abs(turn) > 5e-13)"""
_SITE12 = "site as (select hotspot_id * 1000 + chunk as site, hotspot_id, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from (select *, cast(floor((row_number() over (partition by hotspot_id order by lon, lat, building_id) - 1) / 12) as bigint) as chunk from building) group by hotspot_id, chunk)"

QUERIES = {
    "zone_shapes": (zone_shapes, sql(f"select feature_id, zone_kind, case when building_id is null then 'circle' else 'building' end as shape, building_id, case when building_id is null then 0.0002e0 end as radius from (select feature_id, {_KIND} as zone_kind, case when {_KIND} in ('aerodrome', 'military', 'nuclear') then null else (select b.building_id from building b where b.lon between f.lon - 0.0005 and f.lon + 0.0005 and b.lat between f.lat - 0.0005 and f.lat + 0.0005 and sqrt(pow(b.lon - f.lon, 2) + pow(b.lat - f.lat, 2)) <= 0.0005 order by sqrt(pow(b.lon - f.lon, 2) + pow(b.lat - f.lat, 2)), b.building_id limit 1) end as building_id from feature f) where zone_kind is not null", "hotspot", "building", _FEATURE)),
    "substation_circles": (substation_circles, sql("select feature_id, round(lon, 6) as lon, round(lat, 6) as lat, 0.00045e0 as radius from feature where feature_id % 23 = 5", "hotspot", _FEATURE)),
    "boundary_box": (boundary_box, sql("select cast(seq as integer) as seq, round(case when seq in (0, 3) then x0 else x1 end, 6) as lon, round(case when seq < 2 then y0 else y1 end, 6) as lat from (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from hotspot), range(0, 4) r(seq)", "hotspot")),
    "roads_in_box": (roads_in_box, sql("select edge_id, (['trunk', 'primary', 'secondary', 'tertiary'])[edge_id % 5 + 1] as highway from seg where edge_id % 5 < 4 and ax between 36.7 and 37.5 and ay between 55.0 and 57.0", "hotspot", W._SEG)),
    "roads_nearby": (roads_nearby, sql(f"select edge_id, (['trunk', 'primary', 'secondary', 'tertiary'])[edge_id % 5 + 1] as highway from (select *, ax as lon, ay as lat from seg) s, (select 36.9e0 as lon, 55.25e0 as lat) c where edge_id % 5 < 4 and {W.km('c', 's')} <= 10", "hotspot", W._SEG)),
    "landuse_clipped": (landuse_clipped, sql("select landuse_id, round(greatest(xmin, x0), 6) as xmin, round(least(xmax, x1), 6) as xmax, round(greatest(ymin, y0), 6) as ymin, round(least(ymax, y1), 6) as ymax from (select * from landuse), (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from hotspot) where greatest(xmin, x0) < least(xmax, x1) and greatest(ymin, y0) < least(ymax, y1)", "hotspot", "landuse")),
    "degree_reach": (degree_reach, sql("select hotspot_id, round(greatest(2.5e0 / 111, 2.5e0 / (111 * greatest(0.2e0, cos(radians(lat))))), 9) as degrees, cast(case when hotspot_id % 2 = 0 then 32600 else 32700 end + least(60, greatest(1, floor((lon * (hotspot_id % 5) + 180) / 6) + 1)) as integer) as epsg from (select hotspot_id, lon, case when hotspot_id % 4 <> 1 then lat else 55e0 end as lat from hotspot)", "hotspot")),
    "footprint_areas": (footprint_areas, sql("select building_id, round(((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) + (x3 - x1) * (y4 - y1) - (x4 - x1) * (y3 - y1)) / 2, 1) as area_m2 from (select building_id, " + ", ".join(f"{t} as {n}{k}" for k, (i, j) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)), 1) for n, t in zip("xy", utm_text(f"(lon + {i} * h)", f"(lat + {j} * h)"))) + " from (select *, sqrt(area_m2) / 2 / 111320.0e0 as h from building))", "building")),
    "route_threshold": (route_threshold, "select 122.5e0 - 5 as least"),
    "loop_free_paths": (loop_free_paths, sql("select hotspot_id, cast(p.i as integer) as i, round(p.x, 6) as x, round(p.y, 6) as y from (select hotspot_id, unnest([{i: 0, x: lon, y: lat}, {i: 1, x: lon + 0.01e0, y: lat}, {i: 2, x: lon + 0.01e0, y: lat - 0.01e0}, {i: 3, x: lon + 0.03e0, y: lat - 0.01e0}]) as p from hotspot)", "hotspot")),
    "distinct_neighbours": (distinct_neighbours, sql(f"select hotspot_id, cast(row_number() over (partition by hotspot_id order by p.i) as integer) as i, round(p.x, 6) as x, round(p.y, 6) as y from (select *, lag(p) over (partition by hotspot_id order by p.i) as q from {_PATH3}) where q is null or p.x <> q.x or p.y <> q.y", "hotspot")),
    "smooth_paths": (smooth_paths, sql("select hotspot_id, cast(i as integer) as i, round(lon + dx, 6) as x, round(lat + dy, 6) as y from hotspot, (values (0, 0e0, 0e0), (1, 0.005625e0, 0e0), (2, 0.008125e0, 0.00125e0), (3, 0.009375e0, 0.00375e0), (4, 0.01e0, 0.00875e0), (5, 0.01e0, 0.02e0)) p(i, dx, dy)", "hotspot")),
    "capped_points": (capped_points, sql("select hotspot_id, cast(i as integer) as i, round(lon + case when i < 5 then 0.002e0 * i else 0.01e0 end, 6) as x, round(lat + case when i > 5 then 0.002e0 * (i - 5) else 0e0 end, 6) as y from hotspot, range(0, 8) r(i)", "hotspot")),
    "first_candidates": (first_candidates, sql("select hotspot_id as candidate from hotspot order by 1 limit 7", "hotspot")),
    "demand_without_fill": (demand_without_fill, sql("select hotspot_id from hotspot where hotspot_id % 3 <> 0", "hotspot")),
    "global_best": (global_best, sql("select cluster, weight from rc order by weight desc, cluster limit 1", *W._D, W._CL, C._RC)),
    "hull_points": (hull_points, sql(f"select z.zone_id, zone_id % 4 = 1 or exists (select 1 from building b where b.hotspot_id = z.zone_id and {W.km('z', 'b')} <= 0.4) as inside from (select zone_id, (xmin + xmax) / 2 as lon, (ymin + ymax) / 2 as lat from zone) z", "building", "zone")),
    "cluster_hulls": (cluster_hulls, sql(f"select distinct g.point_id, b.hotspot_id from (select hotspot_id * 100 + (i + 2) * 5 + j + 2 as point_id, lon + i * 0.0031e0 as lon, lat + j * 0.0023e0 as lat from hotspot, range(-2, 3) a(i), range(-2, 3) c(j)) g join building b on b.lat between g.lat - 0.001 and g.lat + 0.001 and {W.km('g', 'b')} <= 0.1, (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from hotspot) where g.lon between x0 and x1 and g.lat between y0 and y1 and not exists (select 1 from zone where g.lon > xmin and g.lon < xmax and g.lat > ymin and g.lat < ymax)", "hotspot", "building", "zone")),
    "station_candidates": (station_candidates, sql(f"select type, count(*) as n, cast(sum(id) as bigint) as checksum from (select 'rooftop' as type, building_id as id from demand b where btag in ('apartments', 'dormitory') and {_ZONE_FREE} union all select 'ground', building_id from demand b where btag not in ('apartments', 'dormitory') and (btag in {_list(B.GROUND_TAGS)} or btag = 'office' or area_m2 > 400) and {_ZONE_FREE} union all select 'garage', candidate from gsite b where {_ZONE_FREE}) group by type", *W._D, "zone", "landuse", C._GARAGE)),
    "route_status": (route_status, sql("select edge_id, case when exists (select 1 from zone where (ax > xmin and ax < xmax and ay > ymin and ay < ymax) or (bx > xmin and bx < xmax and by_ > ymin and by_ < ymax)) then 'end_in_zone' when edge_id in (select edge_id from blocked) then 'around' else 'clear' end as status from seg", "hotspot", "zone", W._SEG, W._CLIP, W._BLOCK)),
    "echelon_edges_by_level": (echelon_edges_by_level, sql("select cast(level as integer) as level, edge_id from seg join roof ra on ra.hotspot_id = a join roof rb on rb.hotspot_id = b join (values (1, 35.0), (2, 62.5), (3, 90.0)) l(level, least_m) on ra.h < least_m and rb.h < least_m where edge_id not in (select edge_id from blocked)", *W._D, "zone", W._SEG, W._CLIP, W._BLOCK, "roof as (select hotspot_id, quantile_disc(height_m, 0.5) as h from demand group by hotspot_id)")),
    "node_places": (node_places, sql("select hotspot_id, case when hotspot_id % 3 < 2 then lon end as lon, case when hotspot_id % 3 < 2 then lat end as lat from hotspot", "hotspot")),
    "trunk_features": (trunk_features, sql("""select concat('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[', round(ax, 6), ',', round(ay, 6), '],[', round(bx, 6), ',', round(by_, 6), ']]},"properties":{"source":', a, ',"target":', b, ',"weight_km":1.5,"mode":"routed"}}') as feature from seg""", "hotspot", W._SEG)),
    "kind_centroids": (kind_centroids, sql("select hotspot_id, apartment, chunk, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat, count(*) as n from (select *, demand = 'apartment' as apartment, cast(floor((row_number() over (partition by hotspot_id, demand = 'apartment' order by lon, lat, building_id) - 1) / 20) as bigint) as chunk from kind) group by all", *W._D)),
    "level_metrics": (level_metrics, sql("select cast(level as integer) as level, count(distinct edge_id) as edges, count(distinct h) as touched, (select sum(try_cast(building_levels as double)) from building) as storeys from (select level, edge_id, unnest([a, b]) as h from seg join roof ra on ra.hotspot_id = a join roof rb on rb.hotspot_id = b join (values (1, 35.0), (2, 62.5), (3, 90.0)) l(level, least_m) on ra.h < least_m and rb.h < least_m where edge_id not in (select edge_id from blocked)) group by level", *W._D, "zone", W._SEG, W._CLIP, W._BLOCK, "roof as (select hotspot_id, quantile_disc(height_m, 0.5) as h from demand group by hotspot_id)")),
    "voronoi_global": (voronoi_global, None),
    "voronoi_clipped": (voronoi_clipped, None),
    "inter_cluster_detours": (inter_cluster_detours, None),
}

def _dbscan_sql(eps: float, least: int, latitude: float, rounds: int = 12) -> str:
    """Density clusters by rounds of the least label near by, each followed by a jump to that label's own."""
    parts = [f"pt as materialized (select building_id as id, lon * 111320.0e0 * cos(radians({latitude})) as x, lat * 111320.0e0 as y from building)",
             f"cell as materialized (select *, cast(floor(x / {eps}) as bigint) as cx, cast(floor(y / {eps}) as bigint) as cy from pt)",
             f"pr as materialized (select a.id as a, b.id as b from cell a, (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(j), cell b where b.cx = a.cx + i.i and b.cy = a.cy + j.j and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {eps * eps})",
             f"hub as materialized (select a as id from pr group by a having count(*) >= {least})",
             "near_hub as materialized (select pr.a, pr.b from pr join hub p on p.id = a join hub q on q.id = b)",
             "lab0 as materialized (select id, id as c from hub)"]
    for i in range(1, rounds + 1):
        parts.append(f"low{i} as materialized (select a as id, min(c) as c from near_hub join lab{i - 1} l on l.id = b group by a)")
        parts.append(f"lab{i} as materialized (select x.id, least(x.c, y.c) as c from low{i} x join low{i} y on y.id = x.c)")
    body = f"select pt.id as point_id, coalesce(l.c, m.c) as cluster, l.id is not null as core from pt left join lab{rounds} l on l.id = pt.id left join (select a, min(c) as c from pr join lab{rounds} on lab{rounds}.id = b where a not in (select id from hub) group by a) m on m.a = pt.id"
    return sql(body, "building", *parts)


#: SQL of queries that stand elsewhere without it.
SQL = {
    "utm_project": sql(f"select building_id, 32637 as epsg, round({_X}, 3) as x, round({_Y}, 3) as y from building", "building"),
    "demand_grid": sql(f"select cx * 250 + 125e0 as x, cy * 250 + 125e0 as y, round(sum(weight), 3) as weight, count(*) as n, min(building_id) as first from (select *, floor({_X} / 250) as cx, floor({_Y} / 250) as cy from demand where case when btag = '' then 'yes' else btag end in {_list(B.DEMAND_TAGS)}) group by cx, cy having count(*) >= 2 and sum(weight) > 0", *W._D),
    "air_grid_nodes": sql("select node, round(lon, 6) as lon, round(lat, 6) as lat from free where node in (select a from open_edge union select b from open_edge)", "hotspot", "zone", _GRID, W._CLIP, W._BLOCK, _OPEN),
    "air_grid_edges": sql("select a, b, weight from open_edge", "hotspot", "zone", _GRID, W._CLIP, W._BLOCK, _OPEN),
    "union_stations": sql("select station_type, count(*) as n from st group by station_type union all select 'garage', least(6, count(*)) from hotspot", "hotspot", W._ST),
    "place_facilities": sql("select cast(row_number() over () as integer) as step, candidate, round(gain, 3) as gain from got6", *W._D, _greedy_sql(6, W.FACILITY_KM, W.SEPARATION_KM)),
    "mst": "with recursive " + ", ".join([S.CTES["hotspot"], W._NEAR, C.tree_sql("select a, b, round(km, 6) as weight from near where km <= 6")]) + " select a, b, weight from tree",
    "repacked_regions": C.staged("select cluster, region from region"),
    "dbscan_regions": _dbscan_sql(1080.0, 30, 55.4),
    "geojson_points": sql("""select hotspot_id, concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', round(lon, 6), ',', round(lat, 6), ']},"properties":{"hotspot_id":', hotspot_id, '}}') as feature from hotspot""", "hotspot"),
    "voronoi_edges": sql("select distinct cluster, x as a, y as b from (select cluster, a as x, b as y from face union all select cluster, b, c from face union all select cluster, a, c from face)", "building", _SITE12, _CIRCLE),
    "utm_round_trip": sql("select building_id, true as back, round(lon, 4) as lon, round(lat, 4) as lat from building", "building"),
}
