"""A whole placement, stage by stage: every stage reads what the one before has found. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertiplan.functions import buildings as B
from vertiplan.functions import geo as G
from vertiplan.operators import facilities as P
from vertiplan.operators import graph as N
from vertiplan.operators import placement as O
from vertiplan.operators import regions as R
from vertiplan.operators import routing as Z
from vertiplan.operators import spatial as J
from vertiplan.plans import network as W
from vertiplan.plans.scalar import _list, described, sql
from vertiplan.session import checkpointed
from vertiplan.sources import tables as S

#: Metres around a member of a cluster that its hull reaches.
HULL_KM = 0.054
TRUNK_KM, EXTRA = W.FACILITY_KM, 2


_stages: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark, d, name: str, make, refresh: bool = False) -> DataFrame:
    """A stage's checkpointed result for a city folder: made once a session, and again with ``refresh``."""
    key = (spark.sparkContext.applicationId, d, name)
    if refresh:
        for k in [k for k in _stages if k[:2] == key[:2]]:
            del _stages[k]
    if key not in _stages:
        _stages[key] = checkpointed(make(spark, d))
    return _stages[key]


def _centres(spark, d):
    return stage(spark, d, "centres", _make_centres)


def _make_centres(spark, d):
    """(cluster, weight, lon, lat) of the demand clusters, rounded so that all engines rank them alike."""
    return W._clusters(spark, d).select(F.col("hotspot_id").alias("cluster"), F.round("weight", 3).alias("weight"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def cluster_regions(spark, d):
    return stage(spark, d, "cluster_regions", _make_cluster_regions)


def _make_cluster_regions(spark, d):
    """(cluster, region): five clusters a region, heaviest first, with the nearest that are left."""
    return R.repack(_centres(spark, d))


def _is_fill(df: DataFrame):
    return F.coalesce(F.col("is_cluster_fill"), F.lit(False)) if "is_cluster_fill" in df.columns else F.lit(False)


def without_fill(df: DataFrame) -> DataFrame:
    return df.where(~_is_fill(df))


def _members(spark, d):
    return stage(spark, d, "members", _make_members)


def _make_members(spark, d):
    """Demand buildings outside zones, (cluster, building_id, lon, lat): what the hulls reach around."""
    tag = F.when(F.col("btag") == "", "yes").otherwise(F.col("btag"))
    b = described(spark, d).where(tag.isin(B.DEMAND_TAGS)).select(F.col("hotspot_id").alias("cluster"), "building_id", "lon", "lat")
    return b.join(W.building_in_zone(spark, d).select("building_id").distinct(), "building_id", "left_anti")


def roof_candidates(spark, d):
    return stage(spark, d, "roof_candidates", _make_roof_candidates)


def _make_roof_candidates(spark, d):
    """Rooftops outside zones, (candidate, lon, lat)."""
    b = S.buildings(spark, d)
    b = b.join(W.rooftop_candidates(spark, d), "building_id", "left_semi").join(W.building_in_zone(spark, d).select("building_id").distinct(), "building_id", "left_anti")
    return b.select(F.col("building_id").alias("candidate"), "lon", "lat")


def candidate_hulls(spark, d):
    return stage(spark, d, "candidate_hulls", _make_candidate_hulls)


def _make_candidate_hulls(spark, d):
    """(candidate, cluster) of the rooftops that lie in the hull of just one cluster."""
    p = J.within_km(roof_candidates(spark, d), _members(spark, d).select("cluster", "lon", "lat"), HULL_KM, "candidate", "cluster")
    one = p.groupBy(F.col("l_candidate").alias("candidate")).agg(F.count_distinct("r_cluster").alias("n"), F.min("r_cluster").alias("cluster"))
    return one.where("n = 1").select("candidate", "cluster")


def forced_stations(centres: DataFrame, regions: DataFrame, candidates: DataFrame, hulls: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, region, station_type, source_index, lon, lat): an A station in each region's main cluster, the one nearest to
    its weighted middle (ties to the heavier, then the smaller), a B station in every other. It stands on the rooftop of
    the cluster's own hull that is nearest to the cluster's centre; without one in the hull's own middle (source_index -1, its
    member nearest to the centre); without a hull on the nearest rooftop of all."""
    c = centres.join(regions, "cluster")
    w = F.sum("weight")
    middle = c.groupBy("region").agg((F.sum(F.col("lon") * F.col("weight")) / w).alias("mx"), (F.sum(F.col("lat") * F.col("weight")) / w).alias("my"))
    ranked = c.join(middle, "region").withColumn("km", F.round(G.haversine_km(F.col("my"), F.col("mx"), F.col("lat"), F.col("lon")), 6))
    main = N.best_per_key(ranked, "region", "km", F.desc("weight"), "cluster").select("cluster", F.lit("charge_a").alias("station_type"))
    own = c.select("cluster", "region", F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    km = F.round(G.haversine_km(F.col("cy"), F.col("cx"), F.col("lat"), F.col("lon")), 6)

    def nearest(rows: DataFrame, key: str, as_: str) -> DataFrame:
        best = F.min(F.struct(km.alias("km"), F.col(key).alias("id"), "lon", "lat"))
        return rows.join(own, "cluster").groupBy("cluster").agg(best.alias(as_))

    # the search for the nearest rooftop of all reads these in every round
    roof = checkpointed(nearest(candidates.join(hulls, "candidate"), "candidate", "roof"))
    inner = checkpointed(nearest(members, "building_id", "inner"))
    bare = checkpointed(own.join(roof, "cluster", "left_anti").join(inner, "cluster", "left_anti").select("cluster", F.col("cx").alias("lon"), F.col("cy").alias("lat")))
    far = J.nearest(bare, candidates, "cluster", "candidate").select("cluster", "candidate").join(candidates, "candidate").select("cluster", F.struct(F.lit(0.0).alias("km"), F.col("candidate").alias("id"), "lon", "lat").alias("far"))
    out = own.select("cluster", "region").join(main, "cluster", "left").join(roof, "cluster", "left").join(inner, "cluster", "left").join(far, "cluster", "left")
    place = F.coalesce("roof", "inner", "far")
    index = F.when(F.col("roof").isNotNull(), F.col("roof.id")).when(F.col("inner").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("far.id"))
    return out.select("cluster", "region", F.coalesce("station_type", F.lit("charge_b")).alias("station_type"), index.alias("source_index"), place["lon"].alias("lon"), place["lat"].alias("lat")).where("lon is not null")


def charge_stations(spark, d):
    return stage(spark, d, "charge_stations", _make_charge_stations)


def _make_charge_stations(spark, d):
    """The flagship's stations, from the clusters, regions, rooftops and hulls found before."""
    return forced_stations(_centres(spark, d), cluster_regions(spark, d), roof_candidates(spark, d), candidate_hulls(spark, d), _members(spark, d))


def _kind(stations: DataFrame, kind: str, name: str) -> DataFrame:
    return stations.where(F.col("station_type") == kind).select(F.col("cluster").alias(name), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def trunk_of(a_stations: DataFrame, mode: str = "mst", extra: int = EXTRA, most_km: float = TRUNK_KM) -> DataFrame:
    """(a, b, weight, extra) over A stations (a, lon, lat): the least spanning tree of all pairs, or the two nearest each with
    the parts then joined by their shortest pairs; and the shortest missing links up to ``most_km``, at most ``extra`` a station."""
    nodes = checkpointed(a_stations)
    if mode == "mst":
        base = N.spanning_tree(nodes, "a")
    elif mode == "knn":
        ids, pairs = nodes.select(F.col("a").alias("node")), checkpointed(N.all_pairs(nodes, "a"))
        near = J.nearest(nodes, nodes.withColumnRenamed("a", "other"), "a", "other", 2, most_km, same=True)
        knn = near.select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b"), F.round("km", 6).alias("weight")).distinct()
        base = checkpointed(knn.unionByName(N.repairs(ids, knn, pairs)))
    else:
        raise ValueError(f"unknown topology {mode}")
    more = R.matching(N.near_pairs(nodes, "a", most_km).join(base, ["a", "b"], "left_anti"), extra) if extra else base.limit(0)
    return base.select("a", "b", "weight", F.lit(False).alias("extra")).union(more.select("a", "b", "weight", F.lit(True)))


def trunk_edges(spark, d):
    return stage(spark, d, "trunk_edges", _make_trunk_edges)


def _make_trunk_edges(spark, d):
    return trunk_of(_kind(charge_stations(spark, d), "charge_a", "a"))


def trunk_tree(spark, d):
    return trunk_of(_kind(charge_stations(spark, d), "charge_a", "a"), extra=0).select("a", "b", "weight")


def trunk_knn(spark, d):
    return trunk_of(_kind(charge_stations(spark, d), "charge_a", "a"), "knn", 0).select("a", "b", "weight")


def with_places(edges: DataFrame, stations: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    s = stations.select(key, "lon", "lat")
    out = edges.join(s.select(F.col(key).alias(a), F.col("lon").alias("ax"), F.col("lat").alias("ay")), a)
    return out.join(s.select(F.col(key).alias(b), F.col("lon").alias("bx"), F.col("lat").alias("by")), b)


def _walls(spark, d):
    z = S.zones(spark, d)
    return z, z.where("zone_kind in ('aerodrome', 'hospital')")


def trunk_lines(spark, d):
    return stage(spark, d, "trunk_lines", _make_trunk_lines)


def _make_trunk_lines(spark, d):
    """Every trunk edge with its mode and length: around all zones, else around those never flown over, else straight."""
    z, core = _walls(spark, d)
    s = charge_stations(spark, d).select("cluster", "lon", "lat")
    e = checkpointed(with_places(trunk_edges(spark, d), s, "cluster").withColumn("edge", F.col("a") * 1_000_000 + F.col("b")))
    lines = Z.with_modes(e.select("edge", "ax", "ay", "bx", "by"), Z.boxes_as_rings(z, "zone_id"), Z.boxes_as_rings(core, "zone_id"), "edge", S.rings(z, "zone_id"), S.rings(core, "zone_id"))
    return e.select("edge", "a", "b", "extra").join(lines, "edge")


def trunk_modes(spark, d):
    t = trunk_lines(spark, d)
    return t.select("a", "b", F.when(F.size("path") == 2, "straight").otherwise("around").alias("line"))


def branch_pairs(spark, d):
    s = charge_stations(spark, d)
    p = P.allowed_branches(_kind(s, "charge_b", "b"), _kind(s, "charge_a", "a"))
    return p.select("b", "a", F.round("km", 6).alias("km"))


def branches(spark, d):
    return stage(spark, d, "branches", _make_branches)


def _make_branches(spark, d):
    """B stations' links to A stations at the least total cost, with their lines."""
    z, _ = _walls(spark, d)
    s = charge_stations(spark, d)
    chosen = O.assign_pairs(branch_pairs(spark, d), 4)
    e = checkpointed(with_places(chosen, s.select("cluster", "lon", "lat"), "cluster", "b", "a").select("b", "a", "cost", "ax", "ay", "bx", "by"))
    r = Z.routed(e.select("b", "ax", "ay", "bx", "by"), Z.boxes_as_rings(z, "zone_id"), "b")
    return e.select("b", "a", "cost").join(Z.with_lines(e, r, "b"), "b").select("b", "a", "cost", F.round("km", 4).alias("weight_km"), "path")


def branch_edges(spark, d):
    return branches(spark, d).select("b", "a", "cost", "weight_km")


def local_pairs(spark, d):
    return stage(spark, d, "local_pairs", _make_local_pairs)


def _make_local_pairs(spark, d):
    """Each B station's two nearest others within the trunk's reach."""
    b = _kind(charge_stations(spark, d), "charge_b", "b")
    n = J.nearest(b, b.withColumnRenamed("b", "other"), "b", "other", 2, TRUNK_KM, same=True)
    return n.select(F.least("b", "other").alias("a"), F.greatest("b", "other").alias("b"), F.round("km", 6).alias("km")).distinct()


def local_lines(spark, d):
    """Links of near B stations that a safe route joins, the others are dropped."""
    z, _ = _walls(spark, d)
    e = with_places(local_pairs(spark, d), charge_stations(spark, d).select("cluster", "lon", "lat"), "cluster").withColumn("edge", F.col("a") * 1_000_000 + F.col("b"))
    e = checkpointed(e.select("edge", "a", "b", "ax", "ay", "bx", "by"))
    r = Z.routed(e, Z.boxes_as_rings(z, "zone_id"), "edge").where("path is not null")
    return e.select("edge", "a", "b").join(r, "edge")


def local_routes_clear(spark, d):
    """Whether the routes that were found run through no zone (shrunk by half a metre, for rounding)."""
    z, _ = _walls(spark, d)
    walls = S.rings(z.withColumns({"xmin": F.col("xmin") + 5e-6, "xmax": F.col("xmax") - 5e-6, "ymin": F.col("ymin") + 5e-6, "ymax": F.col("ymax") - 5e-6}), "zone_id")
    r = local_lines(spark, d)
    return Z.clear_routes(r, walls, "edge", "zone_id").groupBy("clear").agg(F.count("*").alias("n"))


def _garage_sites(spark, d):
    return stage(spark, d, "garage_sites", _make_garage_sites)


def _make_garage_sites(spark, d):
    g = O.workshop_candidates(S.buildings(spark, d), S.landuses(spark, d)).where("building_id is not null")
    return g.select("building_id").join(S.buildings(spark, d).select("building_id", "lon", "lat"), "building_id").select(F.col("building_id").alias("candidate"), "lon", "lat")


def _demand(spark, d):
    return _centres(spark, d).select(F.col("cluster").alias("demand"), "lon", "lat", "weight")


def garages(spark, d):
    return stage(spark, d, "garages", _make_garages)


def _make_garages(spark, d):
    """One garage to three A stations, greedily by the demand it reaches."""
    n = charge_stations(spark, d).where("station_type = 'charge_a'").count()
    return O.place_n(_garage_sites(spark, d), _demand(spark, d), max(1, -(-n // 3)), W.FACILITY_KM, W.SEPARATION_KM)


def garage_medians(spark, d):
    return P.medians(_garage_sites(spark, d), _demand(spark, d), 3, W.FACILITY_KM)


def garage_cover(spark, d):
    return P.cover(_garage_sites(spark, d), _demand(spark, d), W.FACILITY_KM, 0.5, 2 * W.FACILITY_KM, 8)


def trunk_betweenness(spark, d):
    e = trunk_edges(spark, d)
    nodes = charge_stations(spark, d).where("station_type = 'charge_a'").select(F.col("cluster").alias("node"))
    return P.betweenness(nodes, e.select("a", "b", "weight")).select("node", F.round("betweenness", 9).alias("betweenness"))


def workshops(spark, d):
    """Service sites by the betweenness of their nearest trunk node."""
    nodes = _kind(charge_stations(spark, d), "charge_a", "node")
    return P.workshops_by_rank(_garage_sites(spark, d), nodes, trunk_betweenness(spark, d), 3, W.FACILITY_KM)


def coverage_stations(spark, d):
    """The unforced way: A stations by core demand, B stations by what is left."""
    candidates = N.best_per_key(roof_candidates(spark, d).join(S.buildings(spark, d).select(F.col("building_id").alias("candidate"), "hotspot_id"), "candidate"), "hotspot_id", "candidate").select("candidate", "lon", "lat")
    return P.charge_by_coverage(candidates, _demand(spark, d), W.CHARGE_KM, 0.2, 0.3, 10)


def core_threshold(spark, d):
    return P.core(_demand(spark, d)).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("least", 4).alias("least"))


def ab_spacing(spark, d):
    """Hotspots far enough from the stations that stand, by the rule of each type."""
    h = S.hotspots(spark, d).join(F.broadcast(P.core(_demand(spark, d)).select(F.col("lon").alias("mx"), F.col("lat").alias("my"))))  # one row
    h = h.withColumn("to_core", G.haversine_km(F.col("lat"), F.col("lon"), F.col("my"), F.col("mx")))
    chosen = S.hotspots(spark, d).where("hotspot_id % 10 = 0")
    near = J.nearest(h.select("hotspot_id", "lon", "lat"), chosen.withColumnRenamed("hotspot_id", "chosen"), "hotspot_id", "chosen").select("hotspot_id", "km")
    j = h.join(near, "hotspot_id")
    rule = {k: F.col("km") >= P.spacing(k, 4.0, F.col("to_core"), a=1.2, core_a=0.7, core_radius=2.0, b=0.65) for k in ("charge_a", "charge_b")}
    return j.select("hotspot_id", *[x.alias(k) for k, x in rule.items()])


def reserve_station(spark, d):
    h = S.hotspots(spark, d).withColumnRenamed("hotspot_id", "candidate")
    demand = _demand(spark, d)
    m = P.core(demand).first()
    places = h.select("candidate", G.haversine_km(F.col("lat"), F.col("lon"), F.lit(m["lat"]), F.lit(m["lon"])).alias("to_core"))
    pairs = P.coverage_pairs(h, demand, W.CHARGE_KM).withColumn("core", F.col("weight") >= m["least"])
    return P.reserve(places, pairs).select("candidate", F.round("gain", 3).alias("gain"))


def facility_links(spark, d):
    """Garages' lines to their nearest A station."""
    g = garages(spark, d).select("candidate").join(_garage_sites(spark, d), "candidate").select(F.col("candidate").alias("facility"), F.lit("garage").alias("kind"), "lon", "lat")
    return P.facility_branches(g, _kind(charge_stations(spark, d), "charge_a", "a"))


def nearest_a(spark, d):
    """Every garage site with its nearest A station."""
    g = _garage_sites(spark, d).select(F.col("candidate").alias("facility"), F.lit("garage").alias("kind"), "lon", "lat")
    return P.facility_branches(g, _kind(charge_stations(spark, d), "charge_a", "a")).select("facility", "a", F.round("km", 6).alias("km"))


def hull_of_station(spark, d):
    """Zone centres as stations: forced for every fifth, else by hull, else by the nearest middle."""
    z = S.zones(spark, d).select(F.col("zone_id").alias("station"), ((F.col("xmin") + F.col("xmax")) / 2).alias("lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("lat"), F.when(F.col("zone_id") % 5 == 0, F.col("zone_id")).alias("cluster"))
    return P.station_hulls(z, _members(spark, d).select("cluster", "lon", "lat"), HULL_KM)


def station_points(spark, d):
    """Stations of all kinds as rows of one table, those with a cluster only: garages and workshops have none."""
    s = charge_stations(spark, d).select("cluster", "station_type", "lon", "lat")
    g = garages(spark, d).select("candidate").join(_garage_sites(spark, d), "candidate").select(F.lit("garage").alias("station_type"), "lon", "lat")
    return s.unionByName(g, allowMissingColumns=True).where("cluster is not null").select("cluster", "station_type")


def station_layers(spark, d) -> dict[str, DataFrame]:
    """A and B stations with the levels they serve, the best station per cluster, and the trunk's and branches' lines."""
    s = checkpointed(charge_stations(spark, d))
    levels = F.array(*[F.lit(i) for i in range(1, len(B.ALTITUDES_M) + 1)])
    return {
        "charge_a": s.where("station_type = 'charge_a'").withColumn("levels", levels),
        "charge_b": s.where("station_type = 'charge_b'").withColumn("levels", levels),
        "centroids": N.best_per_key(_centres(spark, d), "cluster", F.desc("weight")),
        "trunk": trunk_lines(spark, d),
        "branches": branches(spark, d),
        "local": local_lines(spark, d),
        "facility_branches": facility_links(spark, d),
    }


def layer_stations(spark, d):
    """Stations of both layers by flight level."""
    s = charge_stations(spark, d).withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(1, len(B.ALTITUDES_M) + 1)])))
    return s.groupBy("station_type", "level").agg(F.count("*").alias("n"), F.sum("cluster").alias("checksum"))


def edge_properties(spark, d):
    """Local edges with the flags of the stations at their ends."""
    a = _kind(charge_stations(spark, d), "charge_a", "a").select(F.col("a").alias("station"))
    e = W._local_edges(spark, d).select("edge_id", "a", "b")
    at = [e.join(a.withColumnRenamed("station", x), x, "left_semi").select("edge_id", F.lit(True).alias(f"station_{x}")) for x in ("a", "b")]
    e = e.join(at[0], "edge_id", "left").join(at[1], "edge_id", "left")
    flags = [F.coalesce(f"station_{x}", F.lit(False)) for x in ("a", "b")]
    return e.select("edge_id", F.concat_ws("|", F.sort_array(F.array(F.col("a").cast("string"), F.col("b").cast("string")))).alias("pair"), flags[0].alias("station_a"), flags[1].alias("station_b"), (flags[0] | flags[1]).alias("connects_station"), F.lit("local").alias("edge_type"), F.col("a").alias("source"), F.col("b").alias("target"))


def cluster_link_bridges(spark, d):
    """Links that join the parts of each hotspot's sites: the shortest clear ones up to 600 m, given those up to 250 m."""
    s = W.lex_chunks(spark, d, 12).withColumn("site", F.col("hotspot_id") * 1000 + F.col("chunk")).select("site", "hotspot_id", "lon", "lat")
    p = J.within_km(s, s, 0.6, "site", "site").where("l_hotspot_id = r_hotspot_id and l_site < r_site")
    p = checkpointed(p.select(F.col("l_site").alias("a"), F.col("r_site").alias("b"), F.round("km", 6).alias("weight"), F.col("l_lon").alias("ax"), F.col("l_lat").alias("ay"), F.col("r_lon").alias("bx"), F.col("r_lat").alias("by"), (F.col("l_site") * 1_000_000 + F.col("r_site")).alias("edge")))
    safe = p.join(J.blocked_segments(p, S.rings(S.zones(spark, d), "zone_id"), "edge", "zone_id").select("edge").distinct(), "edge", "left_anti").select("a", "b", "weight")
    have = safe.where("weight <= 0.25")
    return N.repairs(s.select(F.col("site").alias("node")), have.select("a", "b", "weight"), safe).select("a", "b", F.col("weight").alias("km"))


def placement_totals(spark, d):
    """One row of metrics of the composed placement."""
    s = checkpointed(charge_stations(spark, d))
    served = _centres(spark, d).join(s.select("cluster"), "cluster", "left_semi").agg(F.sum("weight").alias("served"))
    total = _centres(spark, d).agg(F.sum("weight").alias("total"))
    counts = s.agg(F.count_if(F.col("station_type") == "charge_a").alias("charge_a"), F.count_if(F.col("station_type") == "charge_b").alias("charge_b"), F.count_if(F.col("source_index") < 0).alias("interior"), F.count_distinct("region").alias("regions"))
    trunk = trunk_edges(spark, d).where("not extra").agg(F.count("*").alias("trunk_edges"), F.round(F.sum("weight"), 4).alias("trunk_km"))
    # one-row tables
    one = counts.join(F.broadcast(served)).join(F.broadcast(total)).join(F.broadcast(trunk))
    return one.select("charge_a", "charge_b", "interior", "regions", F.round(F.col("served") / F.col("total"), 9).alias("ratio"), "trunk_edges", "trunk_km", (F.col("trunk_edges") == F.col("charge_a") - 1).alias("connected"))


_D = W._D
_RC = "rc as (select hotspot_id as cluster, round(weight, 3) as weight, round(lon, 6) as lon, round(lat, 6) as lat from cl)"
# heaviest first, each takes the nearest four that are left; the state of a step is the list of those taken
_PACK = """everyone as (select list(struct_pack(id := cluster, w := weight, x := lon, y := lat) order by weight desc, cluster) as c from rc),
pack as (select 0 as i, []::bigint[] as used, []::bigint[] as members union all
 select i + 1, list_concat(used, m), m from (select i, used, list_transform(list_slice(list_sort(list_transform(f, lambda z: struct_pack(d := round(pow(sin(radians(z.y - f[1].y) / 2), 2) + cos(radians(z.y)) * cos(radians(f[1].y)) * pow(sin(radians(z.x - f[1].x) / 2), 2), 15), id := z.id))), 1, 5), lambda z: z.id) as m
 from (select i, used, list_filter(everyone.c, lambda z: not list_contains(used, z.id)) as f from pack, everyone) where len(f) > 0)),
region as (select unnest(members) as cluster, concat('nearest_', i - 1) as region from pack where i > 0)"""
_ROOF = f"""roof as (select building_id as candidate, lon, lat from building b where lower(trim(building)) in ('apartments', 'dormitory') and not exists (select 1 from zone where b.lon > xmin and b.lon < xmax and b.lat > ymin and b.lat < ymax)),
member as (select hotspot_id as cluster, building_id, lon, lat from demand b where case when btag = '' then 'yes' else btag end in {_list(B.DEMAND_TAGS)} and not exists (select 1 from zone where b.lon > xmin and b.lon < xmax and b.lat > ymin and b.lat < ymax)),
inhull as (select candidate, min(cluster) as cluster from roof a join member b on b.lat between a.lat - 0.0006 and a.lat + 0.0006 and b.lon between a.lon - 0.001 and a.lon + 0.001 and {W.km('a', 'b')} <= {HULL_KM} group by candidate having count(distinct cluster) = 1)"""
_STATION = f"""mid as (select region, sum(lon * weight) / sum(weight) as lon, sum(lat * weight) / sum(weight) as lat from rc join region using (cluster) group by region),
main as (select cluster from (select cluster, row_number() over (partition by region order by round({W.km('mid', 'rc')}, 6), rc.weight desc, cluster) as r from rc join region using (cluster) join mid using (region)) where r = 1),
ownroof as (select cluster, min(struct_pack(km := round({W.km('rc', 'roof')}, 6), id := candidate, lon := roof.lon, lat := roof.lat)) as p from roof join inhull using (candidate) join rc using (cluster) group by cluster),
ownmember as (select cluster, min(struct_pack(km := round({W.km('rc', 'member')}, 6), id := building_id, lon := member.lon, lat := member.lat)) as p from member join rc using (cluster) group by cluster),
station as (select cluster, region, case when cluster in (select cluster from main) then 'charge_a' else 'charge_b' end as station_type, case when ownroof.p is not null then ownroof.p.id else -1 end as source_index,
 coalesce(ownroof.p.lon, ownmember.p.lon) as lon, coalesce(ownroof.p.lat, ownmember.p.lat) as lat from rc join region using (cluster) left join ownroof using (cluster) left join ownmember using (cluster)),
sa as (select cluster as id, round(lon, 7) as lon, round(lat, 7) as lat from station where station_type = 'charge_a'), sb as (select cluster as id, round(lon, 7) as lon, round(lat, 7) as lat from station where station_type = 'charge_b')"""
_GARAGE = f"gsite as (select distinct building_id as candidate, lon, lat from building b join landuse on lon > xmin and lon < xmax and lat > ymin and lat < ymax where lower(trim(building)) in {_list(B.WORKSHOP_TAGS)} and lower(trim(building)) not in {_list(B.NOT_WORKSHOP_TAGS)} and area_m2 >= case lower(trim(building)) when 'garage' then 20 when 'garages' then 60 else 250 end)"
_CORE = "core as (select sum(lon * weight) / sum(weight) as lon, sum(lat * weight) / sum(weight) as lat, quantile_cont(weight, 0.5) as least_weight from rc)"
def tree_sql(pairs: str) -> str:
    """pair (a, b, weight) -> tree: an edge is in the least spanning forest if no way over smaller edges joins its ends."""
    return f"""pair as ({pairs}), ranked as (select *, row_number() over (order by weight, a, b) as r from pair),
twoway as (select a as x, b as y, r from ranked union all select b, a, r from ranked),
reached as (select r, a as node from ranked union select reached.r, twoway.y from reached join twoway on twoway.x = reached.node and twoway.r < reached.r),
tree as (select a, b, weight from ranked e where not exists (select 1 from reached w where w.r = e.r and w.node = e.b))"""


_TREE = tree_sql(f"select a.id as a, b.id as b, round({W.km('a', 'b')}, 6) as weight from sa a, sa b where a.id < b.id")


def staged(body: str, *more: str) -> str:
    return "with recursive " + ", ".join(S.CTES.get(c, c) for c in (*_D, "zone", W._CL, _RC, _PACK, *more)) + " " + body


QUERIES = {
    "cluster_regions": (cluster_regions, staged("select cluster, region from region")),
    "candidate_hulls": (candidate_hulls, sql("select candidate, cluster from inhull", *_D, "zone", _ROOF)),
    "charge_stations": (charge_stations, staged("select * from station", _ROOF, _STATION)),
    "branch_pairs": (branch_pairs, staged(f"select distinct b, a, km from (select b.id as b, a.id as a, round({W.km('a', 'b')}, 6) as km, row_number() over (partition by a.id order by {W.km('a', 'b')}, b.id) as ra, row_number() over (partition by b.id order by {W.km('b', 'a')}, a.id) as rb from sa a, sb b) where ra <= 4 or rb = 1", _ROOF, _STATION)),
    "local_pairs": (local_pairs, staged(f"select distinct least(x, y) as a, greatest(x, y) as b, round(km, 6) as km from (select a.id as x, b.id as y, {W.km('a', 'b')} as km, row_number() over (partition by a.id order by {W.km('a', 'b')}, b.id) as r from sb a, sb b where a.id <> b.id) where r <= 2 and km <= {TRUNK_KM}", _ROOF, _STATION)),
    "nearest_a": (nearest_a, staged(f"select facility, a, round(km, 6) as km from (select f.candidate as facility, a.id as a, {W.km('f', 'a')} as km, row_number() over (partition by f.candidate order by {W.km('f', 'a')}, a.id) as r from gsite f, sa a) where r = 1", "landuse", _ROOF, _STATION, _GARAGE)),
    "hull_of_station": (hull_of_station, sql(f"select z.zone_id as station, coalesce(case when z.zone_id % 5 = 0 then z.zone_id end, h.cluster, m.cluster) as cluster from centre z left join (select zone_id, cluster from (select z.zone_id, b.cluster, row_number() over (partition by z.zone_id order by round({W.km('z', 'b')}, 6), b.cluster) as r from centre z join member b on {W.km('z', 'b')} <= {HULL_KM}) where r = 1) h using (zone_id) left join (select zone_id, cluster from (select z.zone_id, b.cluster, row_number() over (partition by z.zone_id order by {W.km('z', 'b')}, b.cluster) as r from centre z, middle b) where r = 1) m using (zone_id)", *_D, "zone", _ROOF, "centre as (select zone_id, (xmin + xmax) / 2 as lon, (ymin + ymax) / 2 as lat from zone)", "middle as (select cluster, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from member group by cluster)")),
    "station_points": (station_points, staged("select cluster, station_type from station", _ROOF, _STATION)),
    "layer_stations": (layer_stations, staged("select station_type, cast(level as integer) as level, count(*) as n, cast(sum(cluster) as bigint) as checksum from station, range(1, 6) l(level) group by station_type, level", _ROOF, _STATION)),
    "edge_properties": (edge_properties, staged("select edge_id, case when cast(a as varchar) <= cast(b as varchar) then concat(a, '|', b) else concat(b, '|', a) end as pair, a in (select id from sa) as station_a, b in (select id from sa) as station_b, a in (select id from sa) or b in (select id from sa) as connects_station, 'local' as edge_type, a as source, b as target from seg", _ROOF, _STATION, W._SEG)),
    "core_threshold": (core_threshold, sql("select round(lon, 6) as lon, round(lat, 6) as lat, round(least_weight, 4) as least from core", *_D, W._CL, _RC, _CORE)),
    "ab_spacing": (ab_spacing, sql(f"select hotspot_id, km >= 4 * case when to_core <= 8 then 0.7e0 else 1.2e0 end as charge_a, km >= 4 * 0.65e0 as charge_b from (select h.hotspot_id, {W.km('h', 'core')} as to_core, (select min({W.km('h', 'c')}) from hotspot c where c.hotspot_id % 10 = 0) as km from hotspot h, core)", *_D, W._CL, _RC, _CORE)),
    "reserve_station": (reserve_station, sql(f"select h.hotspot_id as candidate, round((select coalesce(sum(weight), 0) from rc where weight >= least_weight and {W.km('h', 'rc')} <= {W.CHARGE_KM}), 3) as gain from hotspot h, core order by 2 desc, {W.km('h', 'core')}, 1 limit 1", *_D, W._CL, _RC, _CORE)),
    "trunk_tree": (trunk_tree, staged("select a, b, weight from tree", _ROOF, _STATION, _TREE)),
    "trunk_edges": (trunk_edges, None),
    "trunk_knn": (trunk_knn, None),
    "trunk_modes": (trunk_modes, None),
    "branch_edges": (branch_edges, None),
    "local_routes_clear": (local_routes_clear, None),
    "garages": (garages, None),
    "garage_medians": (garage_medians, None),
    "garage_cover": (garage_cover, None),
    "trunk_betweenness": (trunk_betweenness, None),
    "workshops": (workshops, None),
    "coverage_stations": (coverage_stations, None),
    "cluster_link_bridges": (cluster_link_bridges, None),
    "placement_totals": (placement_totals, staged("select (select count(*) from sa) as charge_a, (select count(*) from sb) as charge_b, (select count(*) from station where source_index < 0) as interior, (select count(distinct region) from station) as regions, round((select sum(weight) from rc where cluster in (select cluster from station)) / (select sum(weight) from rc), 9) as ratio, (select count(*) from tree) as trunk_edges, round((select sum(weight) from tree), 4) as trunk_km, (select count(*) from tree) = (select count(*) from sa) - 1 as connected", _ROOF, _STATION, _TREE)),
}
