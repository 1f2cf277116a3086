"""Sources over tagged map features, the city catalog, and GeoJSON sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertiplan.functions.geo import haversine_km
from vertiplan.sources.tables import table

ROAD_KINDS = ("trunk", "primary", "secondary", "tertiary")

# Tags that make a no-fly zone, in order of precedence.
ZONE_RULES = (
    ("aerodrome", "aeroway in ('aerodrome', 'airport', 'heliport', 'helipad')"),
    ("military", "military is not null or landuse = 'military'"),
    ("nuclear", "power = 'nuclear' or nuclear is not null"),
    ("power_plant", "power in ('plant', 'station') or man_made = 'hydroelectric_plant'"),
    ("government", "office = 'government' or building = 'government'"),
    ("drone_ban", "drone = 'no'"),
    ("park", "leisure = 'park'"),
    ("recreation", "landuse = 'recreation_ground'"),
    ("school", "amenity in ('school', 'kindergarten', 'university', 'college') or building in ('college', 'school')"),
    ("hospital", "amenity = 'hospital'"),
    ("clinic", "amenity = 'clinic' or healthcare = 'clinic'"),
    ("fuel", "amenity = 'fuel'"),
    ("station", "railway = 'station'"),
)
ALWAYS_BUFFERED = ("aerodrome", "military", "nuclear", "government", "drone_ban")
BUFFER_DEGREES, SEARCH_DEGREES, SUBSTATION_DEGREES = 0.0002, 0.0005, 0.00045
TAGS = ("aeroway", "military", "landuse", "power", "nuclear", "man_made", "office", "building", "drone", "leisure", "amenity", "healthcare", "railway")


def conform(df: DataFrame, columns: tuple[str, ...] = TAGS) -> DataFrame:
    """df with every missing optional tag as a null string, and NaN or blank texts as null."""
    for c in columns:
        df = df.withColumn(c, F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string"))
    return df


def zone_kinds(features: DataFrame) -> DataFrame:
    """Features that are no-fly zones, with zone_kind and buffered; one scan for all rules."""
    kind = F.coalesce(*[F.when(F.expr(rule), name) for name, rule in ZONE_RULES])
    f = conform(features).withColumn("zone_kind", kind).where("zone_kind is not null")
    return f.withColumn("buffered", F.col("zone_kind").isin(*ALWAYS_BUFFERED))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged features derived from the part table."""
    k = "p_partkey"
    return table(spark, sf_dir, "part").selectExpr(f"{k} as feature_id", f"case {k} % 17 when 0 then 'heliport' when 1 then 'apron' end as aeroway", f"case {k} % 17 when 2 then 'park' when 3 then 'pitch' end as leisure", f"case {k} % 17 when 4 then 'school' when 5 then 'clinic' when 6 then 'fuel' when 7 then 'cafe' end as amenity", f"case {k} % 19 when 0 then 'military' when 1 then 'recreation_ground' end as landuse", f"case {k} % 23 when 0 then 'plant' when 1 then 'nuclear' end as power", f"case {k} % 29 when 0 then 'station' end as railway")


def roads(edges: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, centre: tuple[float, float] | None = None, radius_km: float = 10.0) -> DataFrame:
    """Road edges (highway, lon, lat, ...) of the network's kinds inside a box, else within ``radius_km`` of ``centre`` if one is
    given; an empty result is an error."""
    own = edges.where(F.col("highway").isin(*ROAD_KINDS))
    found = own.where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))
    if centre is not None and found.isEmpty():
        found = own.where(haversine_km(F.lit(centre[1]), F.lit(centre[0]), F.col("lat"), F.col("lon")) <= radius_km)
    if found.isEmpty():
        raise ValueError("no roads in the box")
    return found


def zone_shapes(zones: DataFrame, buildings: DataFrame) -> DataFrame:
    """Point zones (feature_id, zone_kind, buffered, lon, lat) -> (feature_id, zone_kind, shape, building_id, radius): the footprint
    of the nearest building within SEARCH_DEGREES, else a circle of BUFFER_DEGREES; buffered kinds are circles always."""
    cell = lambda c: F.floor(F.col(c) / SEARCH_DEGREES)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> named_struct('i', i, 'j', j))))"))
    near = zones.where("not buffered").select("feature_id", "lon", "lat", around.alias("o")).select("feature_id", "lon", "lat", (cell("lon") + F.col("o.i")).alias("cx"), (cell("lat") + F.col("o.j")).alias("cy"))
    b = buildings.select("building_id", F.col("lon").alias("bx"), F.col("lat").alias("by"), cell("lon").alias("cx"), cell("lat").alias("cy"))
    far = F.sqrt((F.col("bx") - F.col("lon")) ** 2 + (F.col("by") - F.col("lat")) ** 2)
    best = near.join(b, ["cx", "cy"]).withColumn("far", far).where(F.col("far") <= SEARCH_DEGREES).groupBy("feature_id").agg(F.min(F.struct("far", "building_id"))["building_id"].alias("building_id"))
    out = zones.join(best, "feature_id", "left")
    return out.select("feature_id", "zone_kind", F.when(F.col("building_id").isNull(), "circle").otherwise("building").alias("shape"), "building_id", F.when(F.col("building_id").isNull(), BUFFER_DEGREES).alias("radius"))


def boundary(polygon: DataFrame | None, districts: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """The city's ring (seq, lon, lat): the given polygon, else the largest district (district_id, seq, lon, lat,
    area), else the convex hull of the nodes (lon, lat), their box where that is no area."""
    if polygon is not None and not polygon.isEmpty():
        return polygon.select("seq", "lon", "lat")
    if districts is not None and not districts.isEmpty():
        largest = districts.orderBy(F.desc("area"), "district_id").first()["district_id"]
        return districts.where(F.col("district_id") == largest).select("seq", "lon", "lat")
    hull = convex_hull(nodes)
    return hull if hull.count() > 2 else box_ring(nodes)


def box_ring(points: DataFrame) -> DataFrame:
    """(seq, lon, lat) of the corners of the points' box, counter-clockwise."""
    box = points.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).where("x0 is not null")
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return box.select(F.posexplode(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))).alias("seq", "p")).select("seq", "p.lon", "p.lat")


def convex_hull(points: DataFrame) -> DataFrame:
    """(seq, lon, lat) counter-clockwise. Every partition first reduces its points to their own hull."""

    def hull(f: pd.DataFrame) -> pd.DataFrame:
        p = sorted({(float(x), float(y)) for x, y in zip(f["lon"], f["lat"], strict=True)})

        def half(points):
            out: list[tuple[float, float]] = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        ring = p if len(p) < 3 else half(p)[:-1] + half(p[::-1])[:-1]
        return pd.DataFrame({"seq": range(len(ring)), "lon": [q[0] for q in ring], "lat": [q[1] for q in ring]})

    def partial(frames):
        for f in frames:
            yield hull(f)

    few = points.select("lon", "lat").where("lon is not null and lat is not null").mapInPandas(partial, "seq int, lon double, lat double")
    return few.withColumn("city", F.lit(0)).groupBy("city").applyInPandas(hull, "seq int, lon double, lat double")


def admin_districts(districts: DataFrame) -> DataFrame:
    """Districts of levels 6 to 10, the first level of each."""
    d = districts.where(F.col("admin_level").try_cast("int").between(6, 10))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("district_id").orderBy("admin_level"))).where("_n = 1").drop("_n")


def substations(features: DataFrame) -> DataFrame:
    """(feature_id, lon, lat, radius) of substations."""
    return features.where("power = 'substation'").select("feature_id", "lon", "lat", F.lit(SUBSTATION_DEGREES).alias("radius"))


def placement_key(parameters: DataFrame, version: int = 44) -> DataFrame:
    """(key): SHA-1 of the parameters as JSON with sorted names."""
    j = F.to_json(F.struct(*sorted(parameters.columns)))
    return parameters.select(F.concat(F.lit("placement:"), F.sha1(j.cast("binary")), F.lit(f":{version}")).alias("key"))


def geojson(points: DataFrame, key: str) -> DataFrame:
    """(key, feature): one GeoJSON feature per row with coordinates, numbers rounded to 6 places."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"))
    rest = F.struct(*[c for c in points.columns if c not in ("lon", "lat")])
    return points.where("lon is not null and lat is not null").select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), rest.alias("properties"))).alias("feature"))


def geojson_lines(edges: DataFrame, path: str = "path") -> DataFrame:
    """(feature) of edges (a, b, weight, mode, ax, ay, bx, by, path array<struct<lon,lat>>); straight without a path."""
    line = F.coalesce(F.transform(path, lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6))), F.array(F.array(F.round("ax", 6), F.round("ay", 6)), F.array(F.round("bx", 6), F.round("by", 6))))
    return edges.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.round("weight", 6).alias("weight_km"), "mode").alias("properties"))).alias("feature"))


class CityCatalog:
    """Parquet tables of a city under a folder; the key holds every parameter that the tables depend on."""

    def __init__(self, spark: SparkSession, folder: str, **parameters: object) -> None:
        self.spark = spark
        self.path = "/".join([folder.rstrip("/"), *(f"{k}={v}" for k, v in sorted(parameters.items()))])

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def cached(self, name: str, make, refresh: bool = False) -> DataFrame:
        found = None if refresh else self.load(name)
        if found is None:
            self.save(name, make())
            found = self.load(name)
        return found
