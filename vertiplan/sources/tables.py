"""City tables. A city is a folder of Parquet tables; the rules here derive one from a star schema, so
that every operator can run on the driver's data: suppliers are hotspots, orders are buildings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOTSPOT = """s_suppkey as hotspot_id, 36.80e0 + (s_suppkey % 32) * 0.04e0 as lon, 55.20e0 + floor(s_suppkey / 32) * 0.03e0 as lat"""

BUILDING = """o_orderkey as building_id, o_orderkey % n as hotspot_id,
36.80e0 + (o_orderkey % n % 32) * 0.04e0 + (cast(o_orderkey * 7919 % 10007 as double) / 10007 - 0.5e0) * (case when o_orderkey % 50 = 0 then 0.30e0 else 0.02e0 end) as lon,
55.20e0 + floor((o_orderkey % n) / 32) * 0.03e0 + (cast(o_orderkey * 104729 % 10009 as double) / 10009 - 0.5e0) * (case when o_orderkey % 50 = 0 then 0.20e0 else 0.012e0 end) as lat,
case o_orderkey % 13 when 0 then 'apartments' when 1 then 'house' when 2 then 'yes' when 3 then 'Retail ' when 4 then 'office' when 5 then 'residential' when 6 then 'warehouse' when 7 then 'garages' when 8 then 'dormitory' when 9 then 'school' when 11 then 'apartments' when 12 then 'industrial' end as building,
case o_orderkey % 7 when 0 then cast(o_orderkey % 25 + 1 as varchar(20)) when 1 then concat(cast(o_orderkey % 12 + 1 as varchar(20)), ',0') when 2 then 'n/a' end as building_levels,
case o_orderkey % 11 when 0 then concat(cast(o_orderkey % 160 + 3 as varchar(20)), ' m') when 1 then concat(cast(o_orderkey % 90 + 10 as varchar(20)), 'ft') when 2 then 'tall' end as height,
case when o_orderkey % 23 = 0 then cast(o_orderkey % 5 as varchar(20)) end as entrances,
case when o_orderkey % 37 = 0 then 'clinic' end as amenity, case when o_orderkey % 41 = 0 then 'bakery' end as shop,
cast(20 + o_orderkey * 31 % 4000 as double) as area_m2"""

ZONE = """s_suppkey as zone_id, case s_suppkey % 4 when 0 then 'park' when 1 then 'school' when 2 then 'aerodrome' else 'hospital' end as zone_kind,
36.80e0 + (s_suppkey % 32) * 0.04e0 + 0.004e0 as xmin, 36.80e0 + (s_suppkey % 32) * 0.04e0 + 0.008e0 as xmax,
55.20e0 + floor(s_suppkey / 32) * 0.03e0 + 0.002e0 as ymin, 55.20e0 + floor(s_suppkey / 32) * 0.03e0 + 0.005e0 as ymax"""

LANDUSE = """s_suppkey as landuse_id, case s_suppkey % 3 when 0 then 'industrial' when 1 then 'garages' else 'brownfield' end as landuse,
36.80e0 + (s_suppkey % 32) * 0.04e0 - 0.009e0 as xmin, 36.80e0 + (s_suppkey % 32) * 0.04e0 + 0.003e0 as xmax,
55.20e0 + floor(s_suppkey / 32) * 0.03e0 - 0.005e0 as ymin, 55.20e0 + floor(s_suppkey / 32) * 0.03e0 + 0.001e0 as ymax"""

DISTRICT = """cast(floor(s_suppkey % 32 / 8) + 4 * floor(s_suppkey / 128) as bigint) as district_id, cast(6 + s_suppkey % 7 as varchar(20)) as admin_level,
36.78e0 + floor(s_suppkey % 32 / 8) * 0.32e0 as xmin, 36.78e0 + floor(s_suppkey % 32 / 8) * 0.32e0 + 0.32e0 as xmax,
55.185e0 + floor(s_suppkey / 128) * 0.12e0 as ymin, 55.185e0 + floor(s_suppkey / 128) * 0.12e0 + 0.12e0 as ymax"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(text: str) -> str:
    return text.replace("varchar(20)", "string")


def _selected(df: DataFrame, text: str) -> DataFrame:
    view = f"_source_{abs(hash(text)) % 10**9}"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"select {_spark_sql(text)} from {view}")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hotspot_id, lon, lat)"""
    return _selected(table(spark, sf_dir, "supplier").select("s_suppkey"), HOTSPOT)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(building_id, hotspot_id, lon, lat, building, building_levels, height, entrances, amenity, shop, area_m2)"""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return _selected(table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(n)), BUILDING)


def rectangles(spark: SparkSession, sf_dir: str, text: str, where: str = "true") -> DataFrame:
    return _selected(table(spark, sf_dir, "supplier").select("s_suppkey").where(where), text)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, zone_kind, xmin, xmax, ymin, ymax)"""
    return rectangles(spark, sf_dir, ZONE, "s_suppkey % 3 = 0")


def landuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangles(spark, sf_dir, LANDUSE, "s_suppkey % 4 = 0")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hotspot: names repeat until the source keeps the first of each (see sources.osm)."""
    return rectangles(spark, sf_dir, DISTRICT)


def rings(rects: DataFrame, key: str) -> DataFrame:
    """Rectangles as polygon edges (key, part_id, ring_id, seq, x1, y1, x2, y2)."""
    corners = "array(struct(xmin as x, ymin as y), struct(xmax as x, ymin as y), struct(xmax as x, ymax as y), struct(xmin as x, ymax as y))"
    at = rects.select(key, F.expr(corners).alias("c")).select(key, "c", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    end = "c[(seq + 1) % 4]"
    return at.selectExpr(key, "0 as part_id", "0 as ring_id", "seq", "c[seq].x as x1", "c[seq].y as y1", f"{end}.x as x2", f"{end}.y as y2")


#: The same tables for another engine.
CTES = {
    "hotspot": f"hotspot as (select {HOTSPOT} from supplier)",
    "building": f"building as (select {BUILDING} from orders, (select count(*) as n from supplier))",
    "zone": f"zone as (select {ZONE} from supplier where s_suppkey % 3 = 0)",
    "landuse": f"landuse as (select {LANDUSE} from supplier where s_suppkey % 4 = 0)",
    "district": f"district as (select {DISTRICT} from supplier)",
}
