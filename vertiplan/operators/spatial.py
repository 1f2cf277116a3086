"""Spatial joins and predicates without a geometry library.

Points and boxes are dealt to cells of a lattice, cells are joined by equality, and the exact
predicate filters what meets: a distance or containment join thus shuffles on cells and never
becomes a nested loop. Polygons are tables of edges (poly_id, part_id, ring_id, seq, x1, y1, x2, y2);
a union is the set of its parts, a hole is one more ring: crossings are counted over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertiplan.functions.geo import haversine_km
from vertiplan.session import checkpointed

_EARTH_KM = 6371.0


def _on_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Kilometres along three axes: nothing is special about the poles or the date line."""
    r = _EARTH_KM * F.cos(F.radians(lat))
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon)), _EARTH_KM * F.sin(F.radians(lat))


def within_km(left: DataFrame, right: DataFrame, km: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs (left columns l_*, right columns r_*, km) of points (lon, lat) at most ``km`` apart.

    Space is dealt to cubes twice ``km`` wide. A left point is in one; a right point is in those that come within
    ``km`` of it, at most eight and three and a half on average. Points without coordinates match nothing.
    """
    side, reach = 2 * km, km * (1 + 1e-9) + 1e-9
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).where("l_lon is not null and l_lat is not null")
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_lon is not null and r_lat is not null")
    for name, at in zip(("_cx", "_cy", "_cz"), _on_sphere(F.col("l_lon"), F.col("l_lat")), strict=True):
        a = a.withColumn(name, F.floor(at / side))
    for name, at in zip(("_cx", "_cy", "_cz"), _on_sphere(F.col("r_lon"), F.col("r_lat")), strict=True):
        b = b.withColumn(name, F.explode(F.sequence(F.floor((at - reach) / side), F.floor((at + reach) / side))))
    d = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return a.join(b, ["_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz").withColumn("km", d).where(F.col("km") <= km)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 1, km: float | None = None, same: bool = False) -> DataFrame:
    """(left_id, right_id, km, rank): the k nearest right points of each left point, ties to the smaller
    right_id; ``same`` leaves out equal ids of a self-join.

    With ``km`` only points within it count. Without it the search radius doubles until every left
    point has k neighbours or the radius spans the globe; only points still short are searched again.
    """
    left, right = left.select(left_id, "lon", "lat"), right.select(right_id, "lon", "lat")
    order = Window.partitionBy("a").orderBy("km", "b")

    def search(points: DataFrame, radius: float) -> DataFrame:
        pairs = within_km(points, right, radius, left_id, right_id).select(F.col(f"l_{left_id}").alias("a"), F.col(f"r_{right_id}").alias("b"), "km")
        pairs = pairs.where("a <> b") if same else pairs
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if km is not None:
        found = search(left, km)
    else:
        radius, parts, rest, right = 2.0, [], left, checkpointed(right)
        goal = k + same
        enough = min(goal, right.limit(goal).count()) - same
        while enough > 0:
            near = checkpointed(search(rest, radius))
            full = near.groupBy("a").count().where((F.col("count") >= enough) | F.lit(radius > 20_100)).select(F.col("a").alias(left_id))
            parts.append(near.join(full.withColumnRenamed(left_id, "a"), "a", "left_semi"))
            rest = checkpointed(rest.join(full, left_id, "left_anti"))
            if radius > 20_100 or rest.isEmpty():
                break
            radius *= 4
        found = parts[0] if parts else search(left.limit(0), 1.0)
        for p in parts[1:]:
            found = found.union(p)
    return found.select(F.col("a").alias(left_id), F.col("b").alias(right_id), "km", F.col("rank").cast("int").alias("rank"))


def boxes(edges: DataFrame, key: str) -> DataFrame:
    """Bounding box of each polygon part."""
    return edges.groupBy(key, "part_id").agg(F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax"))


def _box_cells(df: DataFrame, cell: float) -> DataFrame:
    xs = F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell))
    ys = F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def _crosses(x: Column, y: Column) -> Column:
    """1 where the ray to the right of a point crosses an edge (half-open in y)."""
    at = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return F.when(((F.col("y1") > y) != (F.col("y2") > y)) & (x < at), 1).otherwise(0)


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, key: str, cell: float = 0.01) -> DataFrame:
    """(point_id, key) of every polygon whose parts hold a point (lon, lat). A point exactly on an edge
    belongs to the half-open side. Each pair is returned once."""
    box = _box_cells(boxes(edges, key), cell)
    p = points.select(point_id, "lon", "lat").where("lon is not null and lat is not null").withColumn("_cx", F.floor(F.col("lon") / cell)).withColumn("_cy", F.floor(F.col("lat") / cell))
    near = p.join(box, ["_cx", "_cy"]).where("lon >= xmin and lon <= xmax and lat >= ymin and lat <= ymax").select(point_id, "lon", "lat", key, "part_id")
    hits = near.join(edges, [key, "part_id"]).groupBy(point_id, key, "part_id").agg(F.sum(_crosses(F.col("lon"), F.col("lat"))).alias("n"))
    return hits.where("n % 2 = 1").select(point_id, key).distinct()


def blocked_segments(segments: DataFrame, edges: DataFrame, segment_id: str, key: str, cell: float = 0.01) -> DataFrame:
    """(segment_id, key): segments (ax, ay, bx, by) that share a positive length with a polygon's inside.

    The crossings with all edges cut a segment into intervals; it is blocked if the middle of one is
    inside. Touching a corner or running along an edge does not block.
    """
    s = segments.select(segment_id, "ax", "ay", "bx", "by")
    own = _box_cells(s.withColumn("xmin", F.least("ax", "bx")).withColumn("xmax", F.greatest("ax", "bx")).withColumn("ymin", F.least("ay", "by")).withColumn("ymax", F.greatest("ay", "by")), cell).select(segment_id, "_cx", "_cy", *[F.col(c).alias(f"s{c}") for c in ("xmin", "xmax", "ymin", "ymax")])
    near = own.join(_box_cells(boxes(edges, key), cell), ["_cx", "_cy"]).where("sxmin <= xmax and sxmax >= xmin and symin <= ymax and symax >= ymin").select(segment_id, key, "part_id").distinct()
    rx, ry, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cross = rx * ey - ry * ex
    qx, qy = F.col("x1") - F.col("ax"), F.col("y1") - F.col("ay")
    t, u = (qx * ey - qy * ex) / F.nullif(cross, F.lit(0.0)), (qx * ry - qy * rx) / F.nullif(cross, F.lit(0.0))
    with_edges = near.join(s, segment_id).join(edges, [key, "part_id"])
    cuts = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.collect_list(F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)))))
    middle = with_edges.groupBy(segment_id, key, "part_id", "ax", "ay", "bx", "by").agg(cuts.alias("cuts"))
    middle = middle.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1))).selectExpr(segment_id, key, "part_id", "i", "ax + (cuts[i - 1] + cuts[i]) / 2 * (bx - ax) as px", "ay + (cuts[i - 1] + cuts[i]) / 2 * (by - ay) as py", "cuts[i] - cuts[i - 1] as length").where("length > 1e-12")
    inside = middle.join(edges, [key, "part_id"]).groupBy(segment_id, key, "part_id", "i").agg(F.sum(_crosses(F.col("px"), F.col("py"))).alias("n")).where("n % 2 = 1")
    return inside.select(segment_id, key).distinct()


def cluttered_segments(segments: DataFrame, edges: DataFrame, segment_id: str, key: str, samples: int = 6, cell: float = 0.01) -> DataFrame:
    """(segment_id): segments whose ends or one of ``samples`` inner points lie in a polygon, or that are blocked."""
    at = segments.select(segment_id, "ax", "ay", "bx", "by", F.explode(F.sequence(F.lit(0), F.lit(samples + 1))).alias("i"))
    points = at.selectExpr(f"struct({segment_id}, i) as p", f"ax + (bx - ax) * i / {samples + 1} as lon", f"ay + (by - ay) * i / {samples + 1} as lat")
    sampled = points_in_polygons(points, edges, "p", key, cell).select(F.col(f"p.{segment_id}").alias(segment_id))
    return sampled.union(blocked_segments(segments, edges, segment_id, key, cell).select(segment_id)).distinct()


def box_gaps(rects: DataFrame, key: str, gap: float, cell: float) -> DataFrame:
    """(a, b, gap) for boxes at most ``gap`` apart, a < b; overlapping boxes have the gap 0."""
    a = _box_cells(rects.selectExpr(f"{key} as a", f"xmin - {gap} as xmin", f"xmax + {gap} as xmax", f"ymin - {gap} as ymin", f"ymax + {gap} as ymax", "xmin as x0", "xmax as x1", "ymin as y0", "ymax as y1"), cell).drop("xmin", "xmax", "ymin", "ymax")
    b = _box_cells(rects.selectExpr(f"{key} as b", "xmin", "xmax", "ymin", "ymax"), cell)
    dx = F.greatest(F.lit(0.0), F.col("xmin") - F.col("x1"), F.col("x0") - F.col("xmax"))
    dy = F.greatest(F.lit(0.0), F.col("ymin") - F.col("y1"), F.col("y0") - F.col("ymax"))
    return a.join(b, ["_cx", "_cy"]).where("a < b").withColumn("gap", F.sqrt(dx * dx + dy * dy)).where(F.col("gap") <= gap).select("a", "b", "gap").distinct()
