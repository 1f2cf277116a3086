"""Rules on dirty building tags: heights, levels, kinds of demand, weights, capacities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag lists and rates of the planning model.
DEMAND_TAGS = "house residential apartments apartment apartment_block multistory block flats semidetached_house dormitory detached terrace hut cabin bungalow retail office commercial supermarket yes true 1".split()
NO_DEMAND_TAGS = "industrial warehouse factory manufacture garage shed garages school university college hospital kindergarten civic government train_station service".split()
APARTMENT_TAGS = "apartments apartment apartment_block multistory block flats semidetached_house".split()
PRIVATE_TAGS = "house detached hut cabin bungalow terrace residential yes true 1 garage shed garages".split()
PUBLIC_AMENITIES = "school university college kindergarten hospital clinic police townhall community_centre library sports_centre fire_station".split()
PUBLIC_TAGS = "school university college kindergarten hospital clinic civic government public".split()
NOT_PRIVATE_TAGS = "apartments apartment apartment_block multistory block flats semidetached_house commercial office retail industrial school university college hospital kindergarten civic government public train_station supermarket hotel dormitory service".split()
OFFICE_TAGS = "office commercial".split()
RETAIL_TAGS = "retail supermarket mall shop kiosk market".split()
INDUSTRY_TAGS = "industrial warehouse factory manufacture plant depot hangar storage".split()
LODGING_TAGS = "hotel hostel dormitory motel".split()
GROUND_TAGS = "retail supermarket commercial mall shop kiosk warehouse parking garage garages".split()
WORKSHOP_TAGS = "industrial warehouse factory manufacture depot hangar shed garages garage".split()
NOT_WORKSHOP_TAGS = "retail supermarket shop mall kiosk office hotel motel church cathedral mosque temple school university college kindergarten hospital clinic civic stadium commercial apartments residential house dormitory public".split()
ANY_TAGS = ["yes", "true", "1"]
ALTITUDES_M = (40.0, 67.5, 95.0, 122.5, 150.0)
MARGIN_M, CLEARANCE_M = 10.0, 5.0
CARGO, MONITORING = 0.75, 0.15
DRONE_VOLUME_M3 = 0.75 * 4.470 + 0.15 * 1.075 + 0.10 * 3.093
DRONE_FOOTPRINT_M2 = 0.75 * (2.068 * 1.918) + 0.15 * (0.830 * 1.070) + 0.10 * (1.010 * 1.750)


def tag(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def parse_height(c: Column) -> Column:
    """Metres from a height tag; null where it has another form or an odd number."""
    s = F.lower(F.trim(c))
    number = F.regexp_extract(s, r"^([\d.]+)\s*(m|м|meters?|метров?|ft|feet)?$", 1).try_cast("double")
    unit = F.regexp_extract(s, r"^([\d.]+)\s*(m|м|meters?|метров?|ft|feet)?$", 2)
    return F.when(unit.isin("ft", "feet"), number * 0.3048).otherwise(number)


def _first_number(c: Column) -> Column:
    return F.replace(F.element_at(F.split(F.trim(c), r"\s+"), 1), F.lit(","), F.lit(".")).try_cast("double")


def levels(tags: list[str], height: str) -> Column:
    """Storeys from the first usable tag (1 to 200), else from a height over 2 and under 500 metres."""
    parsed = [F.when(_first_number(F.col(t)).cast("int").between(1, 200), _first_number(F.col(t)).cast("int")) for t in tags]
    h = F.replace(F.element_at(F.split(F.trim(F.replace(F.replace(F.lower(F.trim(F.col(height))), F.lit("m"), F.lit("")), F.lit("м"), F.lit(""))), r"\s+"), 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(*parsed, F.when((h > 2) & (h < 500), F.greatest(F.lit(1), F.bround(h / 3.0).cast("int"))))


def height_m(height: str, tags: list[str]) -> Column:
    """Height tag, else storeys of 3 metres, else 10 metres; 3 to 500."""
    storeys = [F.when((n := F.element_at(F.split(F.col(t), r"\."), 1).try_cast("double").cast("int")) > 0, n * 3.0) for t in tags]
    return F.greatest(F.lit(3.0), F.least(F.lit(500.0), F.coalesce(parse_height(F.col(height)), *storeys, F.lit(10.0))))


def flats_per_floor(levels: Column) -> Column:
    return F.when(levels <= 5, 3).when(levels <= 9, 4).when(levels <= 16, 5).otherwise(6)


def entrances(c: str, area: Column) -> Column:
    n = _first_number(F.col(c)).cast("int")
    return F.coalesce(F.when(n > 0, n), F.when(area > 0, F.greatest(F.lit(1), F.bround(area / 300.0).cast("int"))), F.lit(1))


def is_private_house(building: Column, amenity: Column, shop: Column) -> Column:
    return ~amenity.isin(PUBLIC_AMENITIES) & ~shop.isin(PUBLIC_AMENITIES) & building.isin(PRIVATE_TAGS)


def makes_block_non_private(building: Column, amenity: Column, shop: Column) -> Column:
    return amenity.isin(PUBLIC_AMENITIES) | shop.isin(PUBLIC_AMENITIES) | building.isin(NOT_PRIVATE_TAGS)


def is_apartment_house(building: Column, levels: Column) -> Column:
    return building.isin(APARTMENT_TAGS) | (building.isin("residential", *ANY_TAGS) & F.coalesce(levels >= 3, F.lit(False)))


def demand_type(building: Column, amenity: Column, shop: Column, levels: Column) -> Column:
    low = F.coalesce(levels <= 2, F.lit(False))
    bare = (amenity == "") & (shop == "")
    return (
        F.when(is_apartment_house(building, levels), "apartment")
        .when(amenity.isin(PUBLIC_AMENITIES) | building.isin(PUBLIC_TAGS), "public")
        .when(building.isin(OFFICE_TAGS), "office")
        .when(building.isin(RETAIL_TAGS) | (shop != ""), "retail")
        .when(building.isin(INDUSTRY_TAGS), "industrial")
        .when(building.isin(LODGING_TAGS), "public")
        .when(is_private_house(building, amenity, shop), "private")
        .when(building.isin(ANY_TAGS) & (levels.isNull() | low) & bare, "private")
        .when((building == "residential") & low, "private")
        .when((building == "") & bare, "private")
        .otherwise("other")
    )


def demand_weight(kind: Column, levels: Column, area: Column, entrances: Column) -> Column:
    lv = F.greatest(F.lit(1), F.coalesce(levels, F.lit(5)))
    w = F.coalesce(area, F.lit(0.0)) * F.greatest(F.lit(1), F.coalesce(levels, F.lit(1))) * 0.01
    return (
        F.when(kind == "apartment", (flats_per_floor(lv) * lv * entrances).cast("double"))
        .when(kind == "private", F.when(F.coalesce(levels, F.lit(1)) <= 1, 1.2).otherwise(1.5))
        .when(kind.isin("retail", "office", "industrial", "public"), F.when(w > 0, w).otherwise(1.0))
        .otherwise(1.0)
    )


def flight_level(height: Column, altitudes: tuple[float, ...] = ALTITUDES_M) -> Column:
    """First level at least MARGIN_M above; 1 where none is."""
    out = F.lit(1)
    for i in range(len(altitudes), 0, -1):
        out = F.when(F.lit(altitudes[i - 1]) >= height + MARGIN_M, i).otherwise(out)
    return out


def split_by_type(total: Column) -> tuple[Column, Column, Column]:
    """Cargo, monitoring and service drones of a total; what half-even rounding overshoots goes first
    from cargo, then from monitoring."""
    t = F.greatest(F.lit(0), total)
    cargo, monitoring = F.bround(t * CARGO).cast("long"), F.bround(t * MONITORING).cast("long")
    over = F.greatest(F.lit(0), cargo + monitoring - t)
    from_cargo = F.least(over, cargo)
    return cargo - from_cargo, monitoring - F.least(over - from_cargo, monitoring), F.greatest(F.lit(0), t - cargo - monitoring)


def cluster_key(c: Column) -> Column:
    """Canonical text of a cluster id: null for blanks and NaN, integer text for near-integers."""
    s = F.trim(c.cast("string"))
    f = s.try_cast("double")
    near = f.isNotNull() & ~F.isnan(f) & (F.abs(f) < 1e15) & (F.abs(f - F.bround(f)) < 1e-9)
    return F.when((s == "") | (F.lower(s) == "nan"), None).when(near, F.bround(f).cast("long").cast("string")).otherwise(s)


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.sort_array(F.array(a.cast("string"), b.cast("string"))))
