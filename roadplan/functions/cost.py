"""Edge costs, construction cost and duration as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadplan.functions.geometry import round_places

# Road classes, surfaces and the rates attached to them.
MAJOR_CLASSES = [
    "motorway", "trunk", "primary", "secondary",
    "motorway_link", "trunk_link", "primary_link", "secondary_link",
]
TERTIARY_CLASSES = ["tertiary", "tertiary_link"]
PAVED_SURFACES = ["paved", "asphalt", "concrete"]
NEW_ROAD_PER_KM = 35_000
EXISTING_ROAD_PER_KM = 5_000
COST_PER_BRIDGE = 25_000
NETWORK_NEW_PER_KM = 1_000_000
NETWORK_UPGRADE_PER_KM = 400_000


def cost_shortest(distance_m: Column) -> Column:
    return distance_m


def cost_safest(distance_m: Column, highway: Column) -> Column:
    return (
        F.when(highway.isin("primary", "secondary"), distance_m * 0.8)
        .when(highway == "track", distance_m * 1.5)
        .otherwise(distance_m)
    )


def cost_budget(distance_m: Column, surface: Column) -> Column:
    return F.when(surface.isin(PAVED_SURFACES), distance_m * 0.7).otherwise(distance_m)


def cost_social(distance_m: Column, near_settlement: Column) -> Column:
    return F.when(near_settlement, distance_m * 0.6).otherwise(distance_m)


def construction_type(highway: Column) -> Column:
    """A segment whose edge is unknown to the network (null class) is new construction."""
    return F.when(highway.isNull(), "new_construction").otherwise("upgrade_existing")


def cost_factor(highway: Column, surface: Column) -> Column:
    return (
        F.when(highway.isNull(), 1.0)
        .when(highway.isin(MAJOR_CLASSES), 0.3)
        .when(highway.isin(TERTIARY_CLASSES), 0.5)
        .when(surface.isin(PAVED_SURFACES), 0.4)
        .otherwise(0.7)
    )


def construction_cost(new_km: Column, existing_km: Column, terrain: Column, bridges: Column) -> Column:
    roads = new_km * NEW_ROAD_PER_KM + existing_km * EXISTING_ROAD_PER_KM
    return round_places(roads * (1 + terrain / 100) + bridges * COST_PER_BRIDGE, 2)


def network_segment_cost(distance_m: Column, kind: Column) -> Column:
    per_km = F.when(kind == "new_construction", NETWORK_NEW_PER_KM).otherwise(NETWORK_UPGRADE_PER_KM)
    return distance_m / 1000 * per_km


def curve_duration_days(km: Column, terrain: Column, bridges: Column) -> Column:
    """Whole days, halves rounded to even."""
    return F.bround(km * 15 * (1 + terrain / 300) + bridges * 30).cast("bigint")


def network_duration_days(km: Column) -> Column:
    return (km * 2).cast("bigint")


def estimated_bridges(km: Column) -> Column:
    """Bridge estimate for a route without known crossings, at most five."""
    by_length = F.when(km < 15, 1).when(km < 40, 2).otherwise(F.greatest(F.lit(2), (km / 20).cast("int")))
    return F.least(by_length, F.lit(5))
