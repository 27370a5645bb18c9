"""Terrain, rainfall and flood scores as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default annual rainfall and the flood score per elevation band.
DEFAULT_RAINFALL_MM = 1500.0
FLOOD_BANDS = [(800, 75), (1200, 55), (1800, 35), (2500, 25)]
FLOOD_ABOVE_BANDS = 15


def steps(values: Column) -> Column:
    """Absolute differences between neighbouring elements of an array."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda b, a: F.abs(b - a))


def terrain_risk(elevations: Column) -> Column:
    """Score of an elevation array from its largest and its mean step; 50 below two points."""
    jumps = steps(elevations)
    total = F.aggregate(jumps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    score = (30 + F.array_max(jumps) / 50 + F.try_divide(total, F.size(jumps)) / 20).cast("int")
    return F.when(F.size(elevations) < 2, 50).otherwise(F.least(F.lit(100), score))


def elevation_gain(elevations: Column) -> Column:
    """Highest minus lowest elevation."""
    return F.array_max(elevations) - F.array_min(elevations)


def rainfall_risk(rainfall_mm: Column, elevation: Column) -> Column:
    """Seasonal score from annual rainfall, raised at altitude."""
    base = F.least(F.lit(100), (20 + rainfall_mm / 40).cast("int"))
    uplift = F.when(elevation > 2500, 15).when(elevation > 2000, 10).otherwise(0)
    return F.least(F.lit(100), base + uplift)


def flood_base(elevation: Column) -> Column:
    """Flood score by elevation band."""
    (limit, score), *rest = FLOOD_BANDS
    band = F.when(elevation < limit, score)
    for limit, score in rest:
        band = band.when(elevation < limit, score)
    return band.otherwise(FLOOD_ABOVE_BANDS)


def flood_risk(elevation: Column, river_km: Column) -> Column:
    """Flood score raised near a river; a null distance means no river in reach."""
    uplift = F.when(river_km < 1, 20).when(river_km < 3, 10).otherwise(0)
    return F.least(F.lit(100), flood_base(elevation) + uplift)


def safest_terrain_curve(safest: Column, shortest: Column) -> Column:
    """Terrain score of the safest curve, kept below the shortest one's."""
    return F.when(safest >= shortest, F.greatest(F.lit(20), shortest - 10)).otherwise(safest)


def safest_flood_curve(flood: Column) -> Column:
    return F.greatest(F.lit(20), flood - 15)


def safest_terrain_network(terrain: Column) -> Column:
    return F.greatest(F.lit(20), terrain - 15)


def safest_flood_network(flood: Column) -> Column:
    return F.greatest(F.lit(15), flood - 15)


def overall_risk(terrain: Column, flood: Column, rainfall: Column) -> Column:
    """Mean of the three scores, truncated."""
    return ((terrain + flood + rainfall) / 3).cast("int")


def difficulty(terrain: Column, base: Column) -> Column:
    """Construction difficulty: a base of 50 (shortest) or 40 (safest) plus half the terrain score."""
    return F.least(F.lit(100), (base + terrain * 0.5).cast("int"))


def risk_band(score: Column) -> Column:
    return F.when(score > 60, "high").when(score > 40, "medium").otherwise("low")


def displayed_risk(score: Column, factor: Column) -> Column:
    """Score to show: the first of the two that is present and not zero, else 50."""
    return F.coalesce(F.nullif(score, F.lit(0)), F.nullif(factor, F.lit(0)), F.lit(50))
