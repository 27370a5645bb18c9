"""Distance joins as equi-joins on grid cells.

The larger, request-driven side keeps one row per point; the dimension side is copied to every cell
its reach touches. Cells with very many rows or comparisons are split over several join keys, and cells
that too many targets reach are quartered until few candidates are left per cell, so neither a
crowded place nor a popular one ends up in a single task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan.functions.geometry import (
    EARTH_RADIUS_M, KM_PER_DEGREE, M_PER_DEGREE, haversine_m, meeting,
)
from roadplan.session import set_checkpoint_dir

HOT_ROWS = 2_000_000
HOT_PAIRS = 500_000_000
LEAF_TARGETS = 256
FANOUT = 4
MAX_LEVELS = 16
PAD = 1e-6
LINE = ["lat1", "lon1", "lat2", "lon2"]


@dataclass(frozen=True)
class Metric:
    """A distance that grows with |dlat| and |dlon|, so that it can be bounded over a box."""

    name: str
    per_degree: float

    def between(self, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        if self.name == "haversine":
            return haversine_m(lat1, lon1, lat2, lon2)
        dlat, dlon = lat2 - lat1, lon2 - lon1
        return F.sqrt(dlat * dlat + dlon * dlon) * self.per_degree

    def bound(self, dlat: Column, dlon: Column, cos_product: Column) -> Column:
        if self.name == "haversine":
            s, c = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
            a = F.least(F.lit(1.0), s * s + cos_product * c * c)
            return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))
        return F.sqrt(dlat * dlat + dlon * dlon) * self.per_degree

    def reach(self, radius: float, lat: Column) -> tuple[Column, Column]:
        """Half-height and half-width in degrees of a box around the disc."""
        if self.name == "haversine":
            angle = radius / EARTH_RADIUS_M
            high = F.least(F.lit(89.9), F.abs(lat) + F.degrees(F.lit(angle)))
            wide = F.degrees(F.lit(angle)) / F.cos(F.radians(high))
            return F.degrees(F.lit(angle)) + PAD, wide * 1.001 + PAD
        return F.lit(radius / self.per_degree + PAD), F.lit(radius / self.per_degree + PAD)


PLANAR_KM = Metric("planar", KM_PER_DEGREE)
PLANAR_M = Metric("planar", M_PER_DEGREE)
HAVERSINE_M = Metric("haversine", EARTH_RADIUS_M * 3.141592653589793 / 180)


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size)


def split_hot_cells(
    points: DataFrame, targets: DataFrame, cell: list[str], hot_rows: int = HOT_ROWS, hot_pairs: int = HOT_PAIRS,
):
    """Spread overfull cells over ``salt``, so that points and targets of a cell meet exactly once.

    A cell is cut into blocks of at most ``hot_rows`` rows of either side and about ``hot_pairs`` comparisons, whichever
    side the crowd is on; the rows of one side are copied once per part of the other. Both sides are written first, so that
    each is computed once, and counted together, unless their sizes rule out an overfull cell.
    Only cut cells are broadcast: each has more than ``hot_rows`` or ``sqrt(hot_pairs)`` rows, which bounds their number.
    """
    points, targets = checkpointed(points), checkpointed(targets)
    n_points, n_targets = points.count(), targets.count()
    if max(n_points, n_targets) <= hot_rows and n_points * n_targets <= hot_pairs:
        return points.withColumn("salt", F.lit(0)), targets.withColumn("salt", F.lit(0))
    mark = lambda side, p, t: side.select(*cell, F.lit(p).alias("p"), F.lit(t).alias("t"))
    counts = mark(points, 1, 0).unionAll(mark(targets, 0, 1)).groupBy(*cell).agg(
        F.sum("p").alias("p"), F.sum("t").alias("t"))
    block = lambda other: F.least(F.lit(float(hot_rows)), F.greatest(
        F.lit(float(hot_pairs) ** 0.5), F.lit(float(hot_pairs)) / F.col(other)))
    parts = lambda side, other: F.ceil(F.col(side) / block(other)).cast("int")
    hot = (
        counts.where((F.col("p") > 0) & (F.col("t") > 0))
        .select(*cell, parts("p", "t").alias("p_parts"), parts("t", "p").alias("t_parts"))
        .where((F.col("p_parts") > 1) | (F.col("t_parts") > 1))
    )
    p_parts, t_parts = F.coalesce("p_parts", F.lit(1)), F.coalesce("t_parts", F.lit(1))
    part = lambda side, n: F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda side, p, t: (
        side.join(F.broadcast(hot), cell, "left").withColumn("_p", p).withColumn("_t", t)
        .withColumn("salt", F.col("_p") * t_parts + F.col("_t")).drop("p_parts", "t_parts", "_p", "_t")
    )
    return dealt(points, part(points, p_parts), every(t_parts)), dealt(targets, every(p_parts), part(targets, t_parts))


def cover_disc(targets: DataFrame, metric: Metric, radius: float, size: float) -> DataFrame:
    """One row per (target, cell) for every cell the disc around the target may touch."""
    high, wide = metric.reach(radius, F.col("t_lat"))
    return (
        targets
        .withColumn("iy", F.explode(F.sequence(cell_of(F.col("t_lat") - high, size), cell_of(F.col("t_lat") + high, size))))
        .withColumn("ix", F.explode(F.sequence(cell_of(F.col("t_lon") - wide, size), cell_of(F.col("t_lon") + wide, size))))
    )


def pairs_within(
    points: DataFrame, targets: DataFrame, metric: Metric, radius: float, hot_rows: int = HOT_ROWS,
    also: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All (point, target) pairs at most ``radius`` apart, with their ``distance``.

    ``points`` has ``lat, lon``; ``targets`` has ``t_lat, t_lon``. The distance test is part of the join
    condition, so only real pairs leave the join; so is ``also``, a further test given the distance.
    """
    size = radius / metric.per_degree / 2
    keyed = points.withColumn("iy", cell_of(F.col("lat"), size)).withColumn("ix", cell_of(F.col("lon"), size))
    covered = cover_disc(targets, metric, radius, size)
    left, right = split_hot_cells(keyed, covered, ["iy", "ix"], hot_rows)
    left, right = left.alias("p"), right.alias("t")
    distance = metric.between(F.col("p.lat"), F.col("p.lon"), F.col("t.t_lat"), F.col("t.t_lon"))
    same_cell = (
        (F.col("p.iy") == F.col("t.iy")) & (F.col("p.ix") == F.col("t.ix")) & (F.col("p.salt") == F.col("t.salt"))
    )
    near = distance <= radius if also is None else (distance <= radius) & also(distance)
    return left.join(right, same_cell & near).select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"t.{c}") for c in targets.columns],
        distance.alias("distance"),
    )


@dataclass(frozen=True)
class Targets:
    """What to look for: rows ``target_id, t_lat, t_lon``, the metric and the reach."""

    rows: DataFrame
    metric: Metric
    radius: float


@dataclass(frozen=True)
class NearestIndex:
    """Targets by grid cell, with the crowded cells quartered (``dense`` lists them per level)."""

    size: float
    leaves: DataFrame
    dense: list[DataFrame]


def box_bounds(metric: Metric, size: float) -> tuple[Column, Column]:
    """Least and greatest possible distance from a target to the points of its cell."""
    lat0, lat1 = F.col("iy") * size, (F.col("iy") + 1) * size
    lon0, lon1 = F.col("ix") * size, (F.col("ix") + 1) * size
    zero = F.lit(0.0)
    near_lat = F.greatest(lat0 - F.col("t_lat"), F.col("t_lat") - lat1, zero)
    near_lon = F.greatest(lon0 - F.col("t_lon"), F.col("t_lon") - lon1, zero)
    far_lat = F.greatest(F.abs(lat0 - F.col("t_lat")), F.abs(lat1 - F.col("t_lat")))
    far_lon = F.greatest(F.abs(lon0 - F.col("t_lon")), F.abs(lon1 - F.col("t_lon")))
    cos0, cos1 = F.cos(F.radians(lat0)), F.cos(F.radians(lat1))
    widest = F.when((lat0 <= 0) & (lat1 >= 0), 1.0).otherwise(F.greatest(cos0, cos1))
    cos_t = F.cos(F.radians(F.col("t_lat")))
    return (
        metric.bound(near_lat, near_lon, F.least(cos0, cos1) * cos_t),
        metric.bound(far_lat, far_lon, widest * cos_t),
    )


def nearest_index(places: DataFrame, targets: Targets, leaf: int = LEAF_TARGETS) -> NearestIndex:
    """Prepare ``targets`` for lookups from ``places`` (distinct ``lat, lon``).

    Targets at the same place collapse to the smallest id. A cell with more than ``leaf`` places that is also reached by
    more than ``leaf`` targets is divided into 16, and each part keeps only the targets that can be the
    nearest for some point in it: those whose least distance does not exceed the smallest greatest
    distance. So the comparisons in all cells together stay within ``leaf`` times the rows of both sides. One
    small job per level decides whether another level is needed.
    """
    metric, radius = targets.metric, targets.radius
    size = radius / metric.per_degree * 1.001
    spots = targets.rows.groupBy("t_lat", "t_lon").agg(F.min("target_id").alias("target_id"))
    rows = checkpointed(cover_disc(spots, metric, radius, size))
    leaves, dense = None, []
    for level in range(MAX_LEVELS):
        part = size / FANOUT ** level
        many = rows.groupBy("iy", "ix").count().where(F.col("count") > leaf).select("iy", "ix")
        last = level == MAX_LEVELS - 1 or many.isEmpty()
        if not last:
            busy = (
                places.select(cell_of(F.col("lat"), part).alias("iy"), cell_of(F.col("lon"), part).alias("ix"))
                .groupBy("iy", "ix").count().where(F.col("count") > leaf).select("iy", "ix")
            )
            many = checkpointed(many.join(busy, ["iy", "ix"], "left_semi"))
            last = many.isEmpty()
        settled = rows if last else rows.join(many, ["iy", "ix"], "left_anti")
        settled = settled.withColumn("level", F.lit(level))
        leaves = settled if leaves is None else leaves.unionByName(settled)
        if last:
            break
        dense.append(many)
        least, greatest = box_bounds(metric, part / FANOUT)
        offsets = F.sequence(F.lit(0), F.lit(FANOUT - 1))
        split = (
            rows.join(many, ["iy", "ix"], "left_semi")
            .withColumn("iy", F.explode(F.transform(offsets, lambda i: F.col("iy") * FANOUT + i)))
            .withColumn("ix", F.explode(F.transform(offsets, lambda i: F.col("ix") * FANOUT + i)))
            .withColumn("least", least * (1 - 1e-9) - 1e-9)
            .withColumn("greatest", greatest)
            .where(F.col("least") <= radius)
        )
        best = split.groupBy("iy", "ix").agg(F.min("greatest").alias("best"))
        rows = checkpointed(
            split.join(best, ["iy", "ix"]).where(F.col("least") <= F.col("best")).drop("least", "greatest", "best")
        )
    return NearestIndex(size, leaves, dense)


def nearest_within(
    points: DataFrame, targets: Targets, hot_rows: int = HOT_ROWS, leaf: int = LEAF_TARGETS
) -> DataFrame:
    """Nearest target per distinct ``(lat, lon)`` of ``points``, at most ``radius`` away.

    Returns ``lat, lon, target_id, t_lat, t_lon, distance`` for the places that have one; the smallest id
    wins a tie. Requests from the same place are looked up once.
    """
    places = checkpointed(points.select("lat", "lon").distinct())
    index = nearest_index(places, targets, leaf)
    keyed = places.withColumn("level", F.lit(0))
    for level, full in enumerate(index.dense):
        size = index.size / FANOUT ** level
        marked = (
            keyed.withColumn("iy", cell_of(F.col("lat"), size)).withColumn("ix", cell_of(F.col("lon"), size))
            .join(full.withColumn("full", F.lit(True)), ["iy", "ix"], "left")
        )
        deeper = F.col("full").isNotNull() & (F.col("level") == level)
        keyed = marked.select("lat", "lon", F.when(deeper, level + 1).otherwise(F.col("level")).alias("level"))
    size = F.lit(index.size) / F.pow(F.lit(float(FANOUT)), F.col("level"))
    keyed = keyed.withColumn("iy", F.floor(F.col("lat") / size)).withColumn("ix", F.floor(F.col("lon") / size))
    left, right = split_hot_cells(keyed, index.leaves, ["level", "iy", "ix"], hot_rows)
    distance = targets.metric.between(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    best = F.min(F.struct("distance", "target_id", "t_lat", "t_lon")).alias("best")
    return (
        left.join(right, ["level", "iy", "ix", "salt"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= targets.radius)
        .groupBy("lat", "lon").agg(best)
        .select("lat", "lon", "best.*")
    )


def attach_nearest(points: DataFrame, targets: Targets, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``points`` with ``target_id, t_lat, t_lon, distance`` of the nearest target, null where none is in reach."""
    # one row per place; a place of very many points is a skewed key of an outer join, which adaptive execution splits
    near = checkpointed(nearest_within(points, targets, hot_rows))
    return points.join(near, ["lat", "lon"], "left").select(*points.columns, "target_id", "t_lat", "t_lon", "distance")


def places_within(points: DataFrame, targets: DataFrame, metric: Metric, radius: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct ``lat, lon`` of ``points`` with some target closer than ``radius``; no pair leaves the join."""
    size = radius / metric.per_degree / 2
    places = points.select("lat", "lon").distinct()
    keyed = places.withColumn("iy", cell_of(F.col("lat"), size)).withColumn("ix", cell_of(F.col("lon"), size))
    covered = cover_disc(targets.select("t_lat", "t_lon").distinct(), metric, radius, size)
    left, right = split_hot_cells(keyed, covered, ["iy", "ix"], hot_rows)
    left, right = left.alias("p"), right.alias("t")
    near = metric.between(F.col("p.lat"), F.col("p.lon"), F.col("t.t_lat"), F.col("t.t_lon")) < radius
    for name in ("iy", "ix", "salt"):
        near &= F.col(f"p.{name}") == F.col(f"t.{name}")
    return left.join(right, near, "left_semi").select("lat", "lon").distinct()


def cover_line(lines: DataFrame, size: float) -> DataFrame:
    """One row per (segment, cell) for the cells along ``lat1, lon1 -> lat2, lon2``.

    Column by column the segment is clipped and the rows it passes are listed, so a long segment costs
    cells in proportion to its length and not to the area of its bounding box.
    """
    lat1, lon1, lat2, lon2 = (F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
    west, east = F.least(lon1, lon2), F.greatest(lon1, lon2)
    south, north = F.least(lat1, lat2), F.greatest(lat1, lat2)
    slope = F.try_divide(lat2 - lat1, lon2 - lon1)
    steep = F.abs(lon2 - lon1) < 1e-4
    enter = lat1 + (F.greatest(west, F.col("ix") * size) - lon1) * slope
    leave = lat1 + (F.least(east, (F.col("ix") + 1) * size) - lon1) * slope
    low = F.when(steep, south).otherwise(F.greatest(south, F.least(enter, leave)))
    high = F.when(steep, north).otherwise(F.least(north, F.greatest(enter, leave)))
    return (
        lines
        .withColumn("ix", F.explode(F.sequence(cell_of(west - PAD, size), cell_of(east + PAD, size))))
        .withColumn("low", F.least(low, high) - PAD).withColumn("high", F.greatest(low, high) + PAD)
        .withColumn("iy", F.explode(F.sequence(cell_of(F.col("low"), size), cell_of(F.col("high"), size))))
        .drop("low", "high")
    )


def overlapping(left: str, right: str, axis: str) -> Column:
    """Whether two segments share part of their range on one axis, with a little slack."""
    a1, a2, b1, b2 = (F.col(f"{side}{axis}{i}") for side in (left, right) for i in (1, 2))
    return (F.least(a1, a2) <= F.greatest(b1, b2) + PAD) & (F.least(b1, b2) <= F.greatest(a1, a2) + PAD)


def crossing_pairs(segments: DataFrame, rivers: DataFrame, size: float = 0.05, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Segments of two line sets that meet, with the meeting point ``at_lat, at_lon``.

    Both sides carry ``lat1, lon1, lat2, lon2``; the right side's are returned as ``r_*``. A pair that shares
    several cells is returned once for each of them.
    """
    left_cells, right_cells = split_hot_cells(
        cover_line(segments, size), cover_line(rivers, size), ["iy", "ix"], hot_rows
    )
    for c in LINE:
        right_cells = right_cells.withColumnRenamed(c, f"r_{c}")
    a, b = left_cells.alias("a"), right_cells.alias("b")
    hit, at_lat, at_lon = aliased_meeting()
    on = (F.col("a.iy") == F.col("b.iy")) & (F.col("a.ix") == F.col("b.ix")) & (F.col("a.salt") == F.col("b.salt"))
    names = [c for c in rivers.columns if c not in LINE]
    return a.join(b, on & hit).select(
        *[F.col(f"a.{c}") for c in segments.columns], *[F.col(f"b.{c}") for c in names],
        *[F.col(f"b.r_{c}") for c in LINE],
        at_lat.alias("at_lat"), at_lon.alias("at_lon"),
    )


def aliased_meeting() -> tuple[Column, Column, Column]:
    """Whether the segments of ``a`` and ``b`` (its ends as ``r_*``) meet, and the latitude and longitude where they do."""
    hit, at_lat, at_lon = meeting(*[F.col(f"a.{c}") for c in LINE], *[F.col(f"b.r_{c}") for c in LINE])
    return overlapping("a.", "b.r_", "lat") & overlapping("a.", "b.r_", "lon") & hit, at_lat, at_lon


def fresh_folder(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that nothing has been written to."""
    set_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared checkpoint folder and go on from there.

    A written table also drops what the planner has inferred about the rows so far, which would otherwise
    grow with every round of a loop, and gives the next round true sizes to plan with.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
