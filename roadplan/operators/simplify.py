"""Polyline simplification for lines of any length.

A span of a line up to ``LEAF_POINTS`` is simplified where it lies, many spans at once; longer ones are split by rounds over
the whole table first, so that no task holds more than that of a line.
"""

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.functions.geometry import point_segment_degrees
from roadplan.operators.spatial import checkpointed

# Fixed value: tolerance in degrees.
TOLERANCE_DEGREES = 0.001
LEAF_POINTS = 200_000


def _away(lat, lon, lat1, lon1, lat2, lon2) -> np.ndarray:
    """``point_segment_degrees`` of arrays."""
    side_x, side_y = lon2 - lon1, lat2 - lat1
    square = side_x * side_x + side_y * side_y
    dot = (lon - lon1) * side_x + (lat - lat1) * side_y
    share = np.divide(dot, square, out=np.zeros_like(dot), where=square != 0)
    share = np.maximum(0.0, np.minimum(1.0, share))
    dlat, dlon = lat - (lat1 + share * side_y), lon - (lon1 + share * side_x)
    return np.sqrt(dlat * dlat + dlon * dlon)


def _kept(seq: np.ndarray, lat: np.ndarray, lon: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions of the inner points that survive, of spans laid end to end; ``seq, lat, lon`` rise within a span.

    All spans advance together. Points of one ``seq`` are one point: the farthest of them, of equals the last.
    """
    n, ends = len(seq), np.cumsum(sizes)
    unknown = np.isnan(lat) | np.isnan(lon)
    lo, hi = ends - sizes, ends - 1
    start, stop = lo + 1, hi.copy()
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = seq[1:] != seq[:-1]
    fresh[lo] = True
    group_start = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    group_stop = np.minimum.accumulate(np.where(fresh, np.arange(n + 1), n)[::-1])[::-1][1:]
    found = []
    while True:
        open_ = start < stop
        lo, hi, start, stop = lo[open_], hi[open_], start[open_], stop[open_]
        if not len(lo):
            return np.concatenate(found) if found else np.zeros(0, np.int64)
        counts = stop - start
        first = np.cumsum(counts) - counts
        span = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(counts.sum()) - first[span] + start[span]
        each = lambda values, end: values[end][span]
        away = _away(lat[at], lon[at], each(lat, lo), each(lon, lo), each(lat, hi), each(lon, hi))
        away = np.where(unknown[at] | each(unknown, lo) | each(unknown, hi), -1.0, away)
        most = np.maximum.reduceat(away, first)
        best = np.flatnonzero(away == most[span])
        of = span[best]
        earliest = best[np.concatenate(([True], of[1:] != of[:-1]))]
        best = best[seq[at[best]] == seq[at[earliest]][of]]
        of = span[best]
        cut = at[best[np.concatenate((of[1:] != of[:-1], [True]))]]
        split = most > tolerance
        lo, hi, start, stop, cut = lo[split], hi[split], start[split], stop[split], cut[split]
        found.append(cut)
        lo, hi, start, stop = (np.concatenate(x) for x in (
            (lo, cut), (cut, hi), (start, group_stop[cut]), (group_start[cut], stop)))


def settle_spans(spans: DataFrame, tolerance: float) -> DataFrame:
    """Surviving inner points of the spans (line_id, seqs, lats, lons), whose arrays begin and end with the span's ends."""
    item = lambda name: spans.schema[name].dataType.elementType.simpleString()
    line = spans.schema["line_id"].dataType.simpleString()

    def settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["seqs"].value_lengths(), np.int64)
            seq, lat, lon = (batch[name].flatten() for name in ("seqs", "lats", "lons"))
            plain = lambda values: values.to_numpy(zero_copy_only=False)
            kept = pa.array(np.sort(_kept(
                plain(seq), plain(lat).astype(float), plain(lon).astype(float), sizes, tolerance)))
            row = pa.array(np.searchsorted(np.cumsum(sizes), kept.to_numpy(), side="right"))
            yield pa.RecordBatch.from_arrays(
                [batch["line_id"].take(row), *[x.take(kept) for x in (seq, lat, lon)]], ["line_id", "seq", "lat", "lon"])

    return spans.mapInArrow(settled, f"line_id {line}, seq {item('seqs')}, lat {item('lats')}, lon {item('lons')}")


def simplify_lines(points: DataFrame, tolerance: float = TOLERANCE_DEGREES, leaf: int = LEAF_POINTS) -> DataFrame:
    """Points of ``(line_id, seq, lat, lon)`` that survive simplification, as ``line_id, seq, lat, lon``.

    Every undecided point carries the ends of its span. A round finds each long span's farthest point (the earliest
    of equals); if it lies beyond the tolerance it is kept and splits the span, otherwise the
    span's points are dropped. All long spans of all lines advance together and a span of more than ``leaf`` points is
    aggregated in parts. Shorter spans are settled at the end, each in one task.
    """
    c = F.col
    outer = points.groupBy("line_id").agg(
        F.min(F.struct("seq", "lat", "lon")).alias("lo"), F.max(F.struct("seq", "lat", "lon")).alias("hi")
    )
    ends = outer.select("line_id", F.explode(F.array("lo", "hi")).alias("p")).select("line_id", "p.*").distinct()
    inside = points.select("line_id", "seq", "lat", "lon").join(outer, "line_id").where(
        (c("seq") > c("lo.seq")) & (c("seq") < c("hi.seq"))
    )
    kept, inside, short = checkpointed(ends), checkpointed(inside.select("*", c("lo.seq").alias("span"))), []
    while True:
        long = checkpointed(inside.groupBy("line_id", "span").count().where(c("count") > leaf).select("line_id", "span"))
        if long.isEmpty():
            short.append(inside)
            break
        short.append(inside.join(F.broadcast(long), ["line_id", "span"], "left_anti"))
        inside = inside.join(F.broadcast(long), ["line_id", "span"])
        away = point_segment_degrees(
            c("lat"), c("lon"), c("lo.lat"), c("lo.lon"), c("hi.lat"), c("hi.lon")
        )
        farthest = (
            inside.withColumn("away", away).groupBy("line_id", "span")
            .agg(F.max(F.struct("away", -c("seq"), "seq", "lat", "lon")).alias("far"))
            .where(c("far.away") > tolerance)
            .select("line_id", "span", F.struct("far.seq", "far.lat", "far.lon").alias("cut"))
        )
        farthest = checkpointed(farthest)
        kept = kept.unionByName(farthest.select("line_id", "cut.*"))
        left = c("seq") < c("cut.seq")
        inside = checkpointed(
            inside.join(farthest, ["line_id", "span"])
            .where(c("seq") != c("cut.seq"))
            .select(
                "line_id", "seq", "lat", "lon",
                F.when(left, c("lo")).otherwise(c("cut")).alias("lo"),
                F.when(left, c("cut")).otherwise(c("hi")).alias("hi"),
                F.when(left, c("span")).otherwise(c("cut.seq")).alias("span"),
            )
        )
    spans = reduce(DataFrame.unionByName, short).groupBy("line_id", "span").agg(
        F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"),
        F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("inner"))
    drawn = spans.select("line_id", F.concat(F.array("lo"), "inner", F.array("hi")).alias("all"))
    settled = settle_spans(drawn.select("line_id", *[c(f"all.{x}").alias(f"{x}s") for x in ("seq", "lat", "lon")]), tolerance)
    return kept.unionByName(checkpointed(settled))
