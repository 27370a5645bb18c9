"""Request intake: JSON text to typed rows, with everything unusable set aside."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.functions.text import DEFAULT_CONTEXT
from roadplan.sources.defaults import DEFAULT_END, DEFAULT_START

# The area in which a point may be chosen, edges included.
GUARD_LAT = (28.5, 31.6)
GUARD_LON = (77.4, 81.1)

COORDINATES = {
    "start_lat": ("$.start.lat", DEFAULT_START[0]), "start_lon": ("$.start.lon", DEFAULT_START[1]),
    "end_lat": ("$.end.lat", DEFAULT_END[0]), "end_lon": ("$.end.lon", DEFAULT_END[1]),
}


def parse_requests(events: DataFrame, text: str = "event") -> DataFrame:
    """``events`` with coordinates, context and ``reason`` (null when usable).

    The payload is the ``body`` of the event, as text or as an object, or else the event itself. A missing
    coordinate takes its default; one that is present but not a number spoils the request.
    """
    outer = F.try_parse_json(F.col(text))
    inner = F.coalesce(
        F.try_parse_json(F.get_json_object(F.col(text), "$.body")),
        F.when(F.get_json_object(F.col(text), "$.body").isNull(), outer),
    )
    body = events.withColumn("_body", inner)
    present = lambda path: F.variant_get(F.col("_body"), path, "variant").isNotNull()
    number = lambda path: F.try_variant_get(F.col("_body"), path, "double")
    broken = F.array_compact(F.array(*[
        F.when(present(path) & number(path).isNull(), F.lit(name)) for name, (path, _) in COORDINATES.items()
    ]))
    reason = F.when(F.col("_body").isNull(), F.lit("not JSON")).when(
        F.size(broken) > 0, F.concat(F.lit("not a number: "), F.array_join(broken, ", "))
    )
    return body.select(
        *events.columns,
        *[F.coalesce(number(path), F.lit(default)).alias(name) for name, (path, default) in COORDINATES.items()],
        F.coalesce(F.try_variant_get(F.col("_body"), "$.context", "string"), F.lit(DEFAULT_CONTEXT)).alias("context"),
        reason.alias("reason"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())


def in_guard(lat: Column, lon: Column) -> Column:
    return lat.between(*GUARD_LAT) & lon.between(*GUARD_LON)


def guard_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``inside``: both ends lie in the permitted area."""
    c = F.col
    return requests.withColumn(
        "inside", in_guard(c("start_lat"), c("start_lon")) & in_guard(c("end_lat"), c("end_lon"))
    )
