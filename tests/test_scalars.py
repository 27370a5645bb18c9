import math

import pytest
from pyspark.sql import functions as F

from roadplan.functions import cost as C
from roadplan.functions import earthwork as E
from roadplan.functions import geometry as G
from roadplan.functions import risk as R
from roadplan.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(v) for v in values]


def test_haversine_one_degree_of_latitude(spark):
    got = value(spark, G.haversine_m(*lits(30.0, 78.0, 31.0, 78.0)))
    assert got == pytest.approx(6371000 * math.pi / 180)


@pytest.mark.parametrize("lat, lon", [(28.6, 77.5), (30.7268, 78.4354), (31.5, 81.0), (31.51, 78.0), (28.6, 77.49)])
def test_elevation(spark, lat, lon):
    if 28.6 <= lat <= 31.5 and 77.5 <= lon <= 81.0:
        ripple = int((lat * lon * 1000) % 400) - 200
        want = max(300, min(4000, int(300 + (lat - 28.6) * 900 + (lon - 77.5) * 100 + ripple)))
    else:
        want = 1500
    assert value(spark, G.elevation_proxy(*lits(lat, lon))) == want


@pytest.mark.parametrize("river, meets", [
    ((0.0, 1.0, 1.0, 0.0), (0.5, 0.5)),     # plain crossing
    ((1.0, 1.0, 2.0, 0.0), (1.0, 1.0)),     # touches at an end
    ((0.0, 0.1, 1.0, 1.1), None),           # parallel
    ((2.0, 3.0, 3.0, 2.0), None),           # beyond the end
])
def test_intersection(spark, river, meets):
    got = value(spark, G.intersection(*lits(0.0, 0.0, 1.0, 1.0), *lits(*river)))
    assert (got and (got["lat"], got["lon"])) == meets


@pytest.mark.parametrize("point, want", [((1.0, 0.5), 1.0), ((0.0, -2.0), 2.0), ((0.0, 3.0), 2.0)])
def test_point_segment(spark, point, want):
    assert value(spark, G.point_segment_degrees(*lits(*point), *lits(0.0, 0.0, 0.0, 1.0))) == want


def test_point_segment_of_zero_length(spark):
    assert value(spark, G.point_segment_degrees(*lits(3.0, 4.0, 0.0, 0.0, 0.0, 0.0))) == 5.0


@pytest.mark.parametrize("x, want", [(2.5, 3.0), (-2.5, -3.0), (2.4, 2.0), (-0.4, 0.0)])
def test_round_places(spark, x, want):
    assert value(spark, G.round_places(F.lit(x), 0)) == want


@pytest.mark.parametrize("levels, want", [([], 50), ([5], 50), ([0, 0], 30), ([0, 1000, 0], 100), ([0, 100, 50], 35)])
def test_terrain_risk(spark, levels, want):
    array = F.array(*lits(*levels)) if levels else F.array().cast("array<int>")
    assert value(spark, R.terrain_risk(array)) == want


@pytest.mark.parametrize("mm, level, want", [(1500.0, 2000, 57), (1500.0, 2001, 67), (1500.0, 2501, 72), (9000.0, 3000, 100)])
def test_rainfall_risk(spark, mm, level, want):
    assert value(spark, R.rainfall_risk(*lits(mm, level))) == want


@pytest.mark.parametrize("level, km, want", [
    (799, None, 75), (800, 3.0, 55), (1200, 2.9, 45), (1800, 0.5, 45), (2500, 1.0, 25), (700, 0.1, 95),
])
def test_flood_risk(spark, level, km, want):
    assert value(spark, R.flood_risk(F.lit(level), F.lit(km).cast("double"))) == want


@pytest.mark.parametrize("score, factor, want", [(0, 30, 30), (0, 0, 50), (None, None, 50), (70, 10, 70)])
def test_displayed_risk_skips_zero(spark, score, factor, want):
    assert value(spark, R.displayed_risk(F.lit(score).cast("int"), F.lit(factor).cast("int"))) == want


@pytest.mark.parametrize("km, want", [(0.0, 1), (14.9, 1), (15.0, 2), (40.0, 2), (70.0, 3), (500.0, 5)])
def test_estimated_bridges(spark, km, want):
    assert value(spark, C.estimated_bridges(F.lit(km))) == want


@pytest.mark.parametrize("highway, surface, kind, factor", [
    (None, None, "new_construction", 1.0), ("trunk_link", "gravel", "upgrade_existing", 0.3),
    ("tertiary", "paved", "upgrade_existing", 0.5), ("track", "concrete", "upgrade_existing", 0.4),
    ("track", "gravel", "upgrade_existing", 0.7),
])
def test_segment_class(spark, highway, surface, kind, factor):
    h, s = F.lit(highway).cast("string"), F.lit(surface).cast("string")
    assert value(spark, C.construction_type(h)) == kind
    assert value(spark, C.cost_factor(h, s)) == factor


def test_duration_rounds_halves_to_even(spark):
    assert value(spark, C.curve_duration_days(*lits(1 / 6, 0, 0))) == 2
    assert value(spark, C.network_duration_days(F.lit(2.9))) == 5


@pytest.mark.parametrize("depth, area, kind", [(2.0, 17.0, "cut"), (-2.0, 19.0, "fill"), (0.0, 0.0, "balanced")])
def test_sections(spark, depth, area, kind):
    assert value(spark, E.section_area(F.lit(depth))) == area
    assert value(spark, E.section_type(F.lit(depth))) == kind


def test_gradient_cap_and_status(spark):
    assert value(spark, E.capped_gradient(E.natural_gradient(*lits(0, 500, 1000)))) == 10.0
    assert value(spark, E.natural_gradient(*lits(0, 500, 0))) == 0.0
    assert value(spark, E.balance_status(*lits(500.0, 1500.0))) == "excess_fill"
    assert value(spark, E.status_title(F.lit("excess_cut"))) == "Excess Cut"


@pytest.mark.parametrize("volume, want", [(999, "999 m³"), (1500, "1.5K m³"), (2_340_000, "2.34M m³")])
def test_volume_text(spark, volume, want):
    assert value(spark, T.volume_text(F.lit(volume))) == want


@pytest.mark.parametrize("x, want", [(78.0, "78"), (78.12346, "78.12346"), (23311123.5, "23311123.5"), (100.0, "100"), (0.0, "0")])
def test_plain_number(spark, x, want):
    assert value(spark, T.plain_number(F.lit(x))) == want


def test_names_and_prompt(spark):
    assert value(spark, T.file_name(F.lit("Shortest  Route"), "kml")) == "Shortest_Route_route.kml"
    none = F.lit(None).cast("double")
    prompt = value(spark, T.explanation_prompt(F.lit("A"), none, none, none, none, none, F.lit("why")))
    assert "Distance: 0 km" in prompt and "Risk Score: 50/100" in prompt and prompt.count("%") == 0
