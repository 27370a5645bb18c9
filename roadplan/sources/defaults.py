"""Built-in dimension rows, used when no file is given or readable."""

from pyspark.sql import DataFrame, SparkSession

# Tourism spots as (name, lat, lon, type, score, description).
TOURISM_SPOTS = [
    ("Gangotri Temple", 30.9993, 78.9394, "char_dham", 20, "Source of Ganges"),
    ("Yamunotri Temple", 31.0117, 78.4270, "char_dham", 20, "Source of Yamuna"),
    ("Kedarnath Temple", 30.7346, 79.0669, "char_dham", 20, "Jyotirlinga"),
    ("Badrinath Temple", 30.7433, 79.4938, "char_dham", 20, "Vishnu Temple"),
    ("Neelkanth Mahadev", 30.1167, 78.2833, "temple", 10, "Shiva Temple"),
    ("Tungnath Temple", 30.4897, 79.2122, "temple", 10, "Highest Shiva Temple"),
    ("Rudranath Temple", 30.5333, 79.3167, "temple", 9, "Panch Kedar"),
    ("Valley of Flowers", 30.7167, 79.6000, "natural", 15, "UNESCO World Heritage"),
    ("Hemkund Sahib", 30.7167, 79.6167, "pilgrimage", 15, "Sikh Pilgrimage"),
    ("Auli Ski Resort", 30.5370, 79.5840, "tourism", 12, "Winter Sports"),
    ("Har Ki Dun Valley", 31.1167, 78.4500, "viewpoint", 8, "Trekking Destination"),
    ("Dayara Bugyal", 30.9167, 78.5833, "viewpoint", 8, "Alpine Meadow"),
    ("Uttarkashi Town", 30.7268, 78.4354, "town", 15, "District HQ"),
    ("Barkot", 30.8167, 78.2000, "town", 10, "Market Town"),
    ("Purola", 30.9333, 78.1167, "town", 8, "Trading Hub"),
]

# Major routes as (name, start lat, start lon, end lat, end lon, type).
MAJOR_ROUTES = [
    ("NH-108", 30.1, 78.3, 31.0, 78.9, "highway"),
    ("SH-123", 30.5, 78.5, 30.8, 78.8, "state_highway"),
]

# Rivers as (name, [(lon, lat), ...]).
RIVERS = [
    ("Song River", [(78.0, 30.2), (78.1, 30.3), (78.2, 30.4), (78.3, 30.5), (78.4, 30.6)]),
    ("Asan River", [(78.6, 30.5), (78.65, 30.52), (78.7, 30.54), (78.75, 30.56), (78.8, 30.58)]),
    ("Tons River (Dehradun)", [(78.5, 30.45), (78.55, 30.48), (78.6, 30.51), (78.65, 30.54)]),
    ("Rispana River", [(78.65, 30.55), (78.68, 30.57), (78.71, 30.59), (78.74, 30.61)]),
    ("Bindal River", [(78.7, 30.5), (78.72, 30.53), (78.74, 30.56), (78.76, 30.59)]),
    ("Bhagirathi River", [(78.4354, 30.7268), (78.5500, 30.8500), (78.6500, 30.9000), (78.9394, 30.9993)]),
    ("Yamuna River", [(78.2000, 30.8167), (78.3000, 30.9000), (78.3500, 30.9500), (78.4270, 31.0117)]),
    ("Asi Ganga", [(78.5000, 30.7500), (78.5500, 30.8000), (78.6000, 30.8500)]),
    ("Jadh Ganga", [(78.6000, 30.9000), (78.6500, 30.9300), (78.7000, 30.9500)]),
    ("Tons River", [(78.1167, 30.9333), (78.2000, 30.9000), (78.3000, 30.8500)]),
    ("Kali River", [(78.3, 30.6), (78.35, 30.65), (78.4, 30.7)]),
    ("Bhilangana River", [(78.8, 30.7), (78.85, 30.75), (78.9, 30.8)]),
]

# Settlements as (name, place, lon, lat, population).
SETTLEMENTS = [
    ("Uttarkashi", "town", 78.4354, 30.7268, 15000),
    ("Barkot", "town", 78.2000, 30.8167, 8000),
    ("Purola", "town", 78.1167, 30.9333, 5000),
    ("Mori", "town", 78.5833, 30.9167, 3000),
    ("Gangnani", "village", 78.5500, 30.8500, 1500),
    ("Harsil", "village", 78.6500, 30.9000, 2000),
    ("Dharali", "village", 78.7500, 30.9500, 800),
    ("Mukhba", "village", 78.8500, 30.9800, 600),
    ("Naugaon", "village", 78.3000, 30.9000, 1200),
    ("Hanuman Chatti", "village", 78.3500, 30.9500, 500),
    ("Janki Chatti", "village", 78.4000, 31.0000, 400),
    ("Chinyalisaur", "village", 78.3500, 30.7500, 2500),
    ("Maneri", "village", 78.5000, 30.7000, 1800),
    ("Uttarkashi Block", "village", 78.6000, 30.8000, 1000),
    ("Naugaon Block", "village", 78.2500, 30.8500, 900),
    ("Dunda", "village", 78.4500, 30.9500, 700),
    ("Bagori", "village", 78.5500, 30.9500, 650),
    ("Dhanaulti", "village", 78.3000, 30.8000, 1100),
    ("Jhala", "village", 78.7000, 30.9200, 550),
    ("Sukhi", "village", 78.8000, 30.9600, 450),
    ("Tehri", "village", 78.6500, 30.7500, 2200),
]

# End points of a request that leaves them out.
DEFAULT_START = (30.7268, 78.4354)
DEFAULT_END = (30.9993, 78.9394)

# Both ends of every major route as (lat, lon). Fixed value: the half-width around them in degrees.
CORRIDOR_ENDS = [end for _, *at, _ in MAJOR_ROUTES for end in (tuple(at[:2]), tuple(at[2:]))]
CORRIDOR_DEGREES = 0.05


def tourism_spots(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(TOURISM_SPOTS)]
    return spark.createDataFrame(
        rows, "feature_seq int, name string, lat double, lon double, type string, score int, description string"
    )


def major_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MAJOR_ROUTES,
        "name string, start_lat double, start_lon double, end_lat double, end_lon double, type string",
    )


def river_vertices(spark: SparkSession) -> DataFrame:
    rows = [
        (river_id, name, "river", seq, lat, lon)
        for river_id, (name, line) in enumerate(RIVERS)
        for seq, (lon, lat) in enumerate(line)
    ]
    return spark.createDataFrame(
        rows, "river_id bigint, name string, waterway string, seq int, lat double, lon double"
    )


def settlements(spark: SparkSession) -> DataFrame:
    rows = [(i, name, place, lat, lon, pop) for i, (name, place, lon, lat, pop) in enumerate(SETTLEMENTS)]
    return spark.createDataFrame(
        rows, "feature_seq bigint, name string, place string, lat double, lon double, population int"
    )
