"""Column expressions for places on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Radii of the earth in use, in miles and metres. They differ, and results depend on which is taken.
MILES, METRES_MEAN, METRES_ROUND = 3958.8, 6371008.8, 6371000.0


def great_circle(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float, radius: float = MILES) -> Column:
    """M1, M2: distance on a sphere; rounding is clamped, a missing coordinate gives null."""
    lat2, lon2 = (F.lit(x) if isinstance(x, float | int) else x for x in (lat2, lon2))
    h = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat2)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    whole = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(whole, radius * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M3: distance in degrees on a plane."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def squared_difference(pairs: list[tuple[Column, Column]]) -> Column:
    """M4: squared distance over dimensions, a missing value as zero."""
    out = F.lit(0.0)
    for a, b in pairs:
        out = out + F.pow(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 2)
    return out


def bounded(lat: Column, lon: Column) -> Column:
    """coordinates that exist on earth."""
    return lat.between(-90, 90) & lon.between(-180, 180)


def in_envelope(lat: Column, lon: Column) -> Column:
    """within the served area, which reaches over the antimeridian; (0, 0) and missing coordinates are outside."""
    inside = lat.between(-15, 72) & (lon.between(-180, -64) | lon.between(144, 180)) & ~((lat == 0) & (lon == 0))
    return F.coalesce(inside, F.lit(False))


def cell(column: Column, places: int = 4) -> Column:
    """M5: the grid line of a coordinate."""
    return F.round(column, places)


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Equal up to a tolerance."""
    return F.abs(a - b) <= tolerance


def tiles(spark: SparkSession, south: float, west: float, north: float, east: float, rows: int, columns: int) -> DataFrame:
    """The tiles of a grid over a box: tile, south, west, north, east."""
    height, width = (north - south) / rows, (east - west) / columns
    at = spark.range(rows * columns).withColumn("row", F.floor(F.col("id") / columns)).withColumn("column", F.col("id") % columns)
    return at.select(
        F.col("id").alias("tile"), (south + F.col("row") * height).alias("south"), (west + F.col("column") * width).alias("west"),
        (south + (F.col("row") + 1) * height).alias("north"), (west + (F.col("column") + 1) * width).alias("east"),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two vectors of one length, null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
