"""Coverage and availability statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import range_join

EXTENT = {"xmin": F.min, "ymin": F.min, "xmax": F.max, "ymax": F.max}


def extents(df: DataFrame, *by: str) -> DataFrame:
    """Union of boxes by group; of extents, their union."""
    return df.groupBy(*by).agg(*[f(n).alias(n) for n, f in EXTENT.items()])


def availability(lake: DataFrame) -> DataFrame:
    """Per region: years newest first, with each year's finest resolution, and the region's extent."""
    rows = lake.where("region is not null and year is not null").withColumn("region", F.lower(F.trim("region")))
    per_year = rows.groupBy("region", "year").agg(F.min("gsd").alias("gsd"), *[f(n).alias(n) for n, f in EXTENT.items()])
    years = F.sort_array(F.collect_list(F.struct("year", "gsd")), asc=False)
    return per_year.groupBy("region").agg(F.transform(years, lambda s: s["year"]).alias("years"), F.transform(years, lambda s: s["gsd"]).alias("gsds"), *[f(n).alias(n) for n, f in EXTENT.items()])


def overlap_fractions(targets: DataFrame, candidates: DataFrame, size: float, key: str = "idx", other: str = "other", least: float = 0.01, enough: float = 0.75) -> DataFrame:
    """Per target: how much of it its candidates cover, each by more than `least`, at most 1; and whether that is enough.

    targets have west, south, east, north; candidates o_west, o_south, o_east, o_north.
    """
    mine, theirs = ("west", "south", "east", "north"), ("o_west", "o_south", "o_east", "o_north")
    a, b = tuple(F.col(n) for n in mine), tuple(F.col(n) for n in theirs)
    pairs = range_join(targets, candidates, size, mine, theirs).where(F.col(key) != F.col(other))
    share = F.when(geo.box_area(a) > 0, geo.overlap_area(a, b) / geo.box_area(a)).otherwise(0.0)
    total = pairs.withColumn("share", share).where(F.col("share") > least).groupBy(key).agg(F.least(F.lit(1.0), F.round(F.sum("share"), 6)).alias("fraction"))
    return targets.select(key).join(total, key, "left").select(key, F.coalesce("fraction", F.lit(0.0)).alias("fraction")).withColumn("covered", F.col("fraction") >= enough)
