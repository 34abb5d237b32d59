"""Filters: boxes, polygons, newest years, regions and the validation of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

BOX = ("xmin", "ymin", "xmax", "ymax")


def box_of(names: tuple = BOX) -> tuple:
    return tuple(F.col(n) for n in names)


def within(df: DataFrame, west: float, south: float, east: float, north: float, names: tuple = BOX) -> DataFrame:
    """Rows whose box meets the given one; four comparisons that reach the Parquet scan."""
    xmin, ymin, xmax, ymax = box_of(names)
    return df.where((xmin <= east) & (xmax >= west) & (ymin <= north) & (ymax >= south))


def meeting(df: DataFrame, ring: Column, west: float, south: float, east: float, north: float, names: tuple = BOX) -> DataFrame:
    """Rows whose ring meets the box exactly; the box test goes first and reaches the scan."""
    return within(df, west, south, east, north, names).where(geo.ring_meets_box(ring, tuple(F.lit(float(v)) for v in (west, south, east, north))))


def latest_years(df: DataFrame, region: str = "region", year: str = "year") -> DataFrame:
    return df.groupBy(region).agg(F.max(year).alias(year))


def of_latest_year(df: DataFrame, latest: DataFrame | None = None, region: str = "region", year: str = "year") -> DataFrame:
    """Rows of their region's newest year; the years may be given, and else are an aggregate with a row a region."""
    return df.join(latest if latest is not None else latest_years(df, region, year), [region, year], "left_semi")


def valid_boxes(boxes: DataFrame, names: tuple = ("west", "south", "east", "north")) -> DataFrame:
    """Boxes of four finite numbers with west < east and south < north."""
    w, s, e, n = (F.col(x).try_cast("double") for x in names)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return boxes.where(finite(w) & finite(s) & finite(e) & finite(n) & (w < e) & (s < n))


def validated(requests: DataFrame, numbers: tuple = ("xmin_text",), limit: str = "limit_text", year: str = "year_text", default: int = 1000, most: int = 18_000) -> DataFrame:
    """requests and reason (null where valid), limit_value (capped) and year_value."""
    reason = F.lit(None).cast("string")
    for n in reversed(numbers):
        value = F.col(n).try_cast("double")
        reason = F.when(F.col(n).isNull(), F.lit("bbox is required")).when(value.isNull(), "bbox must be numbers").when(F.isnan(value) | (F.abs(value) == float("inf")), "bbox must be finite").otherwise(reason)
    n, y = F.col(limit).try_cast("int"), F.col(year).try_cast("int")
    reason = F.coalesce(reason, F.when(F.col(limit).isNotNull() & (n.isNull() | (n < 1)), "limit must be a positive integer"), F.when(F.col(year).isNotNull() & y.isNull(), "year must be an integer"))
    return requests.withColumns({"reason": reason, "limit_value": F.least(F.coalesce(n, F.lit(default)), F.lit(most)), "year_value": y})


def source_hrefs(df: DataFrame, registry: DataFrame, href: str = "href") -> DataFrame:
    """href, bucket and reason (null where it is a plain s3://bucket/key of a registered bucket)."""
    plain = F.col(href).rlike(r"^s3://[A-Za-z0-9.-]+/[^?#]+$")
    bucket = F.regexp_extract(href, r"^s3://([^/?#@:]+)/", 1)
    known = registry.where("active").select(F.col("bucket").alias("known")).distinct()
    return df.withColumn("bucket", F.when(plain, bucket)).join(known, F.col("bucket") == F.col("known"), "left").withColumn("reason", F.when(~plain, "not an s3 object").when(F.col("known").isNull(), "unknown bucket")).drop("known")
