"""Building the catalog: discovery rows, enrichment, fallbacks, completeness and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import keys as K


def listed(keys: DataFrame) -> DataFrame:
    """Manifest lines that are images, with the fields of their key."""
    rows = keys.where(F.col("key").like("%/rgbir_cog/%") & F.col("key").like("%.tif"))
    return rows.select("key", K.manifest_fields(F.col("key")).alias("f")).where("f is not null").select(F.col("key").alias("source_key"), "f.*")


def enriched(listing: DataFrame, items: DataFrame, on: str = "asset_href") -> tuple[DataFrame, DataFrame]:
    """(listing rows with their item's columns, rows without an item): the second need their headers read."""
    return listing.join(items, on), listing.join(items.select(on), on, "left_anti")


def sidecars(keys: DataFrame) -> DataFrame:
    """Images with the key of their metadata sidecar: the last line of a base wins."""
    parts = keys.select("line_no", "key", F.split("key", "/").alias("p")).where((F.size("p") >= 5) & (F.length(F.col("p")[0]) == 2) & F.col("p")[1].rlike("^[0-9]+$"))
    fields = [F.col("p")[i].alias(n) for i, n in ((0, "state"), (2, "resolution"), (3, "product_family"))]
    parsed = parts.select("line_no", "key", *fields, F.col("p")[1].cast("int").alias("year"), F.element_at("p", -1).alias("filename"))
    image = parsed.where((F.col("product_family") == "rgbir_cog") & F.col("filename").endswith(".tif")).withColumn("base", F.regexp_replace("filename", r"\.tif$", ""))
    meta = parsed.where((F.col("product_family") == "fgdc") & F.col("filename").rlike(r"\.(xml|txt)$")).withColumn("base", F.regexp_replace("filename", r"\.(xml|txt)$", ""))
    base = ["state", "year", "resolution", "base"]
    return image.join(meta.groupBy(*base).agg(F.max_by("key", "line_no").alias("metadata_key")), base, "left").select(F.col("key").alias("source_key"), *base, "metadata_key")


def completeness(listing: DataFrame, got: DataFrame, by: tuple[str, ...] = ("region", "year")) -> DataFrame:
    """Per listed group: listed, ingested, dropped, percent, and whether it is incomplete."""
    have = got.groupBy(*by).agg(F.count("*").alias("got"))
    rows = listing.groupBy(*by).agg(F.count("*").alias("listed")).join(have, list(by), "left").withColumn("ingested", F.coalesce("got", F.lit(0)))
    return rows.select(*by, "listed", "ingested", (F.col("listed") - F.col("ingested")).alias("dropped"), F.round(F.col("ingested") * 100.0 / F.col("listed"), 6).alias("pct"), (F.col("ingested") < F.col("listed")).alias("incomplete"))


def require_complete(report: DataFrame) -> None:
    """Raises if any group fell short; only those groups come to the driver, and at most 20 of them."""
    short = report.where("incomplete").limit(20).collect()
    if short:
        raise ValueError("incomplete: " + ", ".join(str(tuple(r)) for r in short))


def capped(df: DataFrame, by: tuple[str, ...], order: str, n: int) -> DataFrame:
    """The first n of each group in order; 0 is no cap."""
    if n <= 0:
        return df
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def cog_structure(headers: DataFrame, enabled: bool = True) -> DataFrame:
    """reason is null where a header has tiles and, if it is large, overviews; a header whose directories can't be counted has one."""
    longest, directories = F.greatest("width", "height"), F.coalesce("ifd_count", F.lit(1))
    reason = F.when(F.col("tile_width").isNull(), "no internal tiling").when((longest > 512) & (directories < 2), "no overviews")
    return headers.withColumn("reason", reason if enabled else F.lit(None).cast("string"))


def georeference(headers: DataFrame) -> DataFrame:
    """reason is null where a header places its image."""
    user = F.col("epsg").isin(32767, 0)
    return headers.withColumn("reason", F.when(F.col("scale_x").isNull(), "no pixel scale").when(F.col("tie_x").isNull(), "no tie point").when(F.col("epsg").isNull(), "no CRS").when(user & F.col("citation").isNull(), "user-defined CRS"))


def uniform_samples(headers: DataFrame, depths: tuple[int, ...] = (8, 16, 32, 64)) -> DataFrame:
    """reason is null where all samples have one format and one allowed depth."""
    reason = F.when(F.size(F.array_distinct("formats")) > 1, "mixed sample formats").when(F.size(F.array_distinct("bits")) > 1, "mixed bit depths").when(~F.col("bits")[0].isin(*depths), "bit depth")
    return headers.withColumn("reason", reason)


def newest_by_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: the last in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())
