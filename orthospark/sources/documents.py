"""Text sources: CRS tables, collection registries and landed STAC pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo


def crs_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, wkt) of `code|wkt` lines, cut at the first bar, and the lines that aren't; empty lines are skipped."""
    rows = lines.where(F.length(F.trim("value")) > 0).withColumn("p", F.split("value", r"\|", 2))
    good = (F.size("p") == 2) & F.col("p")[0].try_cast("int").isNotNull()
    return rows.where(good).select(F.col("p")[0].cast("int").alias("code"), F.col("p")[1].alias("wkt")), rows.where(~good).select("value")


def collections(registry: DataFrame) -> DataFrame:
    """Registry entries with an extent and images, each with its closed ring."""
    box = tuple(F.col(n) for n in ("west", "south", "east", "north"))
    rows = registry.where((F.col("status") != "excluded-not-cog") & box[0].isNotNull())
    return rows.select("id", F.coalesce("title", "id").alias("title"), "active", "status", "bucket", geo.box_ring(box).alias("ring"))


PAGE = "features array<struct<id:string,bbox:array<double>,properties:struct<datetime:string>,assets:struct<image:struct<href:string>>>>"


def stac_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row an item of landed result pages: (asset_href, id, datetime, page); the last page of an href wins."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("page"), F.posexplode("features").alias("n", "f"))
    rows = pages.select(F.col("f.assets.image.href").alias("asset_href"), F.col("f.id").alias("id"), F.col("f.properties.datetime").alias("datetime"), "page", "n").where("asset_href is not null")
    last = F.row_number().over(W.partitionBy("asset_href").orderBy(F.desc("page"), F.desc("n")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "n")
