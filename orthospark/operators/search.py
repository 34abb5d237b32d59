"""Catalog search: predicates, order, limit and STAC features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.keys import sanitized
from . import predicates

# STAC version and extensions.
STAC_VERSION = "1.0.0"
PROJECTION = "https://stac-extensions.github.io/projection/v2.0.0/schema.json"
GRID = "https://stac-extensions.github.io/grid/v1.1.0/schema.json"
MEDIA_TYPE = "image/tiff; application=geotiff; profile=cloud-optimized"


def ordered(df: DataFrame, limit: int) -> DataFrame:
    """Newest first, then finest; the key makes the order total.  A limit under 1 counts as 1, one over 18,000 as 18,000."""
    return df.orderBy(F.desc("year"), F.desc_nulls_last("acquisition_date"), F.asc_nulls_last("gsd"), F.asc("source_key")).limit(min(max(limit, 1), 18_000))


def search(lake: DataFrame, box: tuple[float, float, float, float], region: str | None = None, year: int | None = None, limit: int = 1000, ring: Column | None = None) -> DataFrame:
    """Rows of the lake in a box, of a year or else of each region's newest one, in order."""
    if region is not None:
        lake = lake.where(F.col("region") == sanitized(F.lit(region), "", "[^a-z0-9]"))
    found = predicates.within(lake, *box)
    if ring is not None:
        found = predicates.meeting(lake, ring, *box)
    found = found.where(F.col("year") == year) if year is not None else predicates.of_latest_year(found, predicates.latest_years(lake))
    return ordered(found, limit)


#: Stands for a datetime that is null, which JSON keeps while other null fields are dropped; within a JSON string its quotes would be escaped.
_NO_DATE = "-"


def item_properties(extra: tuple[str, ...] = ("naip:resolution", "naip:product", "naip:quad")) -> Column:
    """An Item's properties; null ones are dropped by to_json but for `datetime`, which is null if only the year is known."""
    day = F.date_format("acquisition_date", "yyyy-MM-dd'T00:00:00Z'")
    whole_year = F.col("acquisition_date").isNull() & F.col("year").isNotNull()
    of_year = lambda rest: F.when(whole_year, F.concat(F.col("year").cast("string"), F.lit(rest)))
    own = {name: F.get_json_object("properties", f"$['{name}']") for name in extra}
    fields = {
        "datetime": F.coalesce(day, F.lit(_NO_DATE)), "start_datetime": of_year("-01-01T00:00:00Z"), "end_datetime": of_year("-12-31T23:59:59Z"), "gsd": F.col("gsd"), "region": F.col("region"), "year": F.col("year"), "naip:state": F.col("region"), "naip:year": F.col("year"),
        "proj:code": F.concat(F.lit("EPSG:"), F.col("proj_epsg").cast("string")), "proj:shape": F.col("proj_shape"), **own, "grid:code": F.concat(F.lit("DOQQ-"), own["naip:quad"]) if "naip:quad" in own else F.lit(None).cast("string"),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def features(df: DataFrame) -> DataFrame:
    """(id, feature): each row as a STAC Item in JSON, one nested structure written at once."""
    box = predicates.box_of()
    extensions = F.filter(F.array(F.when(F.col("proj_epsg").isNotNull() | F.col("proj_shape").isNotNull(), F.lit(PROJECTION)), F.when(F.get_json_object("properties", "$['naip:quad']").isNotNull(), F.lit(GRID))), lambda x: x.isNotNull())
    id = F.concat_ws("/", "source_bucket", "source_key")
    fields = {
        "type": F.lit("Feature"), "stac_version": F.lit(STAC_VERSION), "stac_extensions": extensions, "id": id, "collection": F.col("collection"), "geometry": geo.ring_geometry(geo.box_ring(box)), "bbox": F.array(*box), "properties": item_properties(),
        "links": F.array(F.struct(F.lit("collection").alias("rel"), F.lit("application/json").alias("type"), F.concat(F.lit("/collections/"), F.col("collection")).alias("href"))),
        "assets": F.struct(F.struct(F.col("asset_href").alias("href"), F.lit(MEDIA_TYPE).alias("type"), F.array(F.lit("data")).alias("roles")).alias("image")),
    }
    text = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(id.alias("id"), F.replace(text, F.lit(f'"datetime":"{_NO_DATE}"'), F.lit('"datetime":null')).alias("feature"))


def stac_index(lake: DataFrame, target: str) -> DataFrame:
    """Lake rows as index rows: JSON properties in which the lake's own win, JSON assets, and href and gsd beside them."""
    day = F.date_format("acquisition_date", "yyyy-MM-dd'T00:00:00Z'")
    computed = F.to_json(F.struct(day.alias("datetime"), "gsd", "region", "year", F.col("proj_epsg").alias("proj:epsg"), F.col("proj_shape").alias("proj:shape")))
    own = F.map_filter(F.from_json("properties", "map<string,string>"), lambda _, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(F.from_json(computed, "map<string,string>"), lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))), F.coalesce(own, F.create_map().cast("map<string,string>")))
    assets = F.to_json(F.struct(F.struct(F.col("asset_href").alias("href"), F.lit(MEDIA_TYPE).alias("type"), F.array(F.lit("data")).alias("roles")).alias("data")))
    return lake.select(F.concat(F.lit(target + "/"), "source_key").alias("id"), F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"), day.alias("datetime"), merged.alias("properties"), assets.alias("assets"), "asset_href", "gsd", F.lit(target).alias("collection"), "region", "year")
