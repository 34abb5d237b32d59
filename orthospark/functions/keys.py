"""Object keys: filters, parsers and layouts, as columns.

A Layout is a pair of functions from a key column to columns, so a user's own layout stays inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file name of an orthoimage tile, and tokens of keys that are no images.
TILE_NAME = r"(?i)^(?:m_)?(\d{7})_(ne|nw|se|sw)_(\d{1,2})_([a-z0-9]+)(?:_(\d{8})(?:_(\d{8}))?)?\.tif$"
KY_NAME = r"^(.+?)_(\d{4})(?:_Season(\d))?_([0-9A-Za-z]+)_cog\.tif$"
KY_EXCLUDED = ("Overviews", "Metadata", "TileGrid", "County-Mosaics", "FlightInformationData")
ADHOC_EXCLUDED = ("Metadata", "TileGrid", "Overviews", "archive", "LogFiles")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def segment(key: Column, n: int) -> Column:
    """The n-th segment from 1, or from the end if negative; null if there is none."""
    return F.try_element_at(F.split(key, "/"), F.lit(n))


def manifest_fields(key: Column) -> Column:
    """state, year, resolution, product, quad and file name of `state/year/resolution/product/quad/.../file`; null if it isn't one."""
    fits = (F.size(F.split(key, "/")) >= 5) & (F.length(segment(key, 1)) == 2) & segment(key, 2).rlike("^[0-9]+$")
    return F.when(fits, F.struct(segment(key, 1).alias("state"), segment(key, 2).cast("int").alias("year"), segment(key, 3).alias("resolution"), segment(key, 4).alias("product_family"), segment(key, 5).alias("quad"), segment(key, -1).alias("filename")))


def tile_fields(name: Column) -> Column:
    """Fields of a tile's file name; null if it doesn't match."""
    part = lambda i: null_if_empty(F.regexp_extract(name, TILE_NAME, i))
    date = lambda i: F.try_to_date(part(i), "yyyyMMdd")
    return F.when(name.rlike(TILE_NAME), F.struct(part(1).alias("apfo_name"), F.upper(part(2)).alias("quadrant"), part(3).alias("zone"), part(4).alias("resolution_token"), date(5).alias("acquisition_date"), date(6).alias("verification_date")))


def has_none_of(key: Column, tokens: tuple[str, ...]) -> Column:
    return ~key.rlike("|".join(tokens))


def year_folder(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.cast("int"))


@dataclass(frozen=True)
class Layout:
    """keep: which keys are images; region, year and properties (a map) of a key, null where it doesn't parse."""

    id: str
    bucket: str
    access: str
    keep: Callable[[Column], Column]
    region: Callable[[Column], Column]
    year: Callable[[Column], Column]
    properties: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    prefix: Callable[[str | None, int | None], str] = lambda region, year: ""

    def parsed(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """(key, collection, region, year, properties) of the keys that are this layout's images."""
        c = F.col(key)
        rows = keys.where(self.keep(c)).select(c.alias("key"), F.lit(self.id).alias("collection"), self.region(c).alias("region"), self.year(c).alias("year"), F.map_filter(F.create_map(*[x for n, f in self.properties.items() for x in (F.lit(n), f(c))]), lambda _, v: v.isNotNull()).alias("properties"))
        return rows.where("region is not null and year is not null")


def stem(key: Column, pattern: str = r"\.tif$") -> Column:
    return F.regexp_replace(segment(key, -1), pattern, "")


def ky_part(i: int) -> Callable[[Column], Column]:
    return lambda key: null_if_empty(F.regexp_extract(segment(key, -1), KY_NAME, i))


LAYOUTS = {
    x.id: x
    for x in (
        Layout("naip", "naip-analytic", "requester-pays", lambda k: k.endswith(".tif") & k.contains("/rgbir_cog/"), lambda k: manifest_fields(k)["state"], lambda k: manifest_fields(k)["year"],
               {"resolution_dir": lambda k: segment(k, 3), "product_family": lambda k: segment(k, 4), "spatial_prefix": lambda k: segment(k, 5)}, lambda r, y: f"{r}/" + (f"{y}/" if y else "")),
        Layout("kyfromabove", "kyfromabove", "public", lambda k: k.endswith("_cog.tif") & has_none_of(k, KY_EXCLUDED), lambda k: F.when(segment(k, -1).rlike(KY_NAME), F.lit("ky")), lambda k: ky_part(2)(k).cast("int"),
               {"phase": lambda k: segment(k, 3), "kyaped:resolution": ky_part(4), "season": lambda k: F.coalesce(ky_part(3)(k), null_if_empty(F.regexp_extract(segment(k, 4), r"Season(\d)", 1))), "kyaped:tile": ky_part(1)}),
        Layout("nj-imagery", "njogis-imagery", "public", lambda k: k.endswith(".tif") & k.contains("/cog/"), lambda k: F.when(F.size(F.split(k, "/")) >= 3, F.lit("nj")), lambda k: year_folder(segment(k, 1)), {"njgin:tile": stem}, lambda r, y: f"{y}/cog/" if y else ""),
        Layout("in-imagery", "gisimageryingov", "public", lambda k: k.endswith(".tif") & k.contains("imageryoptimized/statewide/"), lambda k: F.when(F.size(F.split(k, "/")) >= 6, F.lit("in")), lambda k: year_folder(segment(k, 3)),
               {"in:tile": stem, "in:zone": lambda k: segment(k, 4), "in:resolution": lambda k: segment(k, 5)}, lambda r, y: "imageryoptimized/statewide/" + (f"{y}/" if y else "")),
    )
}
#: Buckets of other access, and buckets without images.
REQUESTER_PAYS, NO_IMAGES = {"naip-analytic", "naip-visualization", "naip-source"}, {"naip-manifest"}


def adhoc_layout(id: str, bucket: str, prefix: str, region: str, year: int, access: str) -> Layout:
    """A layout for one prefix of a bucket with a fixed region and year."""
    name = bucket.replace("s3://", "").split("/")[0]
    if name in NO_IMAGES:
        raise ValueError(f"{name} has no images")
    base = prefix.strip()
    return Layout(id, name, "requester-pays" if name in REQUESTER_PAYS else access, lambda k: F.lower(k).rlike(r"\.tiff?$") & has_none_of(k, ADHOC_EXCLUDED), lambda k: F.lit(region.lower()), lambda k: F.lit(int(year)), {"tile": lambda k: stem(k, r"\.tiff?$")}, lambda r, y: base if not base or base.endswith("/") else base + "/")


def product(family: Column) -> Column:
    """Lower case, without one trailing _cog or _cogs; null if nothing is left."""
    return null_if_empty(F.regexp_replace(F.lower(family), "_cogs?$", ""))


def epsg_code(code: Column, legacy: Column) -> Column:
    return F.coalesce(null_if_empty(F.regexp_extract(F.trim(code), r"(?i)^EPSG:(\d+)$", 1)).try_cast("int"), legacy.try_cast("int"))


def source_year(*texts: Column) -> Column:
    """The first 19xx or 20xx in the first text that is present."""
    return null_if_empty(F.regexp_extract(F.coalesce(*texts), r"\b((?:19|20)\d{2})\b", 1)).cast("int")


def source_region(*texts: Column) -> Column:
    return F.coalesce(F.lower(F.coalesce(*texts)), F.lit("default"))


def resolved_template(template: Column, key: Column) -> Column:
    """The template's {name} segments replaced, by position, with the key's."""
    return F.array_join(F.zip_with(F.split(template, "/"), F.split(key, "/"), lambda t, k: F.when(t.rlike(r"^\{.*\}$"), F.coalesce(k, F.lit(""))).otherwise(t)), "/")


def resolution_label(meters: Column) -> Column:
    whole = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    return F.when(meters <= 0, None).when(meters >= 1, F.concat(whole(meters), F.lit(" m"))).otherwise(F.concat(F.floor(meters * 100 + 0.5).cast("string"), F.lit(" cm")))


def https_url(href: Column, region: str) -> Column:
    return F.regexp_replace(href, r"^s3://([^/]+)/(.+)$", f"https://$1.s3.{region}.amazonaws.com/$2")


def gpkg_wkb(blob: Column) -> Column:
    """The WKB behind a GeoPackage header: bits 1 to 3 of its flags byte give the envelope's length."""
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    size = F.element_at(F.array(*[F.lit(x) for x in (0, 32, 48, 48, 64)]), F.shiftright(flags, 1).bitwiseAND(F.lit(7)) + 1)
    return F.substr(blob, size + 9)


def sanitized(c: Column, default: str, pattern: str = "[^a-z0-9_-]") -> Column:
    return F.coalesce(null_if_empty(F.regexp_replace(F.lower(c), pattern, "")), F.lit(default))
