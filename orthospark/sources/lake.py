"""The footprint lake: Parquet by collection, region and year, clustered along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..operators import stats
from .files import exists, removed, scratch, touch

KEYS = ["collection", "region", "year"]
ROW_GROUP = 2048
#: Most groups whose extents are broadcast.
MOST_GROUPS = 10_000
_FIELDS = {
    T.StringType(): ["source_bucket", "source_key", "asset_href", "properties"],
    T.DoubleType(): ["xmin", "ymin", "xmax", "ymax", "gsd"],
    T.DateType(): ["acquisition_date"],
    T.IntegerType(): ["proj_epsg"],
    T.ArrayType(T.IntegerType()): ["proj_shape"],
}
SCHEMA = T.StructType([T.StructField(n, kind) for kind, names in _FIELDS.items() for n in names] + [T.StructField("collection", T.StringType()), T.StructField("region", T.StringType()), T.StructField("year", T.IntegerType())])


def clustered(df: DataFrame, by: list[str] = KEYS, group: str = "region", bounds: list | None = None) -> DataFrame:
    """Rows dealt and sorted by keys, then by the Hilbert index of their centre within the group's extent; rows without a group are one group.

    The groups' extents are broadcast if there are at most MOST_GROUPS, and joined otherwise.
    """
    names = ("xmin", "ymin", "xmax", "ymax")
    extents = group_extents(df, group)
    bounds = extents.limit(MOST_GROUPS + 1).collect() if bounds is None else bounds
    if len(bounds) <= MOST_GROUPS:
        extents = F.broadcast(df.sparkSession.createDataFrame(bounds, extents.schema))
    h = geo.hilbert((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, tuple(F.col(f"_{n}") for n in names))
    placed = df.join(extents, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_h", h)
    return placed.repartitionByRange(*by, "_h").sortWithinPartitions(*by, "_h").select(*df.columns)


def group_extents(df: DataFrame, group: str = "region") -> DataFrame:
    return stats.extents(df, group).select(F.col(group).alias("_group"), *[F.col(n).alias(f"_{n}") for n in ("xmin", "ymin", "xmax", "ymax")])


def committed(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a replacement of this name has been carried out on the table."""
    return exists(spark, f"{path}/_commits/{token}")


def staged(spark: SparkSession, staging: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """The rows as a table of their own, written once: one that is complete is taken as it is, one that isn't is written anew."""
    if not exists(spark, f"{staging}/_SUCCESS"):
        rows().write.mode("overwrite").parquet(staging)
    return spark.read.parquet(staging)


def replaced(spark: SparkSession, path: str, staging: str, token: str, rows: Callable[[], DataFrame], put: Callable[[DataFrame], None]) -> int:
    """Replaces the partitions that the rows have, all or none of them; returns the rows written, 0 where the token says that it has been done.

    The rows are staged first and the staging is kept until the table has them and the commit is on record.  A call that failed, at any
    place, is repeated with the same staging and token: a complete staging is put again, from nothing of the table, so
    partitions that the failure left damaged become whole.
    """
    if committed(spark, path, token):
        return 0
    ready = staged(spark, staging, rows)
    n = ready.count()
    if n:
        put(ready)
        touch(spark, f"{path}/_commits/{token}")
    removed(spark, staging)
    return n


def write(df: DataFrame, path: str, row_group: int = ROW_GROUP, compression: str = "zstd", staging: str | None = None, token: str | None = None) -> int:
    """Replaces exactly the partitions that df has; returns the rows written.  An empty df writes nothing; rows without a region or year have partitions of their own.

    df is evaluated once, into the staging table; extents and ranges come from there.  With a staging folder and a token of one's own, a call that failed can be repeated (see replaced).
    """
    spark = df.sparkSession
    staging = staging or scratch(spark, "staging")

    def put(rows: DataFrame) -> None:
        bounds = group_extents(rows).limit(MOST_GROUPS + 1).collect()
        clustered(rows, bounds=bounds).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.row.count.limit", row_group).option("compression", compression).partitionBy(*KEYS).parquet(path)

    return replaced(spark, path, staging, token or staging.rpartition("/")[2], lambda: df.select([f.name for f in SCHEMA if f.name in df.columns]), put)


def scan(spark: SparkSession, path: str, collection: str, region: str | None = None, year: int | None = None) -> DataFrame:
    """The lake at the narrowest path that the request allows; what isn't there has no rows."""
    narrow = f"{path}/collection={collection}" + (f"/region={region}" if region else "") + (f"/year={year}" if region and year else "")
    if not exists(spark, narrow):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(narrow)
    return rows.where(F.col("year") == year) if year and not region else rows


def write_single(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    index.sortWithinPartitions("region", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.row.count.limit", row_group).option("compression", "zstd").partitionBy("region", "year").parquet(path)


def rebuild(listing: DataFrame, path: str) -> None:
    """A key index written anew as a whole, by state and year; a large partition is split over tasks, small ones share one."""
    listing.hint("rebalance", "state", "year").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("state", "year").parquet(path)


def put_keys(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "state", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state", "year").parquet(path)


def refresh(listing: DataFrame, path: str, since: int, dry_run: bool = False, staging: str | None = None, token: str | None = None) -> DataFrame:
    """Replaces the partitions of years from `since` that the listing has; returns their counts."""
    rows = listing.where(F.col("year") >= since)
    counts = rows.groupBy("state", "year").agg(F.count("*").alias("n"))
    if not dry_run:
        spark = listing.sparkSession
        staging = staging or scratch(spark, "staging")
        replaced(spark, path, staging, token or staging.rpartition("/")[2], lambda: rows, lambda ready: put_keys(ready, path))
    return counts


def migrate(old: DataFrame, path: str, collection: str) -> int:
    """A tree by state and naip_year in the present layout, product and resolution folded into the properties; raises unless all rows arrive."""
    properties = F.to_json(F.struct(F.col("product").alias("naip:product"), F.col("resolution").alias("naip:resolution")))
    rows = old.withColumnsRenamed({"state": "region", "naip_year": "year"}).withColumns({"properties": properties, "collection": F.lit(collection)})
    write(rows, path)
    before, after = old.count(), scan(old.sparkSession, path, collection).count()
    if before != after:
        raise ValueError(f"{after} rows of {before} arrived")
    return after


def feature_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    features.select(column).write.mode("overwrite").text(path)


def staged_merge(new: DataFrame, path: str, key: str, staging: str, token: str) -> int:
    """Adds rows to the partitions that they touch, one row a key: of several the new one, of several new ones the greatest; returns the rows of those partitions.

    What is read is staged before it is overwritten; a call that failed is repeated with the same staging and token (see replaced).
    """
    spark = new.sparkSession

    def rows() -> DataFrame:
        parts, both = new.select("state", "year").distinct(), new.withColumn("_new", F.lit(True))
        if exists(spark, path):
            have = spark.read.schema(new.schema).parquet(path)
            both = both.unionByName(have.join(parts, ["state", "year"], "left_semi").select(*new.columns, F.lit(False).alias("_new")))
        return both.groupBy(key).agg(F.max(F.struct("_new", *new.columns)).alias("row")).select(*[F.col(f"row.{c}") for c in new.columns])

    return replaced(spark, path, staging, token, rows, lambda ready: put_keys(ready.select(new.columns), path))


def is_stale(built: Column, source: Column) -> Column:
    return F.coalesce(built < source, F.lit(True))
