"""Queries that write lakes and indexes into scratch folders and read them back."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.keys import LAYOUTS
from ..operators import predicates, search, spatial, stats
from ..operators.catalog import listed
from ..sources import documents, files, headers, lake, parquet_index
from ..streaming.ingest import ingest_new_keys
from .registry import query


def lake_path(v) -> str:
    path = files.scratch(v.spark, "lake")
    lake.write(v.lake, path)
    return path


@query("select source_key, region, year, gsd from lake where region = 'nj' and year = 1995 union all select source_key, region, year, gsd from lake where year = 1996")
def scan_lake_partition(v):
    path = lake_path(v)
    parts = [lake.scan(v.spark, path, "naip", "nj", 1995), lake.scan(v.spark, path, "naip", "zz"), lake.scan(v.spark, path, "none"), lake.scan(v.spark, path, "naip", None, 1996)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.select("source_key", "region", "year", "gsd")


@query("select distinct region, year from lake")
def partition_values_from_paths(v):
    return files.partition_values(files.listed(v.spark.createDataFrame([(lake_path(v),)], "prefix string"), ".parquet"))


@query("select region, year, count(*) as n, sum(case when k % 2 = 0 then 1 else 0 end)::bigint as n_new from (select *, region = 'nj' as again from lake) group by 1, 2")
def write_lake(v):
    """A lake, of which one region's partitions are then replaced; the others stay."""
    path = lake_path(v)
    again = v.lake.where("region = 'nj'")
    lake.write(again, path)
    assert lake.write(again.limit(0), path) == 0
    number = F.regexp_extract("source_key", r"/m_(\d+)_", 1).cast("long")
    return v.spark.read.schema(lake.SCHEMA).parquet(path).groupBy("region", "year").agg(F.count("*").alias("n"), F.count_if(number % 2 == 0).alias("n_new"))


@query("select count(*) as n, cast(1 as bigint) as n_files from lake")
def write_single_file(v):
    path = files.scratch(v.spark, "single")
    lake.write_single(v.lake, path)
    return v.spark.read.parquet(path).agg(F.count("*").alias("n")).crossJoin(files.listing(v.spark, path, "*.parquet").agg(F.count("*").alias("n_files")))  # a row each


@query("""select concat('naip-v2/', source_key) as id, region, year, gsd, json_extract_string(properties,'$."naip:quad"') as quad from lake where region in ('nj','ca')""")
def write_stac_index(v):
    path = files.scratch(v.spark, "index")
    index = search.stac_index(v.lake.where(F.col("region").isin("nj", "ca")), "naip-v2").withColumn("properties", F.to_json("properties"))
    lake.write_index(index, path)
    return v.spark.read.parquet(path).select("id", "region", "year", "gsd", F.get_json_object("properties", "$['naip:quad']").alias("quad"))


@query("select split_part(key,'/',1) as state, cast(split_part(key,'/',2) as int) as year, count(*) as n from keys where key like '%/rgbir_cog/%' and key like '%.tif' and key not like '%notayear%' group by 1, 2")
def rebuild_manifest_index(v):
    path = files.scratch(v.spark, "keys")
    rows = listed(v.keys)
    lake.rebuild(rows.limit(10), path)
    lake.rebuild(rows, path)
    return v.spark.read.schema(rows.schema).parquet(path).groupBy("state", "year").agg(F.count("*").alias("n"))


@query("select region as state, year, sum(case when year >= 1996 then case when k % 3 = 0 then 1 else 0 end else 1 end)::bigint as n from footprints group by 1, 2")
def refresh_partitions(v):
    """An index whose partitions since 1996 are replaced by a listing of a third of the keys."""
    path = files.scratch(v.spark, "keys")
    rows = listed(v.keys)
    lake.rebuild(rows, path)
    half = rows.where(F.regexp_extract("filename", r"m_(\d+)_", 1).cast("long") % 3 == 0)
    lake.refresh(half, path, 1996)
    return v.spark.read.schema(rows.schema).parquet(path).groupBy("state", "year").agg(F.count("*").alias("n"))


@query("""select region, year, count(*) as n, count(distinct res) as n_resolutions from footprints group by 1, 2""")
def migrate_layout(v):
    old = v.lake.drop("properties", "collection").withColumnsRenamed({"region": "state", "year": "naip_year"}).withColumns({"product": F.lit("rgbir"), "resolution": F.split_part("source_key", F.lit("/"), F.lit(3))})
    path = files.scratch(v.spark, "lake")
    lake.migrate(old, path, "naip")
    rows = lake.scan(v.spark, path, "naip")
    return rows.groupBy("region", "year").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("properties", "$['naip:resolution']")).alias("n_resolutions"))


_CLIP = "xmin <= -90 and xmin + 0.0005 >= -100 and ymin <= 40 and ymin + 0.0005 >= 30"


@query(f"select count(*) as n, count(height) as n_height, round(min(xmin),6) as xmin, round(max(xmin + 0.0005),6) as xmax, 'buildings' as theme from buildings where {_CLIP}")
def export_clipped_buildings(v):
    b = v.buildings.select("id", "height", F.struct("xmin", "ymin", (F.col("xmin") + 0.0005).alias("xmax"), (F.col("ymin") + 0.0005).alias("ymax")).alias("bbox"))
    inside = b.where("bbox.xmin <= -90 and bbox.xmax >= -100 and bbox.ymin <= 40 and bbox.ymax >= 30").select("id", "height", "bbox.*", F.lit("buildings").alias("theme"))
    path = files.scratch(v.spark, "buildings")
    inside.write.option("compression", "zstd").parquet(path)
    rows = v.spark.read.parquet(path)
    return rows.agg(F.count("*").alias("n"), F.count("height").alias("n_height"), F.round(F.min("xmin"), 6).alias("xmin"), F.round(F.max("xmax"), 6).alias("xmax"), F.first("theme").alias("theme"))


def building_files(v) -> str:
    """Buildings sorted along a curve, in files of small row groups."""
    path = files.scratch(v.spark, "buildings")
    b = v.buildings.withColumns({"xmax": F.col("xmin") + 0.0005, "ymax": F.col("ymin") + 0.0005, "region": F.lit("us")})
    lake.clustered(b, ["region"]).write.option("parquet.block.row.count.limit", 512).parquet(path)
    return path


@query("select count(*) as num_rows, round(min(xmin),6) as xmin, round(max(ymin + 0.0005),6) as ymax from buildings")
def scan_parquet_footers(v):
    index = parquet_index.scan_footers(v.spark, building_files(v))
    return index.agg(F.sum("num_rows").alias("num_rows"), F.round(F.min("xmin"), 6).alias("xmin"), F.round(F.max("ymax"), 6).alias("ymax"))


@query("select count(*) as num_rows, 'us' as region from buildings")
def write_row_group_index(v):
    path = files.scratch(v.spark, "index")
    parquet_index.scan_footers(v.spark, building_files(v)).withColumns({"region": F.lit("us"), "release": F.lit("2025-01")}).write.parquet(path)
    return v.spark.read.parquet(path).agg(F.sum("num_rows").alias("num_rows"), F.first("region").alias("region"))


@query("select distinct b.id from buildings b join boxes x on b.xmin <= x.east and b.xmin + 0.0005 >= x.west and b.ymin <= x.north and b.ymin + 0.0005 >= x.south")
def read_by_row_group_index(v):
    path = building_files(v)
    rows = parquet_index.read(v.spark, parquet_index.scan_footers(v.spark, path), v.boxes, ["id", *spatial.BOX], 2.5, most=None)
    return spatial.semi_join_boxes(rows, v.boxes, "id", 2.5).select("id")


@query()
def total_row_groups_hit(v):
    hit = parquet_index.hits(parquet_index.scan_footers(v.spark, building_files(v)), v.boxes, 2.5)
    return hit.agg(F.countDistinct("file", "row_group").alias("row_groups"), F.countDistinct("file").alias("files"), F.sum("num_rows").alias("most_rows"))


@query("select region, count(*) as n, true as clustered from lake group by region")
def hilbert_cluster(v):
    """Rows along each region's curve: a step between neighbours is, on average, far below one between rows in key order."""
    from pyspark.sql import Window as W

    path = files.scratch(v.spark, "lake")
    lake.clustered(v.lake).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    rows = v.spark.read.parquet(path)

    def step(order):
        w = W.partitionBy("region", "year").orderBy(order)
        return F.hypot(F.col("xmin") - F.lag("xmin").over(w), F.col("ymin") - F.lag("ymin").over(w))

    steps = rows.select("region", step("place").alias("along"), step("source_key").alias("by_key"))
    return steps.groupBy("region").agg(F.count("*").alias("n"), (F.avg("along") < F.avg("by_key") * 0.7).alias("clustered"))


@query()
def row_group_locality(v):
    """Mean box of a row group as a share of the extent, clustered along the curve and in random order."""
    b = v.buildings.withColumns({"xmax": F.col("xmin") + 0.0005, "ymax": F.col("ymin") + 0.0005})
    shuffled = files.scratch(v.spark, "random")
    b.repartition(F.xxhash64("id")).sortWithinPartitions(F.xxhash64("id")).write.option("parquet.block.row.count.limit", 512).parquet(shuffled)
    extent = stats.extents(b.withColumn("g", F.lit(1)), "g").select(geo.box_area(predicates.box_of()).alias("whole"))
    out = None
    for order, path in (("hilbert", building_files(v)), ("random", shuffled)):
        share = parquet_index.scan_footers(v.spark, path).crossJoin(F.broadcast(extent)).agg(F.round(F.avg(geo.box_area(predicates.box_of()) / F.col("whole")) * 100, 3).alias("pct"))  # the extent is a row
        own = share.select(F.lit(order).alias("order"), "pct")
        out = own if out is None else out.unionByName(own)
    return out


@query("select fid, dataset, xmin, ymin from dem_tiles where xmin <= 240000 and xmax >= 118000 and ymin <= 155000 and ymax >= 98500")
def write_dem_index(v):
    path = files.scratch(v.spark, "dem")
    rows = v.dem_tiles.where("dataset is not null").repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin")
    rows.write.option("parquet.block.row.count.limit", 512).option("compression", "zstd").parquet(path)
    return predicates.within(v.spark.read.parquet(path), 118000.0, 98500.0, 240000.0, 155000.0).select("fid", "dataset", "xmin", "ymin")


@query("select fid from dem_tiles where xmin <= 90000 and xmax >= 50000 and ymin <= 200000 and ymax >= 150000")
def scan_dem_index(v):
    return predicates.within(v.dem_tiles, 50000.0, 150000.0, 90000.0, 200000.0).select("fid")


@query("select region, count(*) as n from lake group by region")
def write_feature_collection(v):
    path = files.scratch(v.spark, "features")
    lake.feature_lines(search.features(v.lake), path)
    return v.spark.read.text(path).groupBy(F.get_json_object("value", "$.properties.region").alias("region")).agg(F.count("*").alias("n"))


@query("select k as line, case when k % 7 = 3 then null else cast(k as int) end as code from footprints where k % 11 <> 0")
def scan_crs_table(v):
    k = F.col("k")
    path = files.scratch(v.spark, "crs")
    lines = F.when(k % 11 == 0, "").when(k % 7 == 3, F.concat(F.lit("no separator "), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit("|PROJCS["), k.cast("string"), F.lit("|x]")))
    v.footprints.select(lines.alias("value")).write.option("compression", "gzip").text(path)
    good, bad = documents.crs_table(v.spark.read.text(path))
    number = F.regexp_extract("wkt", r"\[(\d+)\|x\]$", 1).cast("long")
    return good.select(number.alias("line"), "code").unionByName(bad.select(F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("line")), allowMissingColumns=True)


@query("select id, coalesce(title, id) as title, active, status, bucket, west, 5 as n_points from registry where status <> 'excluded-not-cog' and west is not null")
def scan_collection_registry(v):
    path = files.scratch(v.spark, "registry")
    v.registry.coalesce(1).write.json(path)
    rows = documents.collections(v.spark.read.schema(v.registry.schema).json(path))
    return rows.select("id", "title", "active", "status", "bucket", F.col("ring")[0]["x"].alias("west"), F.size("ring").alias("n_points"))


@query("select asset_href, case when k % 20 = 1 then concat(id, '-new') else id end as id, datetime from stac_items")
def explode_stac_pages(v):
    """Items landed as result pages of about 500; a twentieth come again, changed, on later pages."""
    path = files.scratch(v.spark, "pages")
    item = F.struct("id", "bbox", F.struct("datetime").alias("properties"), F.struct(F.struct(F.col("asset_href").alias("href")).alias("image")).alias("assets"))
    items = v.stac_items.withColumn("bbox", F.col("proj_bbox"))
    again = items.where("k % 20 = 1").withColumn("id", F.concat("id", F.lit("-new")))
    rows = items.select(F.expr("k div 500").alias("page"), item.alias("f")).unionByName(again.select(F.expr("1000000000 + k div 10000").alias("page"), item.alias("f")))
    pages = rows.groupBy("page").agg(F.collect_list("f").alias("features"))  # about 500 a page
    files.write_objects(pages.select(F.format_string("page-%012d.json", "page").alias("name"), F.to_json(F.struct("features")).alias("content")), path)
    return documents.stac_pages(v.spark, path).select("asset_href", "id", "datetime")


_OBJECTS: dict[tuple, str] = {}


def objects(v) -> str:
    """A folder of the keys' objects, which are empty (listings read no content, and a byte takes a block of disk), and some that are no images of the layout; written once for a session and a data folder.  Their spatial folders have a digit: folders hold many images."""
    session = (v.spark.sparkContext.applicationId, v.sf_dir)
    if session not in _OBJECTS:
        path = files.scratch(v.spark, "objects")
        keys = v.footprints.select(F.regexp_replace("source_key", "/rgbir_cog/([0-9])[0-9]{4}/", "/rgbir_cog/$1/").alias("name"), "k")
        other = keys.where("k % 10 = 0").withColumn("name", F.regexp_replace("name", "rgbir_cog", "fgdc"))
        tasks = int(v.spark.conf.get("spark.sql.shuffle.partitions"))  # a folder is one task's
        files.write_objects(keys.union(other).withColumn("content", F.lit("")).repartition(tasks, F.regexp_extract("name", "^(.*)/", 1)), path)
        _OBJECTS[session] = path
    return _OBJECTS[session]


def keys_below(v, path: str, prefixes):
    """Keys of the images below prefixes (a column "below"), listed by tasks."""
    found = files.listed(prefixes.select(F.concat(F.lit(f"{path}/"), "below").alias("prefix")), ".tif")
    return found.select(F.regexp_extract("path", "^.*?" + path.split("/")[-1] + "/(.*)$", 1).alias("key"))


@query("select regexp_replace(source_key, '/rgbir_cog/([0-9])[0-9]{4}/', '/rgbir_cog/\\1/') as source_key, region, year from footprints")
def scan_object_listing(v):
    """Objects below the regions' prefixes, of which the layout keeps the keys that are its images and parse."""
    regions = v.footprints.select(F.concat("region", F.lit("/")).alias("below")).distinct()
    return LAYOUTS["naip"].parsed(keys_below(v, objects(v), regions)).select(F.col("key").alias("source_key"), "region", "year")


@query("select regexp_replace(source_key, '/rgbir_cog/([0-9])[0-9]{4}/', '/rgbir_cog/\\1/') as source_key, region, year from footprints where (region = 'nj' and year = 1995) or (region = 'ca' and year >= 1996)")
def narrowed_listing(v):
    """Only the prefixes of the asked regions and years are listed; one that does not exist has no keys."""
    layout = LAYOUTS["naip"]
    asked = [("nj", 1995), ("zz", 1995)] + [("ca", y) for y in range(1996, 2012)]
    prefixes = v.spark.createDataFrame([(layout.prefix(*x),) for x in asked], "below string")
    return layout.parsed(keys_below(v, objects(v), prefixes)).select(F.col("key").alias("source_key"), "region", "year")


@query()
def index_freshness(v):
    path = lake_path(v)
    built = files.listing(v.spark, path, "*.parquet").agg(F.max("modificationTime").alias("built"))
    source = v.orders.agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("source"))
    return built.crossJoin(source).select(lake.is_stale(F.col("built"), F.col("source")).alias("stale"))  # a row each


def tiff(n: int) -> bytes:
    """A small TIFF file's header, its values beyond what readers fetch first for every hundredth; a ninth have no CRS, every 50th directories that form a cycle."""
    doubles = struct.pack("<3d", 0.5, 0.5, 0.0) + struct.pack("<6d", 0, 0, 0, 500000.0 + 10 * n, 4500000.0, 0)
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 0 if n % 9 == 0 else 26910 + n % 10)
    names = b'<GDALMetadata><Item name="DESCRIPTION" sample="0" role="description">Red</Item></GDALMetadata>\0'
    count, gap = 9, headers.PREFIX if n % 100 == 1 else 0
    after = 8 + 2 + 12 * count + 4 + gap
    entries = [(256, 4, 1, struct.pack("<I", 256)), (257, 4, 1, struct.pack("<I", 128)), (258, 3, 1, struct.pack("<HH", 8, 0)), (277, 3, 1, struct.pack("<HH", 1, 0)), (322, 3, 1, struct.pack("<HH", 128, 0)),
               (33550, 12, 3, struct.pack("<I", after)), (33922, 12, 6, struct.pack("<I", after + 24)), (34735, 3, 8, struct.pack("<I", after + 72)), (42112, 2, len(names), struct.pack("<I", after + 88))]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", count) + b"".join(struct.pack("<HHI", t, k, m) + x for t, k, m, x in entries) + struct.pack("<I", 8 if n % 50 == 0 else 0) + bytes(gap) + doubles + keys + names


def image_files(v) -> str:
    """TIFF files, one a part."""
    path = files.scratch(v.spark, "images")

    def images(batches):
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"name": [f"{n % 100:02}/{n}.tif" for n in numbers], "content": pa.array([tiff(n) for n in numbers], pa.binary())})

    files.write_objects(v.part.select("p_partkey").repartition(16, "p_partkey").mapInArrow(images, "name string, content binary"), path)
    return path


@query("""select p_partkey as file_id, case when p_partkey % 50 = 0 then 'directories form a cycle' when p_partkey % 9 = 0 then 'no CRS' end as error, case when not (p_partkey % 9 = 0 or p_partkey % 50 = 0) then cast(26910 + p_partkey % 10 as int) end as proj_epsg,
  case when not (p_partkey % 9 = 0 or p_partkey % 50 = 0) then cast(500000 + p_partkey * 10 as double) end as x0, case when not (p_partkey % 9 = 0 or p_partkey % 50 = 0) then 'Red' end as band from part""")
def scan_cog_headers(v):
    """Headers of written TIFF files, one a part."""
    rows = headers.scan(v.spark, image_files(v))
    return rows.select(F.regexp_extract("path", r"/(\d+)\.tif$", 1).cast("long").alias("file_id"), "error", "proj_epsg", F.get("proj_bbox", F.lit(0)).alias("x0"), F.get("band_names", F.lit(0)).alias("band"))


# Snyder's inverse transverse Mercator of the lower left and upper right corners.
_CORNERS = """with p as (select p_partkey as file_id, (p_partkey % 10 + 10) * 6 - 183 as lon0, t.k, 500000 + p_partkey * 10 + t.k * 128.0 as x, cast(4499936.0 + t.k * 64.0 as double) as y from part, (values (0), (1)) t(k) where p_partkey % 9 <> 0 and p_partkey % 50 <> 0),
  e as (select *, 6378137.0::double as a, 2/298.257222101::double - 1/(298.257222101::double*298.257222101) as e2 from p), m as (select *, y/0.9996/(a*(1-e2/4-3*e2*e2/64-5*e2*e2*e2/256)) as mu, (1-sqrt(1-e2))/(1+sqrt(1-e2)) as e1, e2/(1-e2) as ep from e),
  f as (select *, mu + (3*e1/2-27*e1**3/32)*sin(2*mu) + (21*e1**2/16-55*e1**4/32)*sin(4*mu) + (151*e1**3/96)*sin(6*mu) + (1097*e1**4/512)*sin(8*mu) as phi from m),
  g as (select *, a/sqrt(1-e2*sin(phi)**2) as n, a*(1-e2)/(1-e2*sin(phi)**2)**1.5 as r, tan(phi)**2 as t, ep*cos(phi)**2 as c from f), h as (select *, (x-500000)/(n*0.9996) as d from g),
  q as (select file_id, k, lon0 + degrees((d-(1+2*t+c)*d**3/6+(5-2*c+28*t-3*c*c+8*ep+24*t*t)*d**5/120)/cos(phi)) as lon, degrees(phi-(n*tan(phi)/r)*(d*d/2-(5+3*t+10*c-4*c*c-9*ep)*d**4/24+(61+90*t+298*c+45*t*t-252*ep-3*c*c)*d**6/720)) as lat from h)"""


@query(f"{_CORNERS} select file_id, max(case when k = 0 then round(lon, 7) end) as west, max(case when k = 0 then round(lat, 7) end) as south, max(case when k = 1 then round(lon, 7) end) as east, max(case when k = 1 then round(lat, 7) end) as north, 5 as n_points, true as inside from q group by file_id")
def header_footprints(v):
    """Lower left and upper right corners of the images' footprints in longitude and latitude, from their headers."""
    rows = headers.scan(v.spark, image_files(v)).where("error is null")
    at = lambda i, n: F.round(F.get("ring", F.lit(i))[n], 7)
    box = tuple(F.col(n) for n in spatial.BOX)
    inside = F.forall("ring", lambda p: (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3])) & F.col("crs_error").isNull()
    return rows.select(F.regexp_extract("path", r"/(\d+)\.tif$", 1).cast("long").alias("file_id"), at(0, "x").alias("west"), at(0, "y").alias("south"), at(2, "x").alias("east"), at(2, "y").alias("north"), F.size("ring").alias("n_points"), inside.alias("inside"))


@query("select region as state, year, count(*) as n from footprints group by 1, 2")
def incremental_key_ingest(v):
    """Two landings of key files; the second repeats some keys of the first."""
    landing, index, checkpoint, staging = (files.scratch(v.spark, n) for n in ("landing", "index", "state", "staging"))
    lines = v.keys.select(F.col("key").alias("value"), F.regexp_extract("key", r"/m_(\d+)_", 1).try_cast("long").alias("k"))
    for part in (F.coalesce(F.col("k"), F.lit(0)) % 3 != 0, F.coalesce(F.col("k"), F.lit(0)) % 3 != 1):
        lines.where(part).select("value").write.mode("append").text(landing)
        ingest_new_keys(v.spark, landing, index, checkpoint, staging)
    return v.spark.read.schema(listed(v.keys).schema).parquet(index).groupBy("state", "year").agg(F.count("*").alias("n"))
