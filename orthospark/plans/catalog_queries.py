"""Queries over keys, footprints and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..functions import keys as K
from ..operators import catalog, predicates, search
from .registry import query

_PARTS = r"regexp_matches(split_part(key,'/',2),'^[0-9]+$') and length(split_part(key,'/',1)) = 2 and len(string_split(key,'/')) >= 5"


@query("select key as source_key, split_part(key,'/',1) as state from keys where key like '%/rgbir_cog/%' and key like '%.tif'")
def scan_key_manifest(v):
    return v.keys.where(F.col("key").like("%/rgbir_cog/%") & F.col("key").like("%.tif")).select(F.col("key").alias("source_key"), K.segment(F.col("key"), 1).alias("state"))


@query("select source_key, region, year, split_part(source_key,'/',3) as resolution, split_part(source_key,'/',4) as product_family, split_part(source_key,'/',5) as quad, split_part(source_key,'/',-1) as filename from footprints")
def scan_stac_index_keys(v):
    index = search.stac_index(v.lake, "naip").select("id", "region", "year")
    key = F.regexp_replace("id", "^[^/]+/", "")
    return index.select(key.alias("source_key"), "region", "year", K.segment(key, 3).alias("resolution"), K.segment(key, 4).alias("product_family"), K.segment(key, 5).alias("quad"), K.segment(key, -1).alias("filename"))


@query(f"select key as source_key, split_part(key,'/',1) as state, cast(split_part(key,'/',2) as int) as year, split_part(key,'/',3) as resolution, split_part(key,'/',4) as product_family, split_part(key,'/',5) as quad, split_part(key,'/',-1) as filename from keys where {_PARTS}")
def parse_manifest_key(v):
    return v.keys.select(F.col("key").alias("source_key"), K.manifest_fields(F.col("key")).alias("f")).where("f is not null").select("source_key", "f.*")


_TILE = K.TILE_NAME.replace("'", "''")


@query(f"""select k, regexp_extract(n,'{_TILE}',1) as apfo_name, upper(regexp_extract(n,'{_TILE}',2)) as quadrant, regexp_extract(n,'{_TILE}',3) as zone, regexp_extract(n,'{_TILE}',4) as resolution_token,
  cast(try_strptime(regexp_extract(n,'{_TILE}',5),'%Y%m%d') as date) as acquisition_date, cast(try_strptime(nullif(regexp_extract(n,'{_TILE}',6),''),'%Y%m%d') as date) as verification_date
  from (select k, case when k % 4 = 0 then upper(split_part(source_key,'/',-1)) when k % 4 = 1 then replace(split_part(source_key,'/',-1),'.tif','_20991340.tif') when k % 4 = 2 then concat('x', split_part(source_key,'/',-1)) else split_part(source_key,'/',-1) end as n from footprints) where regexp_matches(n,'{_TILE}')""")
def parse_tile_filename(v):
    name, k = K.segment(F.col("source_key"), -1), F.col("k")
    given = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.replace(name, F.lit(".tif"), F.lit("_20991340.tif"))).when(k % 4 == 2, F.concat(F.lit("x"), name)).otherwise(name)
    return v.footprints.select("k", K.tile_fields(given).alias("f")).where("f is not null").select("k", "f.*")


@query("""select k, 'ky' as region, 2000 + cast(k % 25 as int) as year, case when k % 3 <> 2 then cast(1 + k % 3 as varchar) end as season, concat('N', lpad(cast(k % 1000 as varchar),3,'0'), 'E284') as tile, res, concat('Phase', cast(1 + k % 3 as varchar)) as phase from footprints""")
def parse_key_ky(v):
    k, year = F.col("k"), (F.col("k") % 25 + 2000).cast("string")
    season = lambda when: F.when(k % 3 == when, F.concat(F.lit("_Season"), (k % 3 + 1).cast("string"))).otherwise("")
    tile = F.concat(F.lit("N"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("E284"))
    key = F.concat(F.lit("imagery/orthos/Phase"), (k % 3 + 1).cast("string"), F.lit("/KY_KYAPED_"), year, season(1), F.lit("_6IN/"), tile, F.lit("_"), year, season(0), F.lit("_"), "res", F.lit("_cog.tif"))
    layout = K.LAYOUTS["kyfromabove"]
    rows = v.footprints.select("k", key.alias("key"))
    p = {n: f(F.col("key")) for n, f in layout.properties.items()}
    return rows.where(layout.keep(F.col("key"))).select("k", layout.region(F.col("key")).alias("region"), layout.year(F.col("key")).alias("year"), p["season"].alias("season"), p["kyaped:tile"].alias("tile"), p["kyaped:resolution"].alias("res"), p["phase"].alias("phase"))


@query("""select k, case k % 3 when 0 then 'nj-imagery' when 1 then 'in-imagery' else 'adhoc' end as collection, case k % 3 when 0 then 'nj' when 1 then 'in' else 'zz' end as region, cast(case when k % 3 = 2 then 2024 else year end as int) as year,
  concat('T', cast(k as varchar)) as tile from footprints""")
def parse_key_generic_layouts(v):
    k, year, tile = F.col("k"), F.col("year").cast("string"), F.concat(F.lit("T"), F.col("k").cast("string"))
    key = F.when(k % 3 == 0, F.concat(year, F.lit("/cog/"), tile, F.lit(".tif"))).when(k % 3 == 1, F.concat(F.lit("imageryoptimized/statewide/"), year, F.lit("/east/6in/"), tile, F.lit(".tif"))).otherwise(F.concat(F.lit("any/where/"), tile, F.lit(".tiff")))
    rows = v.footprints.select("k", key.alias("key"))
    layouts = [(K.LAYOUTS["nj-imagery"], "njgin:tile"), (K.LAYOUTS["in-imagery"], "in:tile"), (K.adhoc_layout("adhoc", "s3://b/x", "any", "ZZ", 2024, "public"), "tile")]
    out = None
    for n, (layout, tile) in enumerate(layouts):  # a key belongs to its own collection's listing
        own = layout.parsed(rows.where(F.col("k") % 3 == n).select("key")).select("key", "collection", "region", "year", F.col("properties")[tile].alias("tile"))
        out = own if out is None else out.unionByName(own)
    return rows.join(out, "key").drop("key")


@query("select lower(regexp_replace(concat(upper(region), case k % 3 when 0 then '_cog' when 1 then '_cogs' else '' end), '(?i)_cogs?$', '')) as product, count(*) as n from footprints group by 1 union all select null, 1")
def derive_product(v):
    k = F.col("k")
    given = F.concat(F.upper("region"), F.when(k % 3 == 0, "_cog").when(k % 3 == 1, "_cogs").otherwise(""))
    rows = v.footprints.select(given.alias("family")).unionByName(v.footprints.select(F.lit("_cog").alias("family")).limit(1))
    return rows.groupBy(K.product(F.col("family")).alias("product")).agg(F.count("*").alias("n"))


@query("""select k, region, year, case when k % 2 = 0 then '{"product":"rgbir","resolution":"' || res || '"}' else '{"resolution":"' || res || '"}' end as properties, case when k % 3 = 0 then [xmin, ymin] when k % 3 = 1 then [round(xmin,2), round(ymin,2)] end as proj_bbox from footprints""")
def unify_payload_rows(v):
    k = F.col("k")
    f = v.footprints
    naip = f.where(k % 2 == 0).select("k", F.col("region").alias("state"), F.col("year").alias("naip_year"), F.lit("RGBIR_COG").alias("product_family"), "res", "xmin", "ymin")
    generic = f.where(k % 2 == 1).select("k", "region", "year", "res", "xmin", "ymin")
    both = naip.unionByName(generic, allowMissingColumns=True)
    raw = F.when(k % 3 == 1, F.concat(F.lit('{"proj:bbox":['), F.round("xmin", 2).cast("string"), F.lit(","), F.round("ymin", 2).cast("string"), F.lit("]}"))).otherwise("not json")
    own = F.when(k % 3 == 0, F.array("xmin", "ymin"))
    return both.select("k", F.coalesce("region", "state").alias("region"), F.coalesce("year", "naip_year").alias("year"), F.to_json(F.struct(K.product(F.col("product_family")).alias("product"), F.col("res").alias("resolution"))).alias("properties"), F.coalesce(own, F.from_json(raw, "`proj:bbox` array<double>")["proj:bbox"]).alias("proj_bbox"))


@query("""select concat('naip-v2/', source_key) as id, [xmin, ymin, xmax, ymax] as bbox, strftime(acquisition_date,'%Y-%m-%dT00:00:00Z') as datetime, asset_href, gsd, 'naip-v2' as collection, region, year,
  json_extract_string(properties,'$."naip:quad"') as quad, case when proj_epsg is not null then cast(proj_epsg as varchar) end as epsg, cast(gsd as varchar) is not null as has_gsd from lake""")
def project_stac_items(v):
    out = search.stac_index(v.lake, "naip-v2")
    p = F.col("properties")
    return out.select("id", "bbox", "datetime", "asset_href", "gsd", "collection", "region", "year", p["naip:quad"].alias("quad"), p["proj:epsg"].alias("epsg"), F.coalesce(F.map_contains_key(p, "gsd"), F.lit(False)).alias("has_gsd"))


_FEATURE_CHECK = """select concat('naip-analytic/', source_key) as id, case when acquisition_date is not null then strftime(acquisition_date,'%Y-%m-%dT00:00:00Z') end as datetime,
  case when acquisition_date is null then concat(cast(year as varchar),'-01-01T00:00:00Z') end as start_datetime, case when proj_epsg is not null then concat('EPSG:', cast(proj_epsg as varchar)) end as code,
  concat('DOUQ-' , '')[1:0] || concat('DOQQ-', lpad(cast(k % 100000 as varchar),5,'0')) as grid, cast(2 as int) as n_extensions, region as state from lake"""


@query(_FEATURE_CHECK.replace("concat('DOUQ-' , '')[1:0] || ", ""))
def make_stac_feature(v):
    get = lambda path: F.get_json_object("feature", path)
    rows = search.features(v.lake)
    return rows.select("id", get("$.properties.datetime").alias("datetime"), get("$.properties.start_datetime").alias("start_datetime"), get("$.properties['proj:code']").alias("code"), get("$.properties['grid:code']").alias("grid"), F.size(F.from_json(get("$.stac_extensions"), "array<string>")).alias("n_extensions"), get("$.properties['naip:state']").alias("state"))


@query("""select s.k, cast(coalesce(try_strptime(case when l.k % 6 = 0 then null else strftime(f.acq,'%Y%m%d') end,'%Y%m%d'), cast(substr(s.datetime,1,10) as date)) as date) as acquisition_date, cast(4 as int) as band_count,
  array_to_string(coalesce(s.common_names, s.band_names), ',') as bands, s.epsg, case when s.epsg is null then 'no proj:epsg' end as error from lake l join footprints f using (k) join stac_items s on s.asset_href = l.asset_href""")
def enrich_from_stac_item(v):
    name = F.when(F.col("k") % 6 == 0, "other.tif").otherwise(K.segment(F.col("source_key"), -1))
    rows = v.footprints.select("k", F.concat(F.lit("s3://naip-analytic/"), "source_key").alias("asset_href"), K.tile_fields(name)["acquisition_date"].alias("named"))
    items = v.stac_items.drop("k", "id")
    bands = F.coalesce("common_names", "band_names")
    return rows.join(items, "asset_href").select("k", F.coalesce("named", F.to_date(F.substr("datetime", F.lit(1), F.lit(10)))).alias("acquisition_date"), F.size(bands).alias("band_count"), F.array_join(bands, ",").alias("bands"), "epsg", F.when(F.col("epsg").isNull() | (F.size("proj_bbox") != 4), "no proj:epsg").alias("error"))


@query("select k, region as state, year as naip_year, res as resolution_dir, 'rgbir_cog' as product_family, split_part(source_key,'/',5) as spatial_prefix from footprints")
def project_generic_to_naip(v):
    rows = K.LAYOUTS["naip"].parsed(v.footprints.withColumnRenamed("source_key", "key"))
    p = F.col("properties")
    renamed = rows.withColumnsRenamed({"region": "state", "year": "naip_year"}).select("key", "state", "naip_year", p["resolution_dir"].alias("resolution_dir"), p["product_family"].alias("product_family"), p["spatial_prefix"].alias("spatial_prefix"))
    return renamed.join(v.footprints.select("k", F.col("source_key").alias("key")), "key").drop("key")


@query("select id, xmin as bbox_xmin, ymin as bbox_ymin, xmin + 0.0005 as bbox_xmax, ymin + 0.0005 as bbox_ymax, 'buildings' as theme from buildings")
def flatten_bbox_struct(v):
    nested = v.buildings.select("id", F.struct("xmin", "ymin", (F.col("xmin") + 0.0005).alias("xmax"), (F.col("ymin") + 0.0005).alias("ymax")).alias("bbox"))
    return nested.select("id", *[F.col(f"bbox.{n}").alias(f"bbox_{n}") for n in ("xmin", "ymin", "xmax", "ymax")], F.lit("buildings").alias("theme"))


@query("""select k, case when k % 3 = 0 then cast(26900 + k % 20 as int) when k % 3 = 1 then cast(3857 as int) end as epsg from footprints""")
def parse_epsg_code(v):
    k = F.col("k")
    code = F.when(k % 3 == 0, F.concat(F.lit(" epsg:"), (k % 20 + 26900).cast("string"), F.lit(" "))).otherwise("OGC:CRS84")
    return v.footprints.select("k", K.epsg_code(code, F.when(k % 3 == 1, "3857").when(k % 3 == 2, "none")).alias("epsg"))


@query("""select k, case when k % 4 = 0 then cast(year as int) when k % 4 = 1 then cast(year(acq) as int) end as source_year, case when k % 5 = 0 then 'default' else region end as source_region from footprints""")
def parse_source_year_region(v):
    k = F.col("k")
    a = F.when(k % 4 == 0, F.col("year").cast("string"))
    b = F.when(k % 4 == 1, F.concat(F.date_format("acq", "yyyy-MM-dd"), F.lit("T00:00Z"))).when(k % 4 == 2, "flown in 18990101")
    return v.footprints.select("k", K.source_year(a, b).alias("source_year"), K.source_region(F.when(k % 5 != 0, F.upper("region")), F.lit(None).cast("string")).alias("source_region"))


@query("""select file_id, b.band as band, cast(b.band * 10.0 + file_id % 7 as double) as mean, cast(b.band + 0.5 as double) as std, cast(case when file_id % 3 = 0 then 2.0 else 0.0 end as double) as off, cast(1.0 as double) as scale from headers, (values (1),(2)) b(band)""")
def parse_gdal_metadata(v):
    """Band statistics, offsets (default 0) and scales (default 1) from a header's XML."""
    f = F.col("file_id")
    item = lambda band, name, value, role="": F.concat(F.lit(f'<Item name="{name}" sample="{band}"{role}>'), value.cast("string"), F.lit("</Item>"))
    parts = [x for b in (0, 1) for x in (item(b, "STATISTICS_MEAN", (b + 1) * 10.0 + f % 7), item(b, "STATISTICS_STDDEV", F.lit(b + 1.5)), F.when(f % 3 == 0, item(b, "OFFSET", F.lit(2.0), ' role="offset"')).otherwise(""))]
    xml = F.concat(F.lit('<GDALMetadata><Item name="AREA">x</Item>'), *parts, F.lit("</GDALMetadata>"))
    items = F.explode(F.from_xml(xml, "Item array<struct<_name:string,_sample:int,_VALUE:string>>")["Item"]).alias("i")
    value = lambda name: F.max(F.when(F.col("i._name") == name, F.col("i._VALUE").try_cast("double")))
    rows = v.headers.select("file_id", items).where("i._sample is not null").groupBy("file_id", (F.col("i._sample") + 1).alias("band"))
    return rows.agg(value("STATISTICS_MEAN").alias("mean"), value("STATISTICS_STDDEV").alias("std"), F.coalesce(value("OFFSET"), F.lit(0.0)).alias("off"), F.coalesce(value("SCALE"), F.lit(1.0)).alias("scale"))


@query("select k, concat(region,'/',cast(year as varchar),'/',res,'/rgb/',split_part(source_key,'/',5),'/',split_part(source_key,'/',6)) as path from footprints")
def resolve_key_template(v):
    return v.footprints.select("k", K.resolved_template(F.lit("{state}/{year}/{res}/rgb/{quad}/{file}"), F.col("source_key")).alias("path"))


@query("select k, case when k % 5 = 0 then null when k % 5 = 1 then concat(cast(k % 9 + 1 as varchar), ' m') when k % 5 = 2 then '1.5 m' else concat(cast(cast(floor((k % 97 + 1) / 100.0 * 100 + 0.5) as int) as varchar), ' cm') end as label from footprints")
def gsd_label(v):
    k = F.col("k")
    meters = F.when(k % 5 == 0, -1.0).when(k % 5 == 1, (k % 9 + 1).cast("double")).when(k % 5 == 2, 1.5).otherwise((k % 97 + 1) / 100.0)
    return v.footprints.select("k", K.resolution_label(meters).alias("label"))


@query("select k, case when k % 4 = 0 then concat('https://x/', source_key) else concat('https://naip-analytic.s3.us-west-2.amazonaws.com/', source_key) end as url from footprints")
def public_https_url(v):
    href = F.when(F.col("k") % 4 == 0, F.concat(F.lit("https://x/"), "source_key")).otherwise(F.concat(F.lit("s3://naip-analytic/"), "source_key"))
    return v.footprints.select("k", K.https_url(href, "us-west-2").alias("url"))


@query("select k, concat('0103', lpad(hex(k % 256),2,'0')) as wkb from footprints")
def gpkg_blob_to_wkb(v):
    k = F.col("k")
    size = F.element_at(F.array(*[F.lit(x) for x in (0, 32, 48, 48, 64)]), (k % 5 + 1).cast("int"))
    head = F.concat(F.lit("475000"), F.lpad(F.hex((k % 5) * 2 + 1), 2, "0"), F.lit("E6100000"), F.repeat(F.lit("AB"), size))
    blob = F.unhex(F.concat(head, F.lit("0103"), F.lpad(F.hex(k % 256), 2, "0")))
    return v.footprints.select("k", F.hex(K.gpkg_wkb(blob)).alias("wkb"))


# Filters

_BOX = (-100.0, 30.0, -90.0, 40.0)


@query("select k, region, year, xmin, ymin from footprints where xmin <= -90 and xmax >= -100 and ymin <= 40 and ymax >= 30")
def filter_bbox(v):
    return predicates.within(v.footprints, *_BOX).select("k", "region", "year", "xmin", "ymin")


# A tile's polygon is its box with the upper right corner cut off; a box meets it unless it lies beyond the cut.
_RING_SQL = "xmin <= {e} and xmax >= {w} and ymin <= {n} and ymax >= {s} and (xmax - {w}) + (ymax - {s}) >= cut"


def cut_ring():
    x1, y1, x2, y2, c = (F.col(n) for n in ("xmin", "ymin", "xmax", "ymax", "cut"))
    return F.array(geo.point(x1, y1), geo.point(x2, y1), geo.point(x2, y2 - c), geo.point(x2 - c, y2), geo.point(x1, y2), geo.point(x1, y1))


@query("select fid from dem_tiles where " + _RING_SQL.format(w=118000, s=98500, e=240000, n=155000))
def filter_polygon_intersects_box(v):
    return predicates.meeting(v.dem_tiles, cut_ring(), 118000.0, 98500.0, 240000.0, 155000.0).select("fid")


@query("select fid from dem_tiles where xmin + 9500.0 <= xmax and (xmax - (xmin + 9500.0)) + (ymax - (ymin + 7500.0)) >= cut")
def point_in_polygon(v):
    return v.dem_tiles.where(geo.covers(cut_ring(), F.col("xmin") + 9500.0, F.col("ymin") + 7500.0)).select("fid")


@query("select k from footprints f where exists (select 1 from boxes where idx <= 32 and idx % 5 <> 0 and f.xmin <= east and f.xmax >= west and f.ymin <= north and f.ymax >= south)")
def filter_multi_bbox(v):
    from ..operators.spatial import semi_join_boxes

    given = v.boxes.where("idx <= 32").withColumn("east", F.when(F.col("idx") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("east")))
    return semi_join_boxes(v.footprints, predicates.valid_boxes(given), "k").select("k")


@query("select k, region, year from footprints f where year = (select max(year) from footprints g where g.region = f.region)")
def filter_latest_year_per_region(v):
    return predicates.of_latest_year(v.footprints).select("k", "region", "year")


@query("""select line_no, key like '%.tif' and key like '%/rgbir_cog/%' as naip, key like '%\\_cog.tif' escape '\\' as ky, key like '%/cog/%.tif' as nj, false as ind, key like '%.tif' and key not like '%Metadata%' as adhoc from keys""")
def filter_cog_keys(v):
    k = F.col("key")
    adhoc = K.adhoc_layout("a", "b", "", "zz", 2020, "public")
    return v.keys.select("line_no", *[x.keep(k).alias(n) for n, x in (("naip", K.LAYOUTS["naip"]), ("ky", K.LAYOUTS["kyfromabove"]), ("nj", K.LAYOUTS["nj-imagery"]), ("ind", K.LAYOUTS["in-imagery"]), ("adhoc", adhoc))])


@query("select k, region, year from footprints where region in ('nj','ca','tx') and year in (1994, 1997)")
def filter_region_year_sets(v):
    wanted = v.registry.sparkSession.createDataFrame([(r, y) for r in ("nj", "ca", "tx") for y in (1994, 1997)], "region string, year int")
    return v.footprints.join(F.broadcast(wanted), ["region", "year"], "left_semi").select("k", "region", "year")


@query("select rid, coalesce(nullif(regexp_replace(lower(region_text),'[^a-z0-9_-]','','g'),''),'naip') as collection, coalesce(nullif(regexp_replace(lower(region_text),'[^a-z0-9]','','g'),''),'') as region from requests")
def sanitize_identifier(v):
    return v.requests.select("rid", K.sanitized(F.col("region_text"), "naip").alias("collection"), K.sanitized(F.col("region_text"), "", "[^a-z0-9]").alias("region"))


@query("""select rid, case when try_cast(xmin_text as double) is null then 'bbox must be numbers' when isnan(try_cast(xmin_text as double)) then 'bbox must be finite' when limit_text = 'abc' then 'limit must be a positive integer'
  when year_text is not null and try_cast(year_text as int) is null then 'year must be an integer' end as reason, least(coalesce(try_cast(limit_text as int),1000),18000) as limit_value, try_cast(year_text as int) as year_value from requests""")
def validate_search_requests(v):
    return predicates.validated(v.requests).select("rid", "reason", "limit_value", "year_value")


_HREF = "case k % 5 when 0 then concat('s3://bucket-', cast(k % 9 as varchar), '/', source_key) when 1 then concat('https://x/', source_key) when 2 then concat('s3://u@bucket-1/', source_key) when 3 then concat('s3://bucket-1/', source_key, '?q=1') else concat('s3://nowhere/', source_key) end"


def hrefs(v):
    k, s = F.col("k"), F.col("source_key")
    return v.footprints.select("k", F.when(k % 5 == 0, F.concat(F.lit("s3://bucket-"), (k % 9).cast("string"), F.lit("/"), s)).when(k % 5 == 1, F.concat(F.lit("https://x/"), s)).when(k % 5 == 2, F.concat(F.lit("s3://u@bucket-1/"), s)).when(k % 5 == 3, F.concat(F.lit("s3://bucket-1/"), s, F.lit("?q=1"))).otherwise(F.concat(F.lit("s3://nowhere/"), s)).alias("href"))


@query("select k, case when k % 5 in (1,2,3) then 'not an s3 object' when k % 5 = 4 or concat('bucket-', cast(k % 9 as varchar)) not in (select bucket from registry where active) then 'unknown bucket' end as reason from footprints")
def validate_source_href(v):
    return predicates.source_hrefs(hrefs(v), v.registry).select("k", "reason")


@query("select region, count(*) as n from (select case when k % 7 = 0 then null else region end as region, case when k % 11 = 0 then null else year end as year from footprints) where region is not null and year is not null group by region")
def filter_null_region_year(v):
    k = F.col("k")
    rows = v.footprints.select(F.when(k % 7 != 0, F.col("region")).alias("region"), F.when(k % 11 != 0, F.col("year")).alias("year"))
    return rows.where("region is not null and year is not null").groupBy("region").agg(F.count("*").alias("n"))


# Joins and set operations of the catalog


@query("select s.k, s.id, s.epsg from lake l join stac_items s using (asset_href)")
def join_manifest_stac(v):
    return catalog.enriched(v.lake.select("asset_href"), v.stac_items)[0].select("k", "id", "epsg")


@query("select l.k, l.asset_href from lake l where l.asset_href not in (select asset_href from stac_items)")
def anti_missing_stac(v):
    return catalog.enriched(v.lake, v.stac_items)[1].select("k", "asset_href")


@query("""select f.source_key, region as state, year, res as resolution, regexp_replace(split_part(f.source_key,'/',-1),'\\.tif$','') as base, case when k % 9 = 1 then concat(stem,'.xml') when k % 3 <> 0 then concat(stem, case when k % 2 = 0 then '.xml' else '.txt' end) end as metadata_key
  from (select *, regexp_replace(replace(source_key,'/rgbir_cog/','/fgdc/'),'\\.tif$','') as stem from footprints) f""")
def join_sidecar_metadata(v):
    return catalog.sidecars(v.keys)


@query("select k, l.region, e.x1 as region_xmin, e.y2 as region_ymax from footprints l join (select region, min(xmin) as x1, max(ymax) as y2 from footprints group by region) e using (region)")
def join_region_bounds(v):
    bounds = v.footprints.groupBy("region").agg(F.min("xmin").alias("region_xmin"), F.max("ymax").alias("region_ymax"))
    return v.footprints.join(F.broadcast(bounds), "region").select("k", "region", "region_xmin", "region_ymax")  # a row a region


@query("select x.k, r.id as collection from (select k, concat('bucket-', cast(k % 9 as varchar)) as bucket, k % 5 as m from footprints) x left join (select bucket, min(id) as id from registry group by bucket) r on x.m in (0) and r.bucket = x.bucket or x.m in (3) and r.bucket = 'bucket-1'")
def join_href_collection(v):
    """The collection of an href by its bucket; of several collections with one bucket the first id."""
    bucket = F.coalesce(K.null_if_empty(F.regexp_extract("href", r"^s3://([^/@]+)/", 1)), K.null_if_empty(F.regexp_extract("href", r"^https://([^./]+)\.s3[.-][^/]*/", 1)))
    owner = v.registry.groupBy("bucket").agg(F.min("id").alias("collection"))
    return hrefs(v).withColumn("bucket", bucket).join(owner, "bucket", "left").select("k", "collection")


@query("select k, proj_epsg, case when proj_epsg is not null and proj_epsg % 2 = 0 then concat('NAD83 / UTM zone ', cast(proj_epsg - 26900 as varchar), 'N') end as crs_name from lake")
def join_crs_reference(v):
    codes = v.lake.sparkSession.createDataFrame([(26900 + z, f"NAD83 / UTM zone {z}N") for z in range(2, 24, 2)], "proj_epsg int, crs_name string")
    return v.lake.join(F.broadcast(codes), "proj_epsg", "left").select("k", "proj_epsg", "crs_name")  # a row a code of the EPSG registry


@query("select l.k, s.id, 'stac' as origin from lake l join stac_items s using (asset_href) union all select l.k, null, 'header' from lake l where l.asset_href not in (select asset_href from stac_items)")
def union_enriched_and_fallback(v):
    have, lack = catalog.enriched(v.lake.select("asset_href"), v.stac_items)
    lack = catalog.enriched(v.lake.select("asset_href", "k"), v.stac_items)[1]
    return have.select("k", "id", F.lit("stac").alias("origin")).unionByName(lack.select("k", F.lit("header").alias("origin")), allowMissingColumns=True)


@query("select distinct year from footprints where region in ('nj','ca')")
def union_year_lists(v):
    lists = v.footprints.where(F.col("region").isin("nj", "ca")).groupBy("region").agg(F.collect_set("year").alias("years"))
    return lists.select(F.explode("years").alias("year")).distinct().orderBy(F.desc("year"))


@query("select distinct region from footprints where region in ('nj','hi') ")
def region_set_intersect(v):
    return v.footprints.select("region").where(F.col("region") != "ri").intersect(v.footprints.sparkSession.createDataFrame([("nj",), ("hi",), ("zz",)], "region string"))


@query("select source_key from lake where k % 10 = 3")
def listed_minus_ingested(v):
    got = v.stac_items.select(F.regexp_replace("asset_href", "^s3://naip-analytic/", "").alias("source_key"))
    return v.lake.select("source_key").exceptAll(got)


@query("select region, count(*) as n from footprints group by region")
def concat_tables(v):
    parts = [v.footprints.where(F.col("k") % 3 == i) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("region").agg(F.count("*").alias("n"))


@query("select region, year, count(*) as listed, sum(case when k % 10 <> 3 then 1 else 0 end)::bigint as ingested, sum(case when k % 10 = 3 then 1 else 0 end)::bigint as dropped, round(sum(case when k % 10 <> 3 then 1 else 0 end)*100.0/count(*),6)::double as pct, bool_or(k % 10 = 3) as incomplete from footprints group by 1, 2")
def reconcile_completeness(v):
    return catalog.completeness(v.footprints, v.footprints.where("k % 10 <> 3"))


# Windows and quality


@query("select k, region, year, res from footprints qualify row_number() over (partition by region, year, res order by source_key) <= 3")
def cap_per_partition(v):
    return catalog.capped(v.footprints, ("region", "year", "res"), "source_key", 3).select("k", "region", "year", "res")


@query("select k, region, year from footprints qualify year = max(year) over (partition by region)")
def latest_rows_per_region(v):
    return v.footprints.withColumn("newest", F.max("year").over(W.partitionBy("region"))).where("year = newest").select("k", "region", "year")


@query("select region, year, n from (select region, year, count(*) as n from footprints group by 1,2) qualify row_number() over (partition by region order by n desc, year) <= 2")
def top_counts(v):
    counts = v.footprints.groupBy("region", "year").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("region").orderBy(F.desc("n"), "year"))).where("rank <= 2").drop("rank")


@query("select file_id, case when tile_width is null then 'no internal tiling' when greatest(width,height) > 512 and coalesce(ifd_count,1) < 2 then 'no overviews' end as reason from headers")
def validate_cog_structure(v):
    return catalog.cog_structure(v.headers).select("file_id", "reason")


@query("select case when epsg is null then 'failed' else 'matched' end as side, count(*) as n from stac_items group by 1")
def matched_failed_split(v):
    good, bad = catalog.split_failures(v.stac_items.withColumn("error", F.when(F.col("epsg").isNull(), "no proj:epsg")))
    return good.agg(F.count("*").alias("n")).select(F.lit("matched").alias("side"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("failed").alias("side"), "n"))


@query("select file_id, case when scale_x is null then 'no pixel scale' when tie_x is null then 'no tie point' when epsg is null then 'no CRS' when epsg in (32767, 0) and citation is null then 'user-defined CRS' end as reason from headers")
def georef_tag_check(v):
    return catalog.georeference(v.headers).select("file_id", "reason")


@query("select (select count(*) from footprints) as old_count, (select count(*) from lake) as new_count, (select count(*) from footprints) = (select count(*) from lake) as same")
def row_count_match(v):
    old, new = v.footprints.agg(F.count("*").alias("old_count")), v.lake.agg(F.count("*").alias("new_count"))
    return old.crossJoin(new).withColumn("same", F.col("old_count") == F.col("new_count"))  # a row each


@query("select file_id, case when len(list_distinct(formats)) > 1 then 'mixed sample formats' when len(list_distinct(bits)) > 1 then 'mixed bit depths' end as reason from headers")
def uniform_sample_format(v):
    return catalog.uniform_samples(v.headers).select("file_id", "reason")


@query("select a.raster_id, count(*) as n_equal from levels a join levels b on a.raster_id + 1 = b.raster_id and a.z = b.z and a.width is not distinct from b.width and a.mpp is not distinct from b.mpp group by 1")
def level_grid_equality(v):
    a, b = v.levels, v.levels.select((F.col("raster_id") - 1).alias("other"), F.col("z").alias("z2"), F.col("width").alias("w2"), F.col("mpp").alias("m2"))
    same = (F.col("raster_id") == F.col("other")) & (F.col("z") == F.col("z2")) & F.col("width").eqNullSafe(F.col("w2")) & F.col("mpp").eqNullSafe(F.col("m2"))
    return a.join(b, same).groupBy("raster_id").agg(F.count("*").alias("n_equal"))


@query("select * from (values ('in-imagery','gisimageryingov','public'),('kyfromabove','kyfromabove','public'),('naip','naip-analytic','requester-pays'),('nj-imagery','njogis-imagery','public')) t(id, bucket, access), (select count(*) as n_images from keys where key like '%/rgbir_cog/%' and key like '%.tif' and key not like '%notayear%') c where t.id = 'naip' union all select id, bucket, access, 0 from (values ('in-imagery','gisimageryingov','public'),('kyfromabove','kyfromabove','public'),('nj-imagery','njogis-imagery','public')) t(id, bucket, access)")
def layout_registry(v):
    """The registered layouts, and how many of the listed keys each takes."""
    layouts = list(K.LAYOUTS.values())
    counts = v.keys.agg(*[F.count_if(x.keep(F.col("key")) & x.region(F.col("key")).isNotNull()).alias(x.id) for x in layouts])
    rows = F.array(*[F.struct(F.lit(x.id).alias("id"), F.lit(x.bucket).alias("bucket"), F.lit(x.access).alias("access"), F.col(f"`{x.id}`").alias("n_images")) for x in layouts])
    return counts.select(F.inline(rows))


@query("select * from (select k, year, acquisition_date, gsd, source_key from lake where xmin <= -90 and xmax >= -100 and ymin <= 40 and ymax >= 30) order by year desc, acquisition_date desc nulls last, gsd nulls last, source_key limit 500")
def search_order_limit(v):
    return search.ordered(predicates.within(v.lake, *_BOX), 500).select("k", "year", "acquisition_date", "gsd", "source_key")


@query("""select concat('naip-analytic/', source_key) as id, region, year, case when acquisition_date is not null then strftime(acquisition_date,'%Y-%m-%dT00:00:00Z') end as datetime, asset_href as href
  from lake l where xmin <= -80 and xmax >= -110 and ymin <= 45 and ymax >= 30 and year = (select max(year) from lake m where m.region = l.region) order by year desc, acquisition_date desc nulls last, gsd nulls last, source_key limit 1000""")
def search_pipeline(v):
    """A whole search: box, exact footprint, newest year per region, order and limit, STAC features."""
    ring = geo.box_ring(predicates.box_of())
    found = search.features(search.search(v.lake, (-110.0, 30.0, -80.0, 45.0), ring=ring))
    get = lambda path: F.get_json_object("feature", path)
    return found.select("id", get("$.properties.region").alias("region"), get("$.properties.year").cast("int").alias("year"), get("$.properties.datetime").alias("datetime"), get("$.assets.image.href").alias("href"))
