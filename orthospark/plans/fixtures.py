"""Derived views: domain-shaped columns computed from the driver's tables, once for Spark and once as SQL.

The tables hold no imagery, so keys, footprints, headers and pixels are arithmetic on integer keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key % len(values)).cast("int") + 1)


REGIONS = ["nj", "ri", "de", "ca", "ky", "wa", "tx", "hi"]


def footprints(v):
    k = F.col("o_orderkey")
    gx, gy = (k * 7919) % 5700, (k * 104729) % 2400
    rows = v.orders.select(
        k.alias("k"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("acq"), pick(REGIONS, k).alias("region"), pick(["30cm", "60cm", "100cm"], k).alias("res"),
        pick(["030", "060", "100"], k).alias("tok"), pick(["ne", "nw", "se", "sw"], k).alias("q"), gx.alias("gx"), gy.alias("gy"),
    )
    place = lambda start, g: F.lit(start) + F.col(g) / 100.0
    key = F.concat("region", F.lit("/"), F.col("year").cast("string"), F.lit("/"), "res", F.lit("/rgbir_cog/"), F.lpad((F.col("k") % 100000).cast("string"), 5, "0"), F.lit("/m_"), F.lpad(F.col("k").cast("string"), 7, "0"), F.lit("_"), "q", F.lit("_18_"), "tok", F.lit("_"), F.date_format("acq", "yyyyMMdd"), F.lit(".tif"))
    return rows.select("k", "region", "year", "res", "acq", place(-124.0, "gx").alias("xmin"), place(25.0, "gy").alias("ymin"), place(-123.9375, "gx").alias("xmax"), place(25.0625, "gy").alias("ymax"), key.alias("source_key"))


def lake(v):
    """Footprints as lake rows; some dates, resolutions and CRS codes are missing."""
    k = F.col("k")
    gsd = F.when(F.col("res") == "30cm", 0.3).when(F.col("res") == "60cm", 0.6).otherwise(1.0)
    return footprints(v).select(
        k, F.lit("naip-analytic").alias("source_bucket"), "source_key", F.concat(F.lit("s3://naip-analytic/"), "source_key").alias("asset_href"), F.lit("naip").alias("collection"), "region", "year",
        F.concat(F.lit('{"naip:resolution":"'), "res", F.lit('","naip:product":"rgbir","naip:quad":"'), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit('"}')).alias("properties"),
        "xmin", "ymin", "xmax", "ymax", F.when(k % 19 != 0, F.col("acq")).alias("acquisition_date"), F.when(k % 17 != 0, gsd).alias("gsd"), F.when(k % 23 != 0, 26910 + (k % 10)).cast("int").alias("proj_epsg"),
        F.array(F.lit(10000) + (k % 7).cast("int"), F.lit(12000) + (k % 5).cast("int")).alias("proj_shape"),
    )


def keys(v):
    """Image keys, their sidecars (two thirds of them), and noise; line numbers give their order."""
    f = footprints(v)
    image = f.select((F.col("k") * 4).alias("line_no"), F.col("source_key").alias("key"))
    stem = F.regexp_replace(F.regexp_replace("source_key", "/rgbir_cog/", "/fgdc/"), r"\.tif$", "")
    sidecar = f.where("k % 3 <> 0").select((F.col("k") * 4 + 1).alias("line_no"), F.concat(stem, F.when(F.col("k") % 2 == 0, ".xml").otherwise(".txt")).alias("key"))
    again = f.where("k % 9 = 1").select((F.col("k") * 4 + 2).alias("line_no"), F.concat(stem, F.lit(".xml")).alias("key"))
    noise = f.where("k % 5 = 0").select((F.col("k") * 4 + 3).alias("line_no"), F.when(F.col("k") % 3 == 0, "manifest.txt").when(F.col("k") % 3 == 1, "nj/notayear/30cm/rgbir_cog/39075/x.tif").otherwise("toolong/2023/a/b/c.tif").alias("key"))
    return image.unionByName(sidecar).unionByName(again).unionByName(noise)


def stac_items(v):
    k = F.col("k")
    return lake(v).where("k % 10 <> 3").select(
        k, "asset_href", F.concat(F.lit("item-"), k.cast("string")).alias("id"), F.concat(F.date_format(F.coalesce("acquisition_date", F.to_date(F.lit("2020-01-01"))), "yyyy-MM-dd"), F.lit("T16:00:00Z")).alias("datetime"),
        F.when(k % 8 != 0, F.col("proj_epsg")).alias("epsg"),
        F.array("xmin", "ymin", "xmax", "ymax").alias("proj_bbox"), F.when(k % 2 == 0, F.array(*[F.lit(x) for x in ("red", "green", "blue", "nir")])).alias("common_names"), F.array(*[F.lit(f"B{i}") for i in range(1, 5)]).alias("band_names"),
    )


def buildings(v):
    e = F.col("event_id")
    return v.events.select(
        e.alias("id"), (F.lit(-124.0) + ((e * 6151) % 570000) / 10000.0).alias("xmin"), (F.lit(25.0) + ((e * 9973) % 240000) / 10000.0).alias("ymin"),
        F.when(F.col("event_type") != "error", F.col("value") / 10.0).alias("height"), (F.col("user_id") % 40).cast("int").alias("num_floors"), "props",
    )


def boxes(v):
    s = F.col("s_suppkey")
    x, y = (s * 577) % 57, (s * 733) % 24
    return v.supplier.select(s.alias("idx"), (F.lit(-124.0) + x).alias("west"), (F.lit(25.0) + y).alias("south"), (F.lit(-121.5) + x).alias("east"), (F.lit(26.5) + y).alias("north"))


def ranges(v):
    return v.lineitem.select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") * 4096).cast("long").alias("off"), (F.col("l_quantity") * 1024).cast("long").alias("len"))


def cells(v):
    return v.embeddings.select(F.col("vec_id").alias("tile"), "label", F.posexplode("embedding").alias("pos", "v")).select("tile", "label", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def tiles(v):
    return v.embeddings.select(F.col("vec_id").alias("tile"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def dem_tiles(v):
    p = F.col("p_partkey")
    col, row = (p % 50) * 10000.0, F.expr("p_partkey div 50") * 10000.0
    return v.part.select(p.alias("fid"), F.concat(F.lit("dem/t"), p.cast("string"), F.lit(".tif")).alias("dataset"), col.alias("xmin"), row.alias("ymin"), (col + 10000.0).alias("xmax"), (row + 10000.0).alias("ymax"), ((p % 5) * 1000.0).alias("cut"))


def points(v):
    c = F.col("c_custkey")
    return v.customer.select(c.alias("pid"), ((c * 7907) % 500000).cast("double").alias("x"), ((c * 3571) % 400000).cast("double").alias("y"))


def registry(v):
    n = F.col("n_nationkey")
    return v.nation.select(
        F.lower("n_name").alias("id"), F.when(n % 4 != 0, F.initcap("n_name")).alias("title"), (n % 3 != 0).alias("active"), F.when(n % 7 == 0, "excluded-not-cog").otherwise("ready").alias("status"), F.concat(F.lit("bucket-"), (n % 9).cast("string")).alias("bucket"),
        F.when(n % 11 != 10, F.lit(-124.0) + n * 2.0).alias("west"), (F.lit(25.0) + (n % 8) * 2.5).alias("south"), (F.lit(-114.0) + n * 2.0).alias("east"), (F.lit(32.0) + (n % 8) * 2.5).alias("north"),
    )


def levels(v):
    z = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("z")
    return v.supplier.select(F.col("s_suppkey").alias("raster_id"), z).select("raster_id", "z", F.expr("5000 div shiftleft(1, z)").cast("long").alias("width"), (F.expr("shiftleft(1, z)") * 0.3).alias("mpp"))


def headers(v):
    p = F.col("p_partkey")
    return v.part.select(
        p.alias("file_id"), (F.col("p_size") * 100 + 100).cast("long").alias("width"), (F.col("p_size") * 90 + 100).cast("long").alias("height"), F.when(p % 11 != 0, 512).cast("int").alias("tile_width"), F.when(p % 13 != 12, p % 4).cast("long").alias("ifd_count"),
        F.when(p % 9 != 1, 0.5 + (p % 4) * 0.25).alias("scale_x"), F.when(p % 9 != 2, 500000.0 + (p % 100) * 100.0).alias("tie_x"), (4500000.0 - (p % 77) * 100.0).alias("tie_y"), F.when(p % 7 == 0, 32767).when(p % 7 == 1, F.lit(None)).otherwise(26910 + p % 10).cast("int").alias("epsg"),
        F.when(p % 14 != 0, F.concat(F.lit("NAD83 / UTM zone "), (p % 10 + 10).cast("string"), F.lit("N"))).alias("citation"), (p % 2).cast("int").alias("pixel_is_point"), (p % 6).cast("int").alias("photometric"),
        F.array((F.lit(8)).cast("int"), F.when(p % 10 == 0, 16).otherwise(8).cast("int")).alias("bits"), F.array(F.lit(1), F.when(p % 15 == 0, 3).otherwise(1)).cast("array<int>").alias("formats"),
    )


def requests(v):
    s = F.col("s_suppkey")
    return v.supplier.select(
        s.alias("rid"), F.when(s % 9 == 0, "nan").when(s % 13 == 0, "x").otherwise((F.lit(-124) + s % 50).cast("string")).alias("xmin_text"), F.when(s % 7 == 0, "abc").otherwise((s * 500).cast("string")).alias("limit_text"),
        F.when(s % 11 != 0, F.when(s % 17 == 0, "20x4").otherwise((1992 + s % 7).cast("string"))).alias("year_text"), F.concat(F.lit(" "), F.upper(pick(REGIONS, s)), F.lit("-!")).alias("region_text"),
    )


SPARK = {f.__name__: f for f in (footprints, lake, keys, stac_items, buildings, boxes, ranges, cells, tiles, dem_tiles, points, registry, levels, headers, requests)}

_pick = lambda values, key: f"list_extract([{', '.join(repr(x) for x in values)}], cast({key} % {len(values)} as int)+1)"
SQL = {
    "footprints": f"""select k, region, year, res, acq, cast(-124.0 as double) + gx/100.0 as xmin, cast(25.0 as double) + gy/100.0 as ymin, cast(-123.9375 as double) + gx/100.0 as xmax, cast(25.0625 as double) + gy/100.0 as ymax,
      concat(region,'/',cast(year as varchar),'/',res,'/rgbir_cog/',lpad(cast(k % 100000 as varchar),5,'0'),'/m_',lpad(cast(k as varchar),7,'0'),'_',q,'_18_',tok,'_',strftime(acq,'%Y%m%d'),'.tif') as source_key
      from (select o_orderkey as k, cast(year(o_orderdate) as int) as year, cast(o_orderdate as date) as acq, {_pick(REGIONS, "o_orderkey")} as region, {_pick(["30cm", "60cm", "100cm"], "o_orderkey")} as res,
      {_pick(["030", "060", "100"], "o_orderkey")} as tok, {_pick(["ne", "nw", "se", "sw"], "o_orderkey")} as q, cast((o_orderkey*7919) % 5700 as double) as gx, cast((o_orderkey*104729) % 2400 as double) as gy from orders)""",
    "lake": """select k, 'naip-analytic' as source_bucket, source_key, concat('s3://naip-analytic/', source_key) as asset_href, 'naip' as collection, region, year,
      concat('{"naip:resolution":"', res, '","naip:product":"rgbir","naip:quad":"', lpad(cast(k % 100000 as varchar),5,'0'), '"}') as properties, xmin, ymin, xmax, ymax,
      case when k % 19 <> 0 then acq end as acquisition_date, case when k % 17 <> 0 then cast(case res when '30cm' then 0.3 when '60cm' then 0.6 else 1.0 end as double) end as gsd, case when k % 23 <> 0 then cast(26910 + k % 10 as int) end as proj_epsg,
      [cast(10000 + k % 7 as int), cast(12000 + k % 5 as int)] as proj_shape from footprints""",
    "keys": """select k*4 as line_no, source_key as key from footprints
      union all select k*4+1, concat(regexp_replace(replace(source_key,'/rgbir_cog/','/fgdc/'),'\\.tif$',''), case when k % 2 = 0 then '.xml' else '.txt' end) from footprints where k % 3 <> 0
      union all select k*4+2, concat(regexp_replace(replace(source_key,'/rgbir_cog/','/fgdc/'),'\\.tif$',''), '.xml') from footprints where k % 9 = 1
      union all select k*4+3, case when k % 3 = 0 then 'manifest.txt' when k % 3 = 1 then 'nj/notayear/30cm/rgbir_cog/39075/x.tif' else 'toolong/2023/a/b/c.tif' end from footprints where k % 5 = 0""",
    "stac_items": """select k, asset_href, concat('item-', cast(k as varchar)) as id, concat(strftime(coalesce(acquisition_date, date '2020-01-01'),'%Y-%m-%d'),'T16:00:00Z') as datetime, case when k % 8 <> 0 then proj_epsg end as epsg,
      [xmin, ymin, xmax, ymax] as proj_bbox, case when k % 2 = 0 then ['red','green','blue','nir'] end as common_names, ['B1','B2','B3','B4'] as band_names from lake where k % 10 <> 3""",
    "buildings": """select event_id as id, cast(-124.0 as double)+cast((event_id*6151)%570000 as double)/10000.0 as xmin, cast(25.0 as double)+cast((event_id*9973)%240000 as double)/10000.0 as ymin,
      case when event_type<>'error' then cast(value as double)/10.0 end as height, cast(user_id%40 as int) as num_floors, props from events""",
    "boxes": """select s_suppkey as idx, cast(-124.0+((s_suppkey*577)%57) as double) as west, cast(25.0+((s_suppkey*733)%24) as double) as south, cast(-121.5+((s_suppkey*577)%57) as double) as east, cast(26.5+((s_suppkey*733)%24) as double) as north from supplier""",
    "ranges": "select l_orderkey as file_id, cast(l_partkey*4096 as bigint) as off, cast(l_quantity*1024 as bigint) as len from lineitem",
    "cells": "select vec_id as tile, label, i-1 as pos, cast(embedding[i] as double) as v from embeddings, unnest(range(1,65)) t(i)",
    "dem_tiles": """select p_partkey as fid, concat('dem/t',cast(p_partkey as varchar),'.tif') as dataset, cast((p_partkey%50)*10000.0 as double) as xmin, cast((p_partkey//50)*10000.0 as double) as ymin, cast((p_partkey%50)*10000.0+10000.0 as double) as xmax,
      cast((p_partkey//50)*10000.0+10000.0 as double) as ymax, cast(1000.0*(p_partkey%5) as double) as cut from part""",
    "points": "select c_custkey as pid, cast((c_custkey*7907)%500000 as double) as x, cast((c_custkey*3571)%400000 as double) as y from customer",
    "registry": """select lower(n_name) as id, case when n_nationkey%4<>0 then array_to_string(list_transform(string_split(lower(n_name),' '), lambda w: concat(upper(w[1:1]), w[2:])),' ') end as title, n_nationkey%3<>0 as active, case when n_nationkey%7=0 then 'excluded-not-cog' else 'ready' end as status, concat('bucket-',cast(n_nationkey%9 as varchar)) as bucket,
      case when n_nationkey%11<>10 then cast(-124.0+n_nationkey*2.0 as double) end as west, cast(25.0+(n_nationkey%8)*2.5 as double) as south, cast(-114.0+n_nationkey*2.0 as double) as east, cast(32.0+(n_nationkey%8)*2.5 as double) as north from nation""",
    "levels": "select s_suppkey as raster_id, z, cast(5000 // (1 << z) as bigint) as width, cast(0.3 as double)*(1 << z) as mpp from supplier, unnest([0,1,2,3,4]) t(z)",
    "headers": """select p_partkey as file_id, cast(p_size*100+100 as bigint) as width, cast(p_size*90+100 as bigint) as height, case when p_partkey%11<>0 then 512 end as tile_width, case when p_partkey%13<>12 then cast(p_partkey%4 as bigint) end as ifd_count,
      case when p_partkey%9<>1 then cast(0.5+(p_partkey%4)*0.25 as double) end as scale_x, case when p_partkey%9<>2 then cast(500000.0+(p_partkey%100)*100.0 as double) end as tie_x, cast(4500000.0-(p_partkey%77)*100.0 as double) as tie_y,
      case when p_partkey%7=0 then 32767 when p_partkey%7=1 then null else cast(26910+p_partkey%10 as int) end as epsg, case when p_partkey%14<>0 then concat('NAD83 / UTM zone ',cast(p_partkey%10+10 as varchar),'N') end as citation, cast(p_partkey%2 as int) as pixel_is_point, cast(p_partkey%6 as int) as photometric,
      [8, case when p_partkey%10=0 then 16 else 8 end] as bits, [1, case when p_partkey%15=0 then 3 else 1 end] as formats from part""",
    "requests": f"""select s_suppkey as rid, case when s_suppkey%9=0 then 'nan' when s_suppkey%13=0 then 'x' else cast(-124+s_suppkey%50 as varchar) end as xmin_text, case when s_suppkey%7=0 then 'abc' else cast(s_suppkey*500 as varchar) end as limit_text,
      case when s_suppkey%11<>0 then case when s_suppkey%17=0 then '20x4' else cast(1992+s_suppkey%7 as varchar) end end as year_text, concat(' ',upper({_pick(REGIONS, "s_suppkey")}),'-!') as region_text from supplier""",
}
