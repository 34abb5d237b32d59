"""Queries of raster tiles.  A vector of 64 values is a tile of 8 x 8 cells: row = pos div 8, column = pos % 8."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import pixels as P
from ..functions import projections, render
from ..operators import rasters, spatial
from .registry import query

SIDE = 8


def values(v, data):
    """(tile, pos, v) of an array column."""
    return v.tiles.select("tile", F.posexplode(data).alias("pos", "v")).select("tile", F.col("pos").cast("long").alias("pos"), "v")


def six(c):
    return F.round(c, 6) + 0.0


@query("select tile, pos, v from (select tile, pos, case when round(v,1) = 0.1 then 0.1 else v end as v from cells) where v <> 0.1")
def mask_nodata(v):
    data = F.transform("data", lambda x: F.when(F.round(x, 1) == 0.1, 0.1).otherwise(x))
    return values(v, F.transform(data, lambda x: P.masked(x, 0.1))).where("v is not null")


@query("select tile, pos, v from cells where (((tile % 256) >> cast(7 - pos % 8 as int)) & 1) = 1")
def apply_validity_mask(v):
    mask = P.bits_unpacked(F.col("tile") % 256)
    data = F.transform("data", lambda x, i: F.when(F.get(mask, i % 8) != 0, x))
    return values(v, data).where("v is not null")


@query("select tile, pos, round(greatest(0.0, least(1.0, (v + 0.2)/0.4)),6) as v from cells")
def linear_rescale(v):
    return values(v, F.transform("data", lambda x: six(P.rescaled(x, -0.2, 0.2))))


@query("select tile, pos, cast(floor(greatest(0.0, least(1.0, (v*65535 - 1000*(label % 3))/greatest(6000.0 - 1000*(label % 3), 1.0)))*255+0.5) as bigint) as v from cells")
def display_domain_scale(v):
    """16-bit values by their collection's domain."""
    lo = (F.col("label") % 3) * 1000.0
    return v.cells.select("tile", "pos", P.to_display(F.col("v") * 65535, lo, F.lit(6000.0)).alias("v"))


_S = "floor(greatest(0.0, least(1.0, abs(v)))*255)"


@query(f"select tile, pos, cast(floor(greatest(0.0, least(1.0, ({_S}/255 - 0.5)*1.2 + 0.5 + 0.05))*255+0.5) as bigint) as v from cells")
def brightness_contrast(v):
    return v.cells.select("tile", "pos", P.adjusted(F.floor(P.clamp(F.abs("v")) * 255), 0.05, 1.2).alias("v"))


@query("select tile, pos, cast(case when greatest(r,g,b) <= 2 or (least(r,g,b) >= 240 and greatest(r,g,b) - least(r,g,b) <= 12) then 0 else 255 end as int) as alpha from (select tile, pos, (tile*7+pos) % 256 as r, (tile*7+pos+3*(pos % 3)) % 256 as g, (tile*7+pos+5*(tile % 2)) % 256 as b from cells)")
def collar_transparency(v):
    t, p = F.col("tile"), F.col("pos")
    rgb = [(t * 7 + p) % 256, (t * 7 + p + (p % 3) * 3) % 256, (t * 7 + p + (t % 2) * 5) % 256]
    rows = v.cells.select("tile", "pos", *[c.alias(n) for c, n in zip(rgb, "rgb")])
    raw = [F.col(n) for n in "rgb"]
    return rows.select("tile", "pos", P.alpha(raw, raw).alias("alpha"))


@query("select tile, pos, cast((i * 250) >> 8 as int) as r, cast((i * 100) >> 8 as int) as g, case when i = 7 then 0 else 255 end as a from (select tile, pos, (tile + pos) % 256 as i from cells)")
def colormap_lookup(v):
    """A palette of 256 16-bit entries a channel; index 7 is nodata."""
    i = F.col("id").cast("int")
    palette = v.tiles.sparkSession.range(256).select(F.col("id").alias("index"), F.shiftright(i * 250, 8).alias("r"), F.shiftright(i * 100, 8).alias("g"), F.when(i == 7, 0).otherwise(255).alias("a"))
    rows = v.cells.select("tile", "pos", ((F.col("tile") + F.col("pos")) % 256).alias("index"))
    return rows.join(F.broadcast(palette), "index").select("tile", "pos", "r", "g", "a")  # at most 65,536 entries


@query("select tile, pos, case when label % 2 = 0 then v else 1.0 - v end as r from cells")
def grayscale_to_rgb(v):
    x = F.col("v")
    return v.cells.select("tile", "pos", F.when(F.col("label") % 2 == 0, P.gray(x)[0]).otherwise(P.gray(x, True)[0]).alias("r"))


_Q = "select tile, pos, ((tile*3+pos) % 256)/255.0::double as a, ((tile*5+pos*2) % 256)/255.0::double as b, ((tile*7+pos*3) % 256)/255.0::double as c, ((tile+pos) % 256)/255.0::double as d from cells"
_LIN = lambda x: f"case when power({x},3) >= 0.008856 then power({x},3) else ({x} - 16.0/116.0)/7.787 end"
_GAM = lambda x: f"greatest(0.0, least(1.0, case when {x} >= 0.0031308 then 1.055*power(greatest({x},0.0),1/2.4::double)-0.055 else 12.92*{x} end))"


@query(f"""select tile, pos, round((1-a)*(1-d),6) as cmyk_r, round(a + 1.402*(c-0.5),6) as ycc_r, round(a - 0.34414*(b-0.5) - 0.71414*(c-0.5),6) as ycc_g, round({_GAM("lr")},5) as lab_r from (select *, 3.2406*x0 - 1.5372*y0 - 0.4986*z0 as lr from (select *, 0.95047*({_LIN("fx")}) as x0, {_LIN("fy")} as y0, 1.08883*({_LIN("fz")}) as z0
  from (select *, (b-0.5)*255/500 + (a*255+16)/116 as fx, (a*255+16)/116 as fy, (a*255+16)/116 - (c-0.5)*255/200 as fz from ({_Q}))))""")
def cmyk_ycbcr_lab_to_rgb(v):
    t, p = F.col("tile"), F.col("pos")
    rows = v.cells.select("tile", "pos", *[((x % 256) / 255.0).alias(n) for x, n in ((t * 3 + p, "a"), (t * 5 + p * 2, "b"), (t * 7 + p * 3, "c"), (t + p, "d"))])
    a, b, c, d = (F.col(n) for n in "abcd")
    y = P.ycbcr(a, b, c)
    return rows.select("tile", "pos", six(P.cmyk(a, b, c, d)[0]).alias("cmyk_r"), six(y[0]).alias("ycc_r"), six(y[1]).alias("ycc_g"), (F.round(P.cielab(a, b, c)[0], 5) + 0.0).alias("lab_r"))


@query("select file_id, case when len(bits) in (3,4) then 'rgb' when photometric = 0 then 'white is zero' when photometric = 1 then 'black is zero' when photometric = 2 then 'rgb' when photometric = 3 then 'palette' when photometric = 5 then 'cmyk' end as module from headers")
def photometric_dispatch(v):
    p = F.col("photometric")
    named = F.element_at(F.create_map(*[F.lit(x) for x in (0, "white is zero", 1, "black is zero", 2, "rgb", 3, "palette", 5, "cmyk", 6, "ycbcr", 8, "cielab")]), p)
    return v.headers.select("file_id", F.when(F.size("bits").isin(3, 4), "rgb").otherwise(named).alias("module"))


@query("select tile, pos, d[pos + 1] as r, d[(pos // 16)*8*2 + (pos % 8)//2 + 1] as g, d[64 - pos] as b, 1.0::double as a from (select tile, list(v order by pos) as d from cells group by tile), unnest(range(64)) t(pos)")
def composite_bands(v):
    """Three bands of one tile: itself, one at half the resolution, and one turned around."""
    half = lambda i: F.floor(F.floor(i / 8) / 2) * 16 + F.floor((i % 8) / 2)
    out = F.transform("data", lambda x, i: F.struct(x.alias("r"), F.get("data", half(i).cast("int")).alias("g"), F.get("data", F.lit(63) - i).alias("b"), F.lit(1.0).alias("a")))
    return v.tiles.select("tile", F.posexplode(out).alias("pos", "x")).select("tile", F.col("pos").cast("long").alias("pos"), "x.*")


@query("select tile, pos, v, v as back from (select tile, (pos % 16)*4 + pos//16 as pos, v from cells)")
def band_layout_convert(v):
    """64 interleaved samples as four bands of 16 (`v` at the interleaved place), and back."""
    rows = v.tiles.select("tile", P.interleaved(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("data", b * 16 + 1, 16))).alias("mixed"))
    rows = rows.withColumn("back", P.interleaved(P.band_separate(F.col("mixed"), 4)))
    return rows.select("tile", F.posexplode(F.arrays_zip("mixed", "back")).alias("pos", "x")).select("tile", F.col("pos").cast("long").alias("pos"), F.col("x.mixed").alias("v"), "x.back")


@query("select tile, max(case when pos = 2 then v end) as r, max(case when pos = 1 then v end) as g, max(case when pos = 0 then v end) as b, 255.0::double as a from cells group by tile")
def pack_rgba(v):
    rgba = P.packed_rgba(F.col("data"), (2, 1, 0, None), 255.0)
    return v.tiles.select("tile", *[c.alias(n) for c, n in zip(rgba, "rgba")])


def four_tiles(v):
    """Four 8 x 8 tiles to a mosaic; some mosaics lack a tile."""
    t = F.col("tile")
    return v.cells.select(F.expr("tile div 4").alias("mosaic"), (F.expr("(tile % 4) div 2") + 3).alias("ty"), (t % 2 + 5).alias("tx"), F.expr("pos div 8").alias("row"), (F.col("pos") % 8).alias("col"), "v").where("not (mosaic % 5 = 0 and ty = 4 and tx = 6)")


@query("select tile // 4 as mosaic, ((tile % 4) // 2)*8 + pos // 8 as row, (tile % 2)*8 + pos % 8 as col, v, (tile // 4) % 5 = 0 as incomplete from cells where not ((tile // 4) % 5 = 0 and tile % 4 = 3)")
def assemble_tiles(v):
    cells = four_tiles(v)
    bad = rasters.assembly_problems(cells.select("mosaic", "ty", "tx").distinct(), "mosaic")
    return rasters.assembled(cells, "mosaic", SIDE, SIDE).join(bad, "mosaic").select("mosaic", "row", "col", "v", F.col("reason").isNotNull().alias("incomplete"))


@query("select tile, pos, v from cells where pos % 8 < 5 + tile % 4 and pos // 8 < 6")
def clip_edge_tiles(v):
    width = F.col("tile") % 4 + 5
    return values(v, F.transform("data", lambda x, i: F.when((i % 8 < width) & (F.floor(i / 8) < 6), x))).where("v is not null")


_RS = """select tile, i, case when n = 4 then (v00*(1-wx)+v01*wx)*(1-wy)+(v10*(1-wx)+v11*wx)*wy when n > 0 then s/n else -9999.0 end as v from (
  select *, (v00 is not null)::int+(v01 is not null)::int+(v10 is not null)::int+(v11 is not null)::int as n, coalesce(v00,0)+coalesce(v01,0)+coalesce(v10,0)+coalesce(v11,0) as s from (
  select g.tile, i, fx-x0 as wx, fy-y0 as wy, d[y0*8+x0+1] as v00, d[y0*8+least(7,x0+1)+1] as v01, d[least(7,y0+1)*8+x0+1] as v10, d[least(7,y0+1)*8+least(7,x0+1)+1] as v11 from (
  select tile, i, (i%5)*7/4.0 as fx, (i//5)*7/4.0 as fy, cast(floor((i%5)*7/4.0) as int) as x0, cast(floor((i//5)*7/4.0) as int) as y0 from (select distinct tile from cells), unnest(range(25)) t(i)) g
  join (select tile, list(case when round(v,2) = 0.05 then null else v end order by pos) as d from cells group by tile) c using (tile)))"""


@query(f"select tile, i, round(v,6)+0.0 as v from ({_RS})")
def resample_grid_bilinear(v):
    """8 x 8 to 5 x 5; values that round to 0.05 are voids."""
    data = F.transform("data", lambda x: F.when(F.round(x, 2) == 0.05, -9999.0).otherwise(x))
    rows = v.tiles.select("tile", data.alias("data"))
    return rows.select("tile", F.posexplode(rasters.resampled(F.col("data"), 8, 8, 5, 5, -9999.0)).alias("i", "v")).select("tile", F.col("i").cast("long").alias("i"), six(F.col("v")).alias("v"))


@query("select tile, coalesce(min(case when abs(v) < 0.3 then v end), 0.0) as lo, coalesce(max(case when abs(v) < 0.3 then v end), 0.0) as hi, sum(case when abs(v) < 0.3 then 0 else 1 end)::bigint as voids from cells group by tile")
def elevation_tile_stats(v):
    ok = F.filter("data", lambda x: F.abs(x) < 0.3)
    return v.tiles.select("tile", F.coalesce(F.array_min(ok), F.lit(0.0)).alias("lo"), F.coalesce(F.array_max(ok), F.lit(0.0)).alias("hi"), (F.size("data") - F.size(ok)).cast("long").alias("voids"))


_NORMAL = """select tile, pos, nx/sqrt(nx*nx+ny*ny+1) as nx, ny/sqrt(nx*nx+ny*ny+1) as ny, 1/sqrt(nx*nx+ny*ny+1) as nz, v from (select tile, pos, v, {e}*(coalesce(lag(v) over r, v)-coalesce(lead(v) over r, v))/(2*0.5) as nx, {e}*(coalesce(lag(v) over c, v)-coalesce(lead(v) over c, v))/(2*0.5) as ny from cells
  window r as (partition by tile, pos//8 order by pos), c as (partition by tile, pos%8 order by pos))"""


@query(f"select tile, pos, round(nx,6)+0.0 as nx, round(ny,6)+0.0 as ny, round(nz,6) as nz from ({_NORMAL.format(e=1)})")
def terrain_normals(v):
    """By windows along rows and columns, edges clamped."""
    x = F.col("v")
    r, c = W.partitionBy("tile", F.floor(F.col("pos") / 8)).orderBy("pos"), W.partitionBy("tile", F.col("pos") % 8).orderBy("pos")
    side = lambda f, w: F.coalesce(f(x).over(w), x)
    rows = v.cells.withColumns({"nx": side(F.lag, r) - side(F.lead, r), "ny": side(F.lag, c) - side(F.lead, c)})
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + 1.0)
    return rows.select("tile", "pos", six(F.col("nx") / size).alias("nx"), six(F.col("ny") / size).alias("ny"), F.round(F.lit(1.0) / size, 6).alias("nz"))


@query(f"select tile, pos, round(greatest(0.0, least(1.0, (nx*0.5+ny*0.6+nz*0.8)/sqrt(1.25)))*0.7+0.35,6) as v from ({_NORMAL.format(e=3)})")
def hillshade(v):
    return values(v, F.transform(rasters.hillshade(F.col("data"), SIDE, SIDE, 0.5, 0.5, 3.0, -9999.0), lambda x: F.round(x, 6)))


_T = "greatest(0.0, least(1.0, abs(v)*4))"
_STEP = lambda k: "case " + " ".join(f"when t <= {t1} then cast(floor({c0[k]} + (t-{t0})/({t1 - t0!r})::double*({c1[k]}-{c0[k]})+0.5) as bigint)" for (t0, c0), (t1, c1) in zip(P.STOPS, P.STOPS[1:])) + " else 245 end"


@query(f"select tile, pos, {_STEP(0)} as r, {_STEP(1)} as g, {_STEP(2)} as b from (select tile, pos, round({_T},4) as t from cells)")
def hypsometric_color(v):
    t = F.round(P.clamp(F.abs("v") * 4), 4)
    return v.cells.select("tile", "pos", *[c.alias(n) for c, n in zip(P.hypsometric(t), "rgb")])


# Elevation grids: the tiles' 8 x 8 cells, set on the DEM tiles by number.


def grids(v):
    return v.dem_tiles.join(v.tiles.select(F.col("tile").alias("fid"), "data"), "fid")


_GRIDS = "select d.*, c.data from dem_tiles d join (select tile, list(v order by pos) as data from cells group by tile) c on c.tile = d.fid"
_SITES = "(select id as pid, (xmin + 0.00025 + 124.0)/57.0*500000.0 as x, (ymin + 0.00025 - 25.0)/24.0*400000.0 as y from buildings)"
_SAMPLE = f"""select pid, case when fid is null then null else round((d[r0*8+c0+1]*(1-fc)+d[r0*8+least(7,c0+1)+1]*fc)*(1-fr)+(d[least(7,r0+1)*8+c0+1]*(1-fc)+d[least(7,r0+1)*8+least(7,c0+1)+1]*fc)*fr,6)+0.0 end as ground from (
  select pid, fid, data as d, cast(floor(col) as int) as c0, cast(floor(row) as int) as r0, col-floor(col) as fc, row-floor(row) as fr from (select p.pid, g.fid, g.data, (p.x-g.xmin)/(g.xmax-g.xmin)*7 as col, (g.ymax-p.y)/(g.ymax-g.ymin)*7 as row
  from {_SITES} p left join (select p.pid, min(g.fid) as fid from {_SITES} p join ({_GRIDS}) g on p.x between g.xmin and g.xmax and p.y between g.ymin and g.ymax group by 1) m using (pid) left join ({_GRIDS}) g on g.fid = m.fid))"""


def sites(v):
    """(pid, x, y): the buildings' centres on the grids' plane, which spans the archive's extent."""
    return v.buildings.select(F.col("id").alias("pid"), ((F.col("xmin") + 0.00025 + 124.0) / 57.0 * 500000.0).alias("x"), ((F.col("ymin") + 0.00025 - 25.0) / 24.0 * 400000.0).alias("y"))


def grounds(v):
    """(pid, ground): of each building's centre in the first grid that covers it; null where none does."""
    p = sites(v)
    wide = p.withColumns({"west": F.col("x"), "south": F.col("y"), "east": F.col("x"), "north": F.col("y")})
    pairs = spatial.range_join(v.dem_tiles.join(v.tiles.select(F.col("tile").alias("fid")), "fid").select("fid", *spatial.BOX), wide, 10_000.0)
    first = pairs.groupBy("pid").agg(F.min("fid").alias("fid"))
    rows = p.join(first, "pid", "left").join(grids(v), "fid", "left")
    col = (F.col("x") - F.col("xmin")) / (F.col("xmax") - F.col("xmin")) * 7
    row = (F.col("ymax") - F.col("y")) / (F.col("ymax") - F.col("ymin")) * 7
    return rows.select("pid", rasters.sample(F.col("data"), SIDE, SIDE, row, col).alias("ground"))


@query(_SAMPLE)
def building_ground_elevation(v):
    return grounds(v).select("pid", six(F.col("ground")).alias("ground"))


@query(f"select pid, round(coalesce(ground,0.0)*2,6)+0.0 as base, round(coalesce(ground,0.0)*2 + coalesce(height, case when num_floors <> 0 then num_floors*3.2 end, 4.0),6) as top, ground is not null as seated from ({_SAMPLE}) join (select id, height, num_floors from buildings) on id = pid")
def seat_buildings(v):
    """Base and top of every building on the ground, which is exaggerated twofold; without ground the base is 0."""
    g = F.coalesce(six(F.col("ground")), F.lit(0.0)) * 2
    height = F.coalesce("height", F.when(F.col("num_floors") != 0, F.col("num_floors") * 3.2), F.lit(4.0))
    return grounds(v).join(v.buildings.select(F.col("id").alias("pid"), "height", "num_floors"), "pid").select("pid", six(g).alias("base"), F.round(g + height, 6).alias("top"), F.col("ground").isNotNull().alias("seated"))


@query("""select tile, pos, case when m is not null then cast(floor(greatest(0.0, least(1.0, (r - 0.5)*1.2 + 0.55))*255 + 0.5) as bigint) end as gray, case when m is null then 0 else 255 end as alpha
  from (select tile, pos, m, greatest(0.0, least(1.0, (m + 0.2)/0.4)) as r from (select tile, pos, case when round(v,1) = 0.1 then null else v end as m from cells))""")
def render_pipeline(v):
    """An ordered pipeline of pixel modules: nodata mask, rescaling, brightness and contrast, 8 bits; a masked pixel is transparent."""
    render = P.compose(lambda x: F.when(F.round(x, 1) != 0.1, x), lambda x: P.rescaled(x, -0.2, 0.2), lambda x: P.clamp((x - 0.5) * 1.2 + 0.55), lambda x: P.half_up(x * 255))
    shown = v.cells.select("tile", "pos", render(F.col("v")).cast("long").alias("gray"))
    return shown.withColumn("alpha", F.when(F.col("gray").isNull(), 0).otherwise(255))


@query("select place, pos, arg_min(v, tile) as value from (select tile % 50 as place, tile, pos, v from cells where v > 0.05) group by 1, 2")
def mosaic_first_opaque(v):
    """Ten sources over each place: the first (by number) whose pixel is opaque."""
    rows = v.cells.select((F.col("tile") % 50).alias("place"), "tile", "pos", "v")
    return rasters.first_opaque(rows, ("place", "pos"), "tile", F.col("v"), F.col("v") > 0.05)


_LOOKS = "select tile, label, pos, v, case when label % 2 = 0 then -0.2 else -0.1 end::double as lo, case when label % 2 = 0 then 0.2 else 0.3 end::double as hi, case when label % 3 <> 0 then 0.1::double end as nodata, d[64 - pos] as g, d[(pos // 8) * 8 + 8 - pos % 8] as b from cells join (select tile, list(v order by pos) as d from cells group by tile) using (tile)"
_SHOWN = lambda c: f"floor(greatest(0.0, least(1.0, (greatest(0.0, least(1.0, ({c} - lo) / (hi - lo))) - 0.5) * 1.2 + 0.55)) * 255 + 0.5)"


@query(f"""select tile, pos, r, gg as g, bb as b, case when r is null or gg is null or bb is null then 0.0 when greatest(r8, g8, b8) <= 2 or (least(r, gg, bb) >= 240 and greatest(r, gg, bb) - least(r, gg, bb) <= 12) then 0.0 else 255.0 end::double as alpha
  from (select tile, pos, case when nodata is null or round(v, 1) <> nodata then {_SHOWN("v")} end::double as r, case when nodata is null or round(g, 1) <> nodata then {_SHOWN("g")} end::double as gg, case when nodata is null or round(b, 1) <> nodata then {_SHOWN("b")} end::double as bb,
    floor(v * 255 + 0.5) as r8, floor(g * 255 + 0.5) as g8, floor(b * 255 + 0.5) as b8 from ({_LOOKS}))""")
def render_by_collection(v):
    """Three bands through a pipeline given as data, whose nodata and domain are each collection's own, joined."""
    label = F.col("label")
    looks = v.embeddings.select("label").distinct().select("label", F.when(label % 2 == 0, -0.2).otherwise(-0.1).alias("lo"), F.when(label % 2 == 0, 0.2).otherwise(0.3).alias("hi"), F.when(label % 3 != 0, 0.1).alias("nodata"))
    rows = v.tiles.join(v.embeddings.select(F.col("vec_id").alias("tile"), "label"), "tile").join(looks, "label")
    cells = rows.select("tile", "lo", "hi", "nodata", "data", F.posexplode("data").alias("pos", "v"))
    at = lambda i: F.get("data", i.cast("int"))
    pos = F.col("pos")
    pipeline = [
        {"module": "mask", "props": {"nodata": F.col("nodata"), "digits": 1}}, {"module": "composite", "props": {"order": [0, 1, 2]}}, {"module": "rescale", "props": {"lo": F.col("lo"), "hi": F.col("hi")}},
        {"module": "adjust", "props": {"brightness": 0.05, "contrast": 1.2}}, {"module": "quantize"}, {"module": "collar"},
    ]
    (r, g, b), alpha = render.compiled(pipeline, [at(pos), at(F.lit(63) - pos), at(F.floor(pos / 8) * 8 + 7 - pos % 8)])
    return cells.select("tile", F.col("pos").cast("long").alias("pos"), r.alias("r"), g.alias("g"), b.alias("b"), alpha.alias("alpha"))


_R = 6378137.0
_MOSAIC = f"""with src as (select tile as source, list(v order by pos) as d, cast(tile % 40 as double) * 0.5 - 10 as x0, 40 - cast(tile % 17 as double) * 0.5 as y0, 0.0625::double * (1 + tile % 3) as w, 0.5::double * (1 + tile % 3) as span from cells where tile % 7 <> 0 group by tile),
  t as (select c as tc, r as tr, i as row, j as col, degrees((-1000000.0 + c * 400000.0 + (j + 0.5) * 25000.0) / {_R}) as lon, degrees(atan(sinh((5000000.0 - r * 400000.0 - (i + 0.5) * 25000.0) / {_R}))) as lat from range(6) a(c), range(5) b(r), range(16) p(i), range(16) q(j))"""


@query(f"""{_MOSAIC} select cast(tr * 10 + tc as bigint) as target, cast(row as int) as row, cast(col as int) as col, arg_min(v, source) as value, min(source) as source from (
    select t.*, s.source, d[cast(floor((s.y0 - lat) / w) * 8 + floor((lon - s.x0) / w) + 1 as int)] as v from t join src s on lon >= s.x0 and lon < s.x0 + s.span and lat <= s.y0 and lat > s.y0 - s.span and lon <= s.x0 + s.span * 0.75) where v > 0.02 group by 1, 2, 3""")
def mosaic_by_inverse_mapping(v):
    """Mercator tiles from sources of three resolutions in longitude and latitude, each shown in three quarters of its width: the first opaque one by number."""
    t = F.col("tile")
    sources = v.tiles.where("tile % 7 <> 0").select(
        t.alias("source"), t.alias("rank"), "data", ((t % 40).cast("double") * 0.5 - 10).alias("sx"), (F.lit(40) - (t % 17).cast("double") * 0.5).alias("sy"), ((t % 3 + 1) * 0.0625).alias("sw"), ((t % 3 + 1) * 0.0625).alias("sh"),
        F.lit(8).alias("columns"), F.lit(8).alias("rows"), projections.crs("longlat").alias("crs"), ((t % 3 + 1) * 0.5).alias("span"),
    )
    sources = sources.withColumns({"west": F.col("sx"), "south": F.col("sy") - F.col("span"), "east": F.col("sx") + F.col("span") * 0.75, "north": F.col("sy")}).drop("span")
    grid = v.part.select((F.col("p_partkey") % 6).alias("c"), (F.floor(F.col("p_partkey") / 6) % 5).alias("r")).distinct()
    targets = grid.select((F.col("r") * 10 + F.col("c")).cast("long").alias("target"), (F.lit(-1000000.0) + F.col("c") * 400000.0).alias("tx"), (F.lit(5000000.0) - F.col("r") * 400000.0).alias("ty"), F.lit(25000.0).alias("tw"), F.lit(25000.0).alias("th"))
    return rasters.mosaic(targets, sources, 16, 16, projections.of_epsg(F.lit(3857)), 0.5, lambda x: x > 0.02)


@query("select tile, pos, v from cells where pos % 8 between 2 and 5 and pos // 8 between 1 and 6")
def cutline_clip(v):
    return v.cells.where((F.col("pos") % 8).between(2, 5) & F.floor(F.col("pos") / 8).between(1, 6)).select("tile", "pos", "v")


@query("select tile, pos, round(v * (1 + (tile % 3)) + (tile % 2) * 0.5, 6) as v from cells")
def scale_offset_bands(v):
    bands = v.tiles.select("tile", (F.col("tile") % 3 + 1).alias("scale"), ((F.col("tile") % 2) * 0.5).alias("off"))
    return v.cells.join(bands, "tile").select("tile", "pos", F.round(F.col("v") * F.col("scale") + F.col("off"), 6).alias("v"))


@query("select tile, pos, cast(sum(d) over (partition by tile, pos // 8 order by pos) % 256 as bigint) as v from (select tile, pos, cast(floor(abs(v)*1000) as bigint) % 256 as d from cells)")
def undo_horizontal_differencing(v):
    rows = v.cells.select("tile", "pos", F.floor(F.col("pos") / 8).alias("row"), (F.floor(F.abs("v") * 1000) % 256).alias("v"))
    return rasters.undo_differences(rows, ("tile", "row"), "pos", "v", 8).select("tile", "pos", "v")
