"""Raster tiles: neighbourhoods, resampling, mosaics and elevation.

Per-pixel work stays on array columns (no shuffle).  Neighbourhoods of a tile are looked up in its own array too; only
work across tiles (mosaics, samples by place) is on rows of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, pixels, projections
from .spatial import WINDOW, range_join


def at(data: Column, width: int, row: Column, col: Column) -> Column:
    return F.get(data, (row * width + col).cast("int"))


def valid(v: Column, nodata: float, least: float = -9000.0) -> Column:
    return F.when((v > least) & ~F.isnan(v) & (v < float("inf")) & (v != nodata), v)


def resampled(data: Column, sw: int, sh: int, dw: int, dh: int, nodata: float) -> Column:
    """A grid of another size, corners on corners; cells without any valid neighbour are nodata."""

    def value(i: Column) -> Column:
        fx, fy = (i % dw) * ((sw - 1) / (dw - 1) if dw > 1 else 0.0), F.floor(i / dw) * ((sh - 1) / (dh - 1) if dh > 1 else 0.0)
        x0, y0 = F.floor(fx), F.floor(fy)
        x1, y1 = F.least(x0 + 1, F.lit(sw - 1)), F.least(y0 + 1, F.lit(sh - 1))
        get = lambda y, x: valid(at(data, sw, y, x), nodata)
        return pixels.bilinear(get(y0, x0), get(y0, x1), get(y1, x0), get(y1, x1), fx - x0, fy - y0, F.lit(nodata))

    return F.transform(F.sequence(F.lit(0), F.lit(dw * dh - 1)), value)


def gradients(data: Column, width: int, height: int, i: Column) -> tuple[Column, Column, Column, Column]:
    """left, right, up and down of cell i, clamped at the edges."""
    r, c = F.floor(i / width), i % width
    return at(data, width, r, F.greatest(c - 1, F.lit(0))), at(data, width, r, F.least(c + 1, F.lit(width - 1))), at(data, width, F.greatest(r - 1, F.lit(0)), c), at(data, width, F.least(r + 1, F.lit(height - 1)), c)


def normals(data: Column, width: int, height: int, step_x: float, step_y: float, exaggeration: float = 1.0) -> Column:
    """An array of (nx, ny, nz)."""

    def value(i: Column) -> Column:
        left, right, up, down = gradients(data, width, height, i)
        nx, ny = (left - right) * exaggeration / (2 * step_x), (up - down) * exaggeration / (2 * step_y)
        size = F.sqrt(nx * nx + ny * ny + 1.0)
        return F.struct((nx / size).alias("nx"), (ny / size).alias("ny"), (F.lit(1.0) / size).alias("nz"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), value)


def hillshade(data: Column, width: int, height: int, step_x: float, step_y: float, exaggeration: float, nodata: float) -> Column:
    lit = F.zip_with(data, normals(data, width, height, step_x, step_y, exaggeration), lambda v, n: F.when(v != nodata, pixels.lambert(n["nx"], n["ny"], n["nz"])))
    return lit


def sample(data: Column, width: int, height: int, row: Column, col: Column) -> Column:
    """Bilinear value of a place; null outside."""
    r0, c0 = F.floor(row), F.floor(col)
    r1, c1 = F.least(r0 + 1, F.lit(height - 1)), F.least(c0 + 1, F.lit(width - 1))
    inside = (row >= 0) & (row <= height - 1) & (col >= 0) & (col <= width - 1)
    return F.when(inside, pixels.bilinear(at(data, width, r0, c0), at(data, width, r0, c1), at(data, width, r1, c0), at(data, width, r1, c1), col - c0, row - r0, F.lit(None).cast("double")))


def assembled(cells: DataFrame, key: str, tile_w: int, tile_h: int) -> DataFrame:
    """Cells (key, ty, tx, row, col, v) of contiguous tiles as cells of a mosaic whose first tile is at its origin."""
    first = cells.groupBy(key).agg(F.min("ty").alias("_ty"), F.min("tx").alias("_tx"))
    return cells.join(first, key).select(key, ((F.col("ty") - F.col("_ty")) * tile_h + F.col("row")).alias("row"), ((F.col("tx") - F.col("_tx")) * tile_w + F.col("col")).alias("col"), "v")


def assembly_problems(tiles: DataFrame, key: str) -> DataFrame:
    """Per mosaic: reason is null, "duplicate tile" or "missing tiles"."""
    found = tiles.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("ty", "tx").alias("distinct"), ((F.max("ty") - F.min("ty") + 1) * (F.max("tx") - F.min("tx") + 1)).alias("expected"))
    return found.select(key, F.when(F.col("distinct") < F.col("n"), "duplicate tile").when(F.col("distinct") < F.col("expected"), "missing tiles").alias("reason"))


def first_opaque(pixels_of_sources: DataFrame, place: tuple[str, ...], rank: str, value: Column, opaque: Column) -> DataFrame:
    """Of each output pixel, the value of the first source in rank that is opaque there."""
    return pixels_of_sources.where(opaque).groupBy(*place).agg(F.min_by(value, F.col(rank)).alias("value"))


def mosaic(targets: DataFrame, sources: DataFrame, width: int, height: int, target_crs: Column, size: float, opaque=lambda v: v.isNotNull(), block: int = 64) -> DataFrame:
    """(target, row, col, value, source): each target pixel's value from the first source, by rank, that is opaque there.

    targets: target, tx, ty, tw, th (the upper left corner and the size of a pixel, in target_crs); a target has width x height pixels.
    sources: source, rank, sx, sy, sw, sh (upper left corner and pixel size in its own CRS), columns, rows, crs (see projections), data (row by
    row), and west, south, east, north in longitude and latitude: what of it may be shown.

    The pixels of a target are cut into blocks of rows; a block is joined with the sources whose box it meets, and every pixel's centre is
    mapped to longitude and latitude, to the source's CRS and to a row and column there.  A block folds its sources in the order of rank,
    and a source adds only to pixels that are still empty; of the sources that a full block has left over nothing is read.  A pixel whose centre lies outside a
    source's box or grid takes nothing from it.
    """
    rows_a_block = max(1, block // width)
    n = F.col("_rows") * width
    blocks = targets.withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(rows_a_block)))).withColumn("_rows", F.least(F.lit(rows_a_block), F.lit(height) - F.col("_row")))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: projections.to_lonlat(target_crs, F.col("tx") + (i % width + 0.5) * F.col("tw"), F.col("ty") - (F.floor(i / width) + F.col("_row") + 0.5) * F.col("th")))
    blocks = blocks.withColumn("_at", place)
    box = dict(zip((f"_{n}" for n in ("w", "s", "e", "n")), geo.envelope(F.col("_at"))))
    blocks = blocks.select("target", "_row", "_rows", "_at", *[c.alias(k) for k, c in box.items()])
    pairs = range_join(blocks, sources, size, tuple(box), WINDOW)

    def value(q: Column) -> Column:
        own = projections.from_lonlat(F.col("crs"), q["x"], q["y"])

        def looked_up(p: Column) -> Column:
            c, r = F.floor((p["x"] - F.col("sx")) / F.col("sw")), F.floor((F.col("sy") - p["y"]) / F.col("sh"))
            inside = (c >= 0) & (r >= 0) & (c < F.col("columns")) & (r < F.col("rows")) & (q["x"] >= F.col("west")) & (q["x"] <= F.col("east")) & (q["y"] >= F.col("south")) & (q["y"] <= F.col("north"))
            found = F.get(F.col("data"), (r * F.col("columns") + c).cast("int"))
            return F.when(inside & opaque(found), found)

        return F.transform(F.array(own), looked_up)[0]

    seen = pairs.select("target", "_row", "rank", "source", F.transform("_at", value).alias("v")).where(F.exists("v", lambda x: x.isNotNull()))
    # The sources of a block are few: those that meet a place.  Each pixel takes the first that has it.
    ordered = seen.groupBy("target", "_row").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "v"))).alias("s"))
    pixel = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast(sources.schema["source"].dataType).alias("source"))
    empty = F.transform(F.get("s", F.lit(0))["v"], lambda _: pixel)

    def paint(out: Column, s: Column) -> Column:
        full = F.forall(out, lambda x: x["source"].isNotNull())
        return F.when(full, out).otherwise(F.zip_with(out, s["v"], lambda x, v: F.when(x["source"].isNull() & v.isNotNull(), F.struct(v.alias("value"), s["source"].alias("source"))).otherwise(x)))

    painted = ordered.select("target", "_row", F.posexplode(F.aggregate("s", empty, paint)).alias("_i", "p")).where("p.source is not null")
    return painted.select("target", (F.col("_row") + F.floor(F.col("_i") / width)).cast("int").alias("row"), (F.col("_i") % width).alias("col"), "p.value", "p.source")


def undo_differences(cells: DataFrame, by: tuple[str, ...], order: str, value: str, bits: int) -> DataFrame:
    """Running sums of horizontal differences, modulo 2 ** bits."""
    from pyspark.sql import Window as W

    total = F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cells.withColumn(value, F.pmod(total, F.lit(1 << bits)))
