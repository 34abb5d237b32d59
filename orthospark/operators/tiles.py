"""Tile grids, pyramid levels and byte ranges."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..sources.files import removed, scratch


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def assigned_ranges(ranges: DataFrame, gap: int = 1 << 20, most: int = 16 << 20) -> DataFrame:
    """(file_id, off, len, group_off, start): each byte range with the group that it is fetched in, and where it starts inside.

    A file's ranges are merged in order while the gap and the merged size allow.  Sparse ranges (offset or length 0, or null)
    are left out; a range that is larger than a group is one by itself, and repeated ranges share theirs.  The size limit makes groups depend on order, so a file's
    ranges are folded in order: files are dealt to tasks and sorted by Spark, and a task keeps the open group alone, whatever
    the number of a file's ranges.
    """
    kind = ranges.schema["file_id"].dataType.simpleString()

    def fold(batches):
        file, first, stop = None, 0, 0
        for batch in batches:
            groups = []
            for own, off, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                end = max(stop, off + size)
                if own != file or off - stop > gap or end - first > most:
                    file, first, end = own, off, off + size
                stop = end
                groups.append(first)
            start = pc.subtract(batch.column(1), pa.array(groups, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64()), start], names=["file_id", "off", "len", "group_off", "start"])

    rows = ranges.where("off > 0 and len > 0 and file_id is not null").select("file_id", F.col("off").cast("long").alias("off"), F.col("len").cast("long").alias("len"))
    return rows.repartition("file_id").sortWithinPartitions("file_id", "off", "len").mapInArrow(fold, f"file_id {kind}, off long, len long, group_off long, start long")


def coalesced_ranges(ranges: DataFrame, gap: int = 1 << 20, most: int = 16 << 20) -> DataFrame:
    """(file_id, group_off, group_len, n): the groups of assigned_ranges, with their lengths and numbers of ranges."""
    end = F.max(F.col("start") + F.col("len")).alias("group_len")
    return assigned_ranges(ranges, gap, most).groupBy("file_id", "group_off").agg(end, F.count("*").alias("n"))


def select_level(levels: DataFrame, wanted: DataFrame, rule: str, key: str = "raster_id") -> DataFrame:
    """One level for each row of wanted (key, want, ...): by resolution or width, with explicit ties.

    closest-finer: the coarsest level of mpp <= want, else the finest; closest: the least difference of mpp, the finer
    first; log2: the least |log2(width / want)|, the smaller z first; at-least: the least width >= want, else the widest.
    """
    rows = wanted.join(levels, key)
    mpp, width, want = F.col("mpp"), F.col("width"), F.col("want")
    order = {
        "closest-finer": [F.when(mpp <= want, 0).otherwise(1), F.when(mpp <= want, -mpp).otherwise(mpp)],
        "closest": [F.abs(mpp - want), F.col("z")],
        "log2": [F.abs(F.log2(width / want)), F.col("z")],
        "at-least": [F.when(width >= want, 0).otherwise(1), F.when(width >= want, width).otherwise(-width)],
    }[rule]
    pick = F.min_by(F.struct("z", "mpp", "width"), F.struct(*order))
    return rows.groupBy(*wanted.columns).agg(pick.alias("level")).select(*wanted.columns, "level.*")


def tile_range(box: tuple, origin_x: Column, origin_y: Column, tile_x: Column, tile_y: Column, columns: Column, rows: Column, clamp: str = "empty") -> tuple:
    """(min col, min row, max col, max row) of a north-up grid's tiles that a box touches.

    "empty": nothing (null) for a box outside; "edge": the nearest tiles.
    """
    c0, c1 = F.floor((box[0] - origin_x) / tile_x), F.floor((box[2] - origin_x) / tile_x)
    r0, r1 = F.floor((origin_y - box[3]) / tile_y), F.floor((origin_y - box[1]) / tile_y)
    inside = (c1 >= 0) & (r1 >= 0) & (c0 < columns) & (r0 < rows)
    limit = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v))
    out = limit(c0, columns), limit(r0, rows), limit(c1, columns), limit(r1, rows)
    return tuple(F.when(inside, v) if clamp == "empty" else v for v in out)


def exploded_range(df: DataFrame, r: tuple, x: str = "col", y: str = "row") -> DataFrame:
    there = df.withColumns({"_c0": r[0], "_r0": r[1], "_c1": r[2], "_r1": r[3]}).where("_c0 is not null")
    return there.withColumn(x, F.explode(F.sequence("_c0", "_c1"))).withColumn(y, F.explode(F.sequence("_r0", "_r1"))).drop("_c0", "_r0", "_c1", "_r1")


def tile_matrix_set(headers: DataFrame, tile: int = 512) -> DataFrame:
    """A row a level, coarsest first (order 0): halved until it fits one tile."""
    longest = F.greatest("width", "height")
    top = F.greatest(F.lit(0), F.ceil(F.log2(longest / float(tile)))).cast("int")
    rows = headers.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn("factor", F.pow(F.lit(2.0), F.col("level")))
    w, h = F.ceil(F.col("width") / F.col("factor")), F.ceil(F.col("height") / F.col("factor"))
    rows = rows.withColumns({"level_width": w, "level_height": h, "cell_size": F.col("scale_x") * F.col("factor")})
    rows = rows.withColumns({"scale_denominator": F.col("cell_size") / 0.00028, "matrix_width": F.ceil(F.col("level_width") / tile), "matrix_height": F.ceil(F.col("level_height") / tile)})
    return rows.withColumn("order", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc("level"))) - 1)


def sorted_by_distance(items: DataFrame, request: str, x: Column, y: Column, to_x: Column, to_y: Column, tie: str) -> DataFrame:
    """items with distance2 and rank, their place by distance within their request; equal distances are in the order of tie.

    All requests are sorted at once, by ranges of (request, distance), so that a request with many items is sorted by several tasks; a rank is
    the row's number less that of its request's first row.
    """
    spark = items.sparkSession
    rows, order = scratch(spark, "distances"), [F.col(request), F.col("distance2"), F.col(tie)]
    items.withColumn("distance2", (x - to_x) * (x - to_x) + (y - to_y) * (y - to_y)).write.parquet(rows)
    placed = scratch(spark, "places")
    spark.read.parquet(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_sorted_place", F.monotonically_increasing_id()).write.parquet(placed)
    removed(spark, rows)
    placed = spark.read.parquet(placed).withColumn("_sorted_part", F.shiftright("_sorted_place", 33))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("_sorted_part").count().collect()):  # a row a range
        before.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(before, "_sorted_part long, _sorted_before long"))
    numbered = placed.join(table, "_sorted_part").withColumn("_sorted_number", F.col("_sorted_before") + F.col("_sorted_place").bitwiseAND(F.lit((1 << 33) - 1)))
    first = numbered.groupBy(F.col(request).alias("_sorted_request")).agg(F.min("_sorted_number").alias("_sorted_first"))
    return numbered.join(first, F.col(request).eqNullSafe(F.col("_sorted_request"))).withColumn("rank", F.col("_sorted_number") - F.col("_sorted_first") + 1).drop("_sorted_part", "_sorted_before", "_sorted_place", "_sorted_number", "_sorted_request", "_sorted_first")


def covering_tiles(primary: DataFrame, px: float, sx: float) -> DataFrame:
    """Primary tiles (col, row) of px units and the index range of sx-unit tiles that cover each, with its place in that block."""
    first, last = lambda v: F.floor(v * px / sx), lambda v: F.ceil((v + 1) * px / sx) - 1
    c, r = F.col("col"), F.col("row")
    out = primary.withColumns({"min_col": first(c), "max_col": last(c), "min_row": first(r), "max_row": last(r)})
    span_x, span_y = (F.col("max_col") - F.col("min_col") + 1) * sx, (F.col("max_row") - F.col("min_row") + 1) * sx
    return out.withColumns({"offset_u": (c * px - F.col("min_col") * sx) / span_x, "offset_v": (r * px - F.col("min_row") * sx) / span_y, "scale_u": F.lit(px) / span_x, "scale_v": F.lit(px) / span_y})


def clipped_ring(ring: Column, box: tuple) -> Column:
    """A ring (not closed) clipped to a box, side by side (Sutherland and Hodgman); empty if nothing is left.

    A ring inside the box is kept as it is.  Else a fold over the box's sides: each step refers to the ring so far by name, so
    the expression stays small.
    """
    box = tuple(geo.lit(b) for b in box)
    inside_all = F.forall(ring, lambda p: (p["x"] >= box[0]) & (p["y"] >= box[1]) & (p["x"] <= box[2]) & (p["y"] <= box[3]))
    side = lambda axis, sign, value: F.struct(F.lit(axis).alias("axis"), F.lit(float(sign)).alias("sign"), geo.lit(value).alias("value"))
    sides = F.array(side("x", 1, box[0]), side("x", -1, box[2]), side("y", 1, box[1]), side("y", -1, box[3]))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def clip(points: Column, at: Column) -> Column:
        along = lambda p: F.when(at["axis"] == "x", p["x"]).otherwise(p["y"])
        inside = lambda p: (along(p) - at["value"]) * at["sign"] >= 0

        def kept(q: Column, i: Column) -> Column:
            p = F.get(points, F.when(i == 0, F.size(points) - 1).otherwise(i - 1))
            t = (at["value"] - along(p)) / F.nullif(along(q) - along(p), F.lit(0.0))
            cross = geo.point(F.when(at["axis"] == "x", at["value"]).otherwise(p["x"] + (q["x"] - p["x"]) * t), F.when(at["axis"] == "y", at["value"]).otherwise(p["y"] + (q["y"] - p["y"]) * t))
            return F.concat(F.when(inside(p) != inside(q), F.array(cross)).otherwise(none), F.when(inside(q), F.array(q)).otherwise(none))

        return F.coalesce(F.flatten(F.transform(points, kept)), none)

    given = ring.cast("array<struct<x:double,y:double>>")
    return F.when(inside_all, given).otherwise(F.aggregate(sides, given, clip))
