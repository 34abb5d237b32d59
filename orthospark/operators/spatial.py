"""Range joins of boxes, by a hierarchy of grids.

A box's level is the finest grid whose cells are as wide as the box: it touches four of them at most, whether it is a
building's or the world's.  Two boxes that meet share a cell of the coarser of their two levels.  So the join runs on (level, cell):
each side goes to the cells of its own level, and to those of the other side's coarser levels; a pair that
shares several cells is kept in one of them alone (the cell of the upper of the two lower left corners), and nothing has to
be deduplicated.

Cells that many boxes touch (a city's, or the one that a world-wide box shares with all others) are cut into blocks of
either side, and every pair of blocks is a group of its own: a task never gets a whole crowded cell.  Which cells are crowded is
told by a sample, whose choice does not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..sources.files import scratch

BOX = ("xmin", "ymin", "xmax", "ymax")
WINDOW = ("west", "south", "east", "north")
#: Most rows of either side in a group; one row in SHARE tells which cells have more.  Grids are this many at most.
BLOCK, SHARE, LEVELS = 4096, 16, 48
#: Columns that a join adds to its sides and takes away again.
_CELL, _LEVEL, _N, _M, _I, _J = ["_grid_l", "_grid_x", "_grid_y"], "_grid_level", "_grid_n", "_grid_m", "_grid_i", "_grid_j"


def box_level(names: tuple, size: float) -> Column:
    """The finest level, 0 for cells of `size`, each twice as wide as the one before, whose cells are as wide as the box."""
    a, b, c, d = (F.col(n) for n in names)
    wide = F.greatest(F.abs(c - a), F.abs(d - b)) / size
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))))).cast("int")


def cell(v: Column, size: float, level: Column) -> Column:
    return F.floor(v / (F.pow(F.lit(2.0), level) * size)).cast("long")


def to_cells(df: DataFrame, names: tuple, size: float, levels: Column) -> DataFrame:
    """A row for each cell, of each of these levels, that a row's box touches."""
    a, b, c, d = (F.col(n) for n in names)
    at, x, y = _CELL
    across = lambda p, q: F.explode(F.sequence(cell(F.least(p, q), size, F.col(at)), cell(F.greatest(p, q), size, F.col(at))))
    return df.withColumn(at, F.explode(levels)).withColumn(x, across(a, c)).withColumn(y, across(b, d))


def finite(df: DataFrame, names: tuple) -> DataFrame:
    """Rows whose box has four finite numbers; others meet nothing."""
    keep = F.lit(True)
    for n in names:
        keep = keep & (F.abs(F.col(n).cast("double")) < float("inf"))  # null and NaN are not
    return df.where(keep)


def crowded_cells(a: DataFrame, b: DataFrame, share: int, block: int) -> DataFrame | None:
    """(cell, n, m): into how many blocks each side of a crowded cell is cut; None if no cell is.  a and b: a sample's cells."""
    n, m = (side.groupBy(*_CELL).agg((F.count("*") * share).alias(name)) for side, name in ((a, _N), (b, _M)))
    both = n.join(m, _CELL).where((F.col(_N) > block) | (F.col(_M) > block))
    path = scratch(a.sparkSession, "cells")
    both.select(*_CELL, *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in (_N, _M)]).write.parquet(path)
    found = a.sparkSession.read.parquet(path)
    return None if found.isEmpty() else found


def dealt(a: DataFrame, b: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the pair of blocks (i, j) of each row: its own block, by a hash of all its columns, and each of the other side's."""

    def blocks(side: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        columns = [c for c in side.columns if c not in _CELL]
        rows = side.join(crowded, _CELL, "left")
        own_block = F.pmod(F.xxhash64(*columns), F.coalesce(own, F.lit(1))).cast("int")
        return rows.withColumn(i, own_block).withColumn(j, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop(_N, _M)

    return blocks(a, _N, _M, _I, _J), blocks(b, _M, _N, _J, _I), [*_CELL, _I, _J]


def range_join(left: DataFrame, right: DataFrame, size: float, left_box: tuple = BOX, right_box: tuple = WINDOW, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """All pairs of rows whose boxes meet, each once.  Column names of the sides differ; size: cells of the finest grid, about as wide as the most frequent boxes.

    Boxes with a null, NaN or infinite coordinate meet nothing.  Rows that are equal in all their columns share a block.
    """
    a = finite(left, left_box).withColumn(_LEVEL, box_level(left_box, size))
    b = finite(right, right_box).withColumn(_LEVEL, box_level(right_box, size))
    rows = a.select(F.lit("a").alias("side"), _LEVEL).union(b.select(F.lit("b").alias("side"), _LEVEL)).groupBy("side", _LEVEL).agg(F.count("*").alias("n")).collect()  # a row a level
    own = {s: sorted(r[_LEVEL] for r in rows if r.side == s) for s in "ab"}
    sizes = [sum(r.n for r in rows if r.side == s) for s in "ab"]
    most = max(sizes)
    meet = geo.boxes_meet(tuple(F.col(n) for n in left_box), tuple(F.col(n) for n in right_box))
    at = lambda k: cell(F.greatest(F.col(left_box[k]), F.col(right_box[k])), size, F.col(_CELL[0]))
    here = (F.col(_CELL[1]) == at(0)) & (F.col(_CELL[2]) == at(1))
    level = F.col(_LEVEL)

    def above(levels: list[int], least: Column) -> Column:
        return F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= least)

    def joined(a_levels: Column, b_levels: Column) -> DataFrame:
        cells = lambda rows, names, levels: to_cells(rows, names, size, levels).drop(_LEVEL)
        x, y, keys = cells(a, left_box, a_levels), cells(b, right_box, b_levels), _CELL
        if most > block:
            few = lambda rows: rows.sample(1.0 / share, 7) if share > 1 else rows
            crowded = crowded_cells(cells(few(a), left_box, a_levels).select(*_CELL), cells(few(b), right_box, b_levels).select(*_CELL), share, block)
            if crowded is not None:
                x, y, keys = dealt(x, y, crowded)
        if min(sizes) > block:  # Spark takes a side for as large as the table that it comes from, without its cells and rings, and would broadcast it
            x = x.hint("merge")
        return x.join(y, keys).where(meet & here).select(*left.columns, *right.columns)

    # The left side's own level is the coarser one or equal; then the right side's is.
    out = joined(F.array(level), above(own["a"], level)) if own["a"] else None
    if own["a"] and own["b"] and own["b"][-1] > own["a"][0]:
        out = out.union(joined(above(own["b"], level + 1), F.array(level)))
    return out if out is not None else a.join(b, F.lit(False)).select(*left.columns, *right.columns)


def with_first(df: DataFrame, key: str, same: list, first: str = "_first") -> DataFrame:
    """df with the least key of the rows that are equal in these columns: what depends on these alone is worked out for that row, and joined to all that share it."""
    return df.withColumn(first, F.min(key).over(W.partitionBy(*same)))


def semi_join_boxes(df: DataFrame, boxes: DataFrame, key: str, size: float = 1.0, box: tuple = BOX, window: tuple = WINDOW) -> DataFrame:
    """Rows whose box meets any of the boxes, each once."""
    hit = range_join(df.select(key, *box), boxes.select(*window).distinct(), size, box, window).select(key).distinct()
    return df.join(hit, key, "left_semi")


def nearest(requests: DataFrame, items: DataFrame, k: int, size: float, request: str = "rid", item: str = "id", at: tuple = ("rx", "ry"), place: tuple = ("x", "y")) -> DataFrame:
    """(request, item, distance2, rank): the k nearest items of every request, by squared distance, equal ones in the order of their ids.

    Squares grow around the requests that have fewer than k items within their half side, which is doubled each round from
    `size` on; the others are done, as nothing outside the square is nearer.  So a request reads about what lies near it, in a dense place and
    in an empty one.  A square that holds all items ends it, with fewer than k if there are no more.  The best k of each task go into the shuffle, not all
    candidates.  Requests and items without a place meet nothing; ids of requests are unique.
    """
    spark = requests.sparkSession
    own = finite(items.select(F.col(item).alias("_item"), *[F.col(n).cast("double").alias(f"_i{a}") for n, a in zip(place, "xy")]), ("_ix", "_iy"))
    left = finite(requests.select(F.col(request).alias("_request"), *[F.col(n).cast("double").alias(f"_r{a}") for n, a in zip(at, "xy")]), ("_rx", "_ry"))
    e = own.agg(F.min("_ix"), F.min("_iy"), F.max("_ix"), F.max("_iy")).first()
    r = left.agg(F.min("_rx"), F.min("_ry"), F.max("_rx"), F.max("_ry")).first()
    kinds = f"_request {left.schema['_request'].dataType.simpleString()}, _item {own.schema['_item'].dataType.simpleString()}, distance2 double, rank int"
    if e[0] is None or r[0] is None:
        return spark.createDataFrame([], kinds).withColumnsRenamed({"_request": request, "_item": item})
    whole = max(e[2] - r[0], r[2] - e[0], e[3] - r[1], r[3] - e[1])  # half a side that reaches every item from every request
    radius, out, first = size, None, W.partitionBy("_request").orderBy("distance2", "_item")
    d2 = (F.col("_ix") - F.col("_rx")) * (F.col("_ix") - F.col("_rx")) + (F.col("_iy") - F.col("_ry")) * (F.col("_iy") - F.col("_ry"))
    while True:
        squares = left.withColumns({"_w": F.col("_rx") - radius, "_s": F.col("_ry") - radius, "_e": F.col("_rx") + radius, "_n": F.col("_ry") + radius})
        points = own.withColumns({"_x1": F.col("_ix"), "_y1": F.col("_iy"), "_x2": F.col("_ix"), "_y2": F.col("_iy")})
        pairs = range_join(points, squares, size, ("_x1", "_y1", "_x2", "_y2"), ("_w", "_s", "_e", "_n")).withColumn("distance2", d2)
        last = radius >= whole
        if not last:
            pairs = pairs.where(F.col("distance2") <= radius * radius)
        best = pairs.select("_request", "_item", "distance2").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        path = scratch(spark, "nearest")
        best.write.parquet(path)
        best = spark.read.schema(kinds).parquet(path)
        done = best if last else best.join(best.where(F.col("rank") == k).select("_request"), "_request", "left_semi")
        out = done if out is None else out.union(done)
        if not last:
            path = scratch(spark, "left")
            left.join(best.where(F.col("rank") == k).select("_request"), "_request", "left_anti").write.parquet(path)
            left = spark.read.schema(left.schema).parquet(path)
        if last or left.isEmpty():
            return out.withColumnsRenamed({"_request": request, "_item": item})
        radius *= 2
