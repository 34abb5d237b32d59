"""Image headers: size, samples and georeferencing of TIFF files, one row a file."""

from __future__ import annotations

import fnmatch
import html
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, projections
from .files import exists, listed, listing, opened, store_of

#: Bytes fetched at once at a file's start; most bytes of a tag, and most directories, that are taken for real.
PREFIX, MOST_BYTES, MOST_DIRECTORIES = 1 << 17, 1 << 26, 1000
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
# TIFF and GeoTIFF tags.
WIDTH, HEIGHT, BITS, SAMPLES, TILE_WIDTH, SCALE, TIEPOINT, GEOKEYS, CITATION, METADATA = 256, 257, 258, 277, 322, 33550, 33922, 34735, 34737, 42112
_WANTED = {WIDTH, HEIGHT, BITS, SAMPLES, TILE_WIDTH, SCALE, TIEPOINT, GEOKEYS, CITATION, METADATA}


class Ranges:
    """Reads of ranges of a file; its first bytes (prefix) are fetched once, what lies beyond them when it is asked for, most bytes at a time."""

    def __init__(self, file, prefix: int = PREFIX, most: int = MOST_BYTES):
        self.file, self.size, self.most = file, file.size(), most
        self.first = file.read_at(min(prefix, self.size), 0)

    def __call__(self, at: int, n: int) -> bytes:
        if n > self.most:
            raise ValueError(f"a tag of more than {self.most} bytes")
        if at + n <= len(self.first):
            return self.first[at : at + n]
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""


def directories(data, most: int = MOST_DIRECTORIES) -> list[dict[int, tuple | str]]:
    """The tags of every directory of a TIFF, classic or big (of 64-bit offsets); data: its bytes, or read(at, n); most: directories that are taken for real."""
    read = data if callable(data) else lambda at, n: data[at : at + n]
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(order + "H", start[2:4])[0] if order and len(start) >= 8 else 0
    if magic == 43 and (len(start) < 16 or struct.unpack(order + "HH", start[4:8]) != (8, 0)):
        magic = 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # Sizes of counts and entries, and codes of counts, entries and offsets.
    n_count, n_entry, n_offset, count_code, entry_code, offset_code = (2, 12, 4, "H", "HHI", "I") if magic == 42 else (8, 20, 8, "Q", "HHQ", "Q")
    out, place, seen = [], struct.unpack(order + offset_code, start[4:8] if magic == 42 else start[8:16])[0], set()
    while place:
        if place in seen:
            raise ValueError("directories form a cycle")
        if len(seen) >= most:
            raise ValueError(f"more than {most} directories")
        seen.add(place)
        head = read(place, n_count)
        count = struct.unpack(order + count_code, head)[0] if len(head) == n_count else 0
        table = read(place + n_count, n_entry * count + n_offset)
        if not count or len(table) < n_entry * count:
            raise ValueError("a directory is cut off")
        tags: dict[int, tuple | str] = {}
        for k in range(count):
            entry = table[n_entry * k : n_entry * (k + 1)]
            tag, kind, n = struct.unpack(order + entry_code, entry[:-n_offset])
            size, value = _SIZES.get(kind, 0) * n, entry[-n_offset:]
            raw = value[:size] if size <= n_offset else read(struct.unpack(order + offset_code, value)[0], size) if tag in _WANTED else b""
            if kind == 2:
                tags[tag] = raw.split(b"\0")[0].decode("ascii", "replace")
            elif kind in _CODES and len(raw) == size:
                tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
        out.append(tags)
        place = struct.unpack(order + offset_code, table[n_entry * count :])[0] if len(table) == n_entry * count + n_offset else 0
    return out


def band_names(metadata: str) -> list[str] | None:
    """The bands' descriptions in a file's XML metadata, by sample; none if it has none."""
    found = {}
    for item, text in re.findall(r"<Item\b([^>]*)>([^<]*)</Item>", metadata):
        at = dict(re.findall(r'(\w+)="([^"]*)"', item))
        if at.get("role", "").lower() == "description" and at.get("sample", "").isdigit():
            found[int(at["sample"])] = html.unescape(text)
    return [found[k] for k in sorted(found)] or None


def geokeys(values: tuple) -> dict[int, int]:
    """Keys whose value stands in the directory itself."""
    n = values[3] if len(values) >= 4 else 0
    rows = [values[4 * i + 4 : 4 * i + 8] for i in range(n)]
    return {r[0]: r[3] for r in rows if len(r) == 4 and r[1] == 0}


def header(data) -> dict:
    """The fields of a file's header; raises with the reason if something needed is missing."""
    found = directories(data)
    if not found:
        raise ValueError("no directory")
    t = found[0]
    if TILE_WIDTH not in t:
        raise ValueError("no internal tiling")
    width, height = t[WIDTH][0], t[HEIGHT][0]
    if max(width, height) > 512 and len(found) < 2:
        raise ValueError("no overviews")
    if not all(t.get(x) for x in (SCALE, TIEPOINT, GEOKEYS)):
        raise ValueError("no pixel scale, tie point or geokeys")
    keys = geokeys(t[GEOKEYS])
    epsg = keys.get(3072) or keys.get(2048)
    citation = str(t.get(CITATION, "")).split("|")[0].strip() or None
    if not epsg:
        raise ValueError("no CRS")
    if epsg == 32767 and not citation:
        raise ValueError("user-defined CRS without citation")
    sx, sy, x, y = t[SCALE][0], t[SCALE][1], t[TIEPOINT][3], t[TIEPOINT][4]
    return {"proj_shape": [height, width], "band_count": t.get(SAMPLES, (1,))[0], "bits": list(t.get(BITS, (1,))), "ifd_count": len(found), "proj_epsg": epsg, "citation": citation, "gsd": sx, "proj_transform": [sx, 0.0, x, 0.0, -sy, y], "proj_bbox": [x, y - height * sy, x + width * sx, y], "band_names": band_names(str(t.get(METADATA, "")))}


SCHEMA = "path string, error string, proj_shape array<int>, band_count int, bits array<int>, ifd_count int, proj_epsg int, citation string, gsd double, proj_transform array<double>, proj_bbox array<double>, band_names array<string>"


def footprints(rows: DataFrame, crs: DataFrame | None = None) -> DataFrame:
    """rows, their corners as a ring of longitude and latitude, its envelope (xmin, ymin, xmax, ymax), and crs_error where the CRS is not known.

    A code is looked up by rule, then in crs (code, name, crs: see projections.crs_parameters); a user-defined one (32767) by its citation, which is the name.
    """
    rule, user = projections.of_epsg(F.col("proj_epsg")), F.col("proj_epsg") == 32767
    if crs is None:
        rows = rows.withColumn("_crs", rule)
    else:
        name = F.when(user, projections.plain_name(F.col("citation")))
        by_code, by_name = crs.select(F.col("code").alias("_code"), F.col("crs").alias("_by_code")), crs.groupBy(F.col("name").alias("_name")).agg(F.min("crs").alias("_by_name"))
        rows = rows.join(by_code, F.col("proj_epsg") == F.col("_code"), "left").join(by_name, name == F.col("_name"), "left").withColumn("_crs", F.coalesce(rule, "_by_code", "_by_name")).drop("_code", "_by_code", "_name", "_by_name")
    box = tuple(F.get("proj_bbox", F.lit(i)) for i in range(4))
    ring = F.when(F.col("_crs").isNotNull() & F.col("proj_bbox").isNotNull(), F.transform(geo.box_ring(box), lambda p: projections.to_lonlat(F.col("_crs"), p["x"], p["y"])))
    rows = rows.withColumn("ring", ring).withColumn("crs_error", F.when(F.col("proj_epsg").isNotNull() & F.col("_crs").isNull(), "CRS is not known")).drop("_crs")
    return rows.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), geo.envelope(F.col("ring")))))


def scan(spark: SparkSession, path: str, pattern: str = "*.tif", crs: DataFrame | None = None) -> DataFrame:
    """A row a file, with its footprint (see footprints); a file that can't be read has an error and no fields, and stops nothing.

    Tasks list the files and read them by ranges; the driver holds no file's name, unless the store is one that only Spark can open.
    """
    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    kinds = {"proj_shape": ints, "band_count": pa.int32(), "bits": ints, "ifd_count": pa.int32(), "proj_epsg": pa.int32(), "citation": pa.string(), "gsd": pa.float64(), "proj_transform": doubles, "proj_bbox": doubles, "band_names": pa.list_(pa.string())}

    try:
        if re.search(r"[*?{\[]", path) or "{" in pattern or not exists(spark, path):
            raise ValueError("Spark's patterns, or nothing there")
        store_of(path)
        found = listed(spark.createDataFrame([(path,)], "prefix string")).where(F.element_at(F.split("path", "/"), -1).rlike(f"^{fnmatch.translate(pattern)}"))
    except Exception:  # noqa: BLE001  or pyarrow has no such store
        found = listing(spark, path, pattern)

    def read(batches):
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as file:
                        rows.append(header(Ranges(file)) | {"error": None})
                except Exception as e:  # noqa: BLE001  any broken file is a row with its reason
                    rows.append({"error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "error": pa.array([r["error"] for r in rows], pa.string())} | {n: pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return footprints(found.select("path").repartition(parts, "path").mapInArrow(read, SCHEMA), crs)
