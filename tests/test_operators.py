"""Literal cases: keys, rings, curves, ranges, lakes and headers."""

import random

import pytest
from pyspark.sql import functions as F

from orthospark.functions import geo
from orthospark.functions import keys as K
from orthospark.functions import pixels as P
from orthospark.operators import catalog, rasters, spatial, tiles
from orthospark.sources import files, lake


def values(df):
    return [r[0] for r in df.collect()]


def test_key_layouts(spark):
    cases = {
        "imagery/orthos/Phase3/KY_KYAPED_2024_Season1_3IN/N011E284_2024_Season1_3IN_cog.tif": ("kyfromabove", "ky", 2024, {"season": "1", "kyaped:tile": "N011E284", "kyaped:resolution": "3IN", "phase": "Phase3"}),
        "imagery/orthos/Phase3/KY_KYAPED_2022_Season2_6IN/N1_2022_6IN_cog.tif": ("kyfromabove", "ky", 2022, {"season": "2", "kyaped:tile": "N1", "kyaped:resolution": "6IN", "phase": "Phase3"}),
        "2020/cog/A15B12.tif": ("nj-imagery", "nj", 2020, {"njgin:tile": "A15B12"}),
        "hi/2021/60cm/rgbir_cog/19155/57/m_1.tif": ("naip", "hi", 2021, {"resolution_dir": "60cm", "product_family": "rgbir_cog", "spatial_prefix": "19155"}),
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, "2020/MG3/A15B12.zip", "manifest.txt", "nj/notayear/30cm/rgbir_cog/39075/x.tif", "imagery/Metadata/x_2020_6IN_cog.tif"]], "key string")
    for id, layout in K.LAYOUTS.items():
        got = {r.key: (r.collection, r.region, r.year, r.properties) for r in layout.parsed(rows).collect()}
        assert got == {k: v for k, v in cases.items() if v[0] == id}
    with pytest.raises(ValueError):
        K.adhoc_layout("x", "s3://naip-manifest/a", "", "nj", 2020, "public")
    assert K.adhoc_layout("x", "naip-source", "a", "nj", 2020, "public").access == "requester-pays"


def test_ring_predicates(spark):
    ring = F.array(*[geo.point(x, y) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))])
    at = lambda x, y: geo.covers(ring, F.lit(float(x)), F.lit(float(y)))
    box = lambda *b: geo.ring_meets_box(ring, tuple(F.lit(float(v)) for v in b))
    row = spark.range(1).select(at(1, 1), at(2, 1), at(2, 2), at(4, 4), at(5, 0), box(1.5, 3, 2.5, 3.5), box(-1, -1, 0, 0), box(1, 0.2, 1.1, 0.3), box(-9, -9, 9, 9), box(4.1, 0, 5, 4)).first()
    assert list(row) == [True, True, False, True, False, False, True, True, True, False]


def test_shapes_with_holes_and_parts(spark):
    """Holes, an island in a hole, rings that touch in a point and along an edge; none, null."""
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    parts = [[ring(0, 0, 10), ring(2, 2, 6)], [ring(4, 4, 2)], [ring(10, 10, 3)], [ring(2, 3, 1)]]
    rows = [(1, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    places = {(1, 1): True, (3, 7): False, (5, 5): True, (4, 4): True, (2, 7): True, (7, 7.5): False, (10, 10): True, (12, 12): True, (11, 9): False, (2.5, 3.5): True, (8, 8): True, (3, 3.5): True, (-1, 0): False, (10.5, 13): True}
    got = df.select("id", *[geo.shape_covers(F.col("parts"), F.lit(float(x)), F.lit(float(y))) for x, y in places]).orderBy("id").collect()
    assert list(got[0])[1:] == list(places.values()) and not any(list(got[1])[1:]) and set(list(got[2])[1:]) == {None}
    boxes = {(6.5, 6.5, 7.5, 7.5): False, (6.5, 6.5, 8, 7): True, (3.5, 3.5, 6.5, 6.5): True, (-5, -5, 20, 20): True, (0.5, 0.5, 1, 1): True, (13, 13, 14, 14): True, (11, 5, 12, 9): False, (6, 6, 7, 7): True, (-2, -2, -1, -1): False}
    got = df.where("id < 3").select("id", *[geo.shape_meets_box(F.col("parts"), tuple(F.lit(float(v)) for v in b)) for b in boxes]).orderBy("id").collect()
    assert list(got[0])[1:] == list(boxes.values()) and not any(list(got[1])[1:])
    assert list(df.where("id = 1").select(*geo.shape_envelope(F.col("parts"))).first()) == [0.0, 0.0, 13.0, 13.0]


def test_wkb_of_shapes(spark):
    """Either byte order, heights, measures, SRIDs, several parts; reasons for what is no polygon."""
    import struct

    from orthospark.functions import wkb

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    plain = [[[{"x": x, "y": y} for x, y in ring]]]

    def polygon(order="<", code=3, width=2, srid=None):
        head = struct.pack(f"{order}BI", order == "<", code) + (struct.pack(f"{order}I", srid) if srid else b"")
        return head + struct.pack(f"{order}II", 1, 4) + b"".join(struct.pack(f"{order}{width}d", *p, *[9.0] * (width - 2)) for p in ring)

    good = [polygon(), polygon(">"), polygon("<", 1003, 3), polygon(">", 2003, 3), polygon("<", 3003, 4), polygon("<", 3 | 0x80000000, 3), polygon("<", 3 | 0x20000000, 2, 4326), polygon("<", 3 | 0xE0000000, 4, 4326)]
    assert all(wkb.decoded(x) == (plain, None) for x in good)
    several = struct.pack(">BII", 0, 6, 2) + polygon() + polygon(">")
    assert wkb.decoded(several) == (plain * 2, None) and wkb.decoded(wkb.encoded(plain * 2)) == (plain * 2, None)
    assert wkb.decoded(wkb.encoded([])) == ([], None) and wkb.decoded(struct.pack("<BII", 1, 3, 0)) == ([], None) and wkb.decoded(None) == (None, None)
    for raw, why in ((polygon()[:-1], "cut off"), (b"", "cut off"), (b"\x02" + polygon()[1:], "byte order"), (struct.pack("<BI2d", 1, 1, 0, 0), "type 1"), (struct.pack("<BII", 1, 6, 1) + struct.pack("<BI2d", 1, 1, 0, 0), "part of type 1")):
        parts, reason = wkb.decoded(raw)
        assert parts is None and why in reason
    df = spark.createDataFrame([(1, bytearray(several)), (2, bytearray(b"x")), (3, None)], "id int, g binary")
    assert [(r.id, r.parts and len(r.parts), r.reason) for r in wkb.shape_from_wkb(df, "g").orderBy("id").collect()] == [(1, 2, None), (2, None, "no byte order"), (3, None, None)]
    with pytest.raises(Exception, match="not a polygon of one ring"):
        wkb.from_wkb(df, "g").collect()


def test_hilbert_steps_are_adjacent(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"))
    h = geo.hilbert(F.col("x"), F.col("y"), tuple(F.lit(float(v)) for v in (0, 0, n - 1, n - 1)), bits=4)
    rows = sorted((r.h, r.x, r.y) for r in cells.select("x", "y", h.alias("h")).collect())
    assert [r[0] for r in rows] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_projections_round_trip(spark):
    pts = spark.createDataFrame([(-120.0, 35.0), (-75.5, 44.9), (-96.0, 23.0), (-81.0, 30.5)], "lon double, lat double")
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    for there, back in ((lambda a, b: geo.albers(a, b), geo.from_albers), (lambda a, b: geo.utm(a, b, zone), lambda x, y: geo.from_utm(x, y, zone)), (lambda a, b: geo.mercator(a, b), geo.from_mercator)):
        x, y = there(F.col("lon"), F.col("lat"))
        lon, lat = back(x, y)
        for r in pts.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert abs(r.lon - r.a) < 1e-6 and abs(r.lat - r.b) < 1e-6
    # Snyder's worked example of the ellipsoidal Albers on another ellipsoid differs below a part in 10,000.
    x, y = geo.albers(F.lit(-75.0), F.lit(35.0))
    r = spark.range(1).select(x, y).first()
    assert abs(r[0] - 1885472.7) < 60 and abs(r[1] - 1535925.0) < 60


def merged(ranges, gap, most):
    out = []
    for off, n in sorted(r for r in ranges if r[0] > 0 and r[1] > 0):
        if out and off - out[-1][1] <= gap and max(out[-1][1], off + n) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], off + n)
        else:
            out.append([off, off + n])
    return [(a, b - a) for a, b in out]


def test_coalesced_ranges(spark):
    random.seed(1)
    ranges = [(f, random.randrange(0, 400), random.randrange(0, 60)) for f in range(20) for _ in range(random.randrange(0, 12))]
    got = tiles.coalesced_ranges(spark.createDataFrame(ranges, "file_id long, off long, len long"), 20, 100).collect()
    for f in range(20):
        assert sorted((r.group_off, r.group_len) for r in got if r.file_id == f) == merged([r[1:] for r in ranges if r[0] == f], 20, 100)


def test_assigned_ranges(spark):
    """Every range lies in its group at its start; ranges that are null, sparse, repeated or larger than a group; a file of a million."""
    rng = random.Random(6)
    rows = [(f, rng.randrange(0, 400), rng.randrange(0, 60)) for f in "abcdefgh" for _ in range(40)] + [("a", 5, 500), ("a", 5, 500), (None, 1, 1), ("a", None, 3), ("z", 0, 9), ("z", 9, 0)]
    got = tiles.assigned_ranges(spark.createDataFrame(rows, "file_id string, off int, len int"), 20, 100).collect()
    kept = [x for x in rows if x[0] and x[1] and x[2]]
    assert sorted((r.file_id, r.off, r.len) for r in got) == sorted(kept)
    for f in "abcdefgh":
        groups = dict(merged([x[1:] for x in kept if x[0] == f], 20, 100))
        for r in got:
            if r.file_id == f:
                assert r.start == r.off - r.group_off and r.start + r.len <= groups[r.group_off]
    many = spark.range(1_000_000).select(F.lit("big").alias("file_id"), (F.col("id") * 1000 + 1).alias("off"), F.lit(900).alias("len"))
    r = tiles.coalesced_ranges(many, 200, 50_000).agg(F.count("*"), F.sum("n"), F.max("group_len")).first()
    assert list(r) == [20_000, 1_000_000, 49_900]


def test_range_join_has_each_pair_once(spark):
    random.seed(2)
    box = lambda: (lambda x, y: (x, y, x + random.choice([0, 1, 7]), y + random.choice([0, 2])))(random.randrange(30), random.randrange(30))
    a, b = [(i, *map(float, box())) for i in range(80)], [(i, *map(float, box())) for i in range(60)]
    left = spark.createDataFrame(a, "id long, xmin double, ymin double, xmax double, ymax double")
    right = spark.createDataFrame(b, "idx long, west double, south double, east double, north double")
    got = sorted((r.id, r.idx) for r in spatial.range_join(left, right, 3.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])


def test_nearest_items_in_a_crowd(spark):
    """Crowded cells are cut into blocks whatever the sides' columns are called."""
    grid = [(i, float(i % 20), float(i // 20)) for i in range(400)]
    requests = spark.range(20_000).select(F.col("id").alias("rid"), (F.col("id") % 19 + 0.25).alias("rx"), (F.col("id") % 17 + 0.25).alias("ry"))
    got = spatial.nearest(requests, spark.createDataFrame(grid, "id long, x double, y double"), 1, 30.0).collect()
    assert sorted((r.rid, r.id) for r in got) == [(i, i % 17 * 20 + i % 19) for i in range(20_000)]
    names = ("_n", "_m", "_l", "_x", "_y", "_level", "_i", "_j")
    left = spark.range(200).select("id", *[F.lit(float(k // 4)).alias(n) for k, n in enumerate(names)])
    right = spark.range(100).select(F.col("id").alias("idx"), *[F.lit(0.5).alias(n) for n in spatial.WINDOW])
    assert spatial.range_join(left, right, 1.0, names[:2] + names[4:6], block=16, share=1).count() == 20_000


def test_large_sides_are_not_broadcast(spark):
    """Whatever Spark takes a side's size for: its cells and rings are not in the estimate."""
    place = lambda n: spark.range(n).select("id", *[(F.col("id") % 100).cast("double").alias(x) for x in ("xmin", "xmax")], *[F.expr("cast(id div 100 as double)").alias(x) for x in ("ymin", "ymax")])
    right = place(6000).withColumnsRenamed(dict(zip(("id", *spatial.BOX), ("idx", *spatial.WINDOW))))
    pairs = spatial.range_join(place(10_000), right, 1.0)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 6000


def test_range_join_of_a_city_and_the_world(spark):
    """Boxes from a metre to the world, crowded in a city: each pair once, also where blocks, samples and levels differ; no task with most of the rows."""
    random.seed(5)

    def box(k):
        x, y = (random.gauss(2.35, 0.01), random.gauss(48.85, 0.01)) if k % 10 else (random.uniform(-180, 170), random.uniform(-90, 80))
        w = random.choice([1e-5, 1e-5, 1e-4, 1e-3, 0.1, 5.0])
        return x, y, x + w, y + w * random.choice([0, 1])

    a, b = [(i, *box(i)) for i in range(3000)], [(i, *box(i)) for i in range(300)]
    a += [(5000, -180.0, -90.0, 180.0, 90.0), (5001, float("nan"), 0.0, 1.0, 1.0), (5002, None, 0.0, 1.0, 1.0), (5003, 0.0, 0.0, float("inf"), 1.0), (5004, 3.0, 50.0, 1.0, 40.0)]
    b += [(500, -180.0, -90.0, 180.0, 90.0), (501, -180.0, -90.0, 180.0, 90.0), (502, 2.3, 48.8, 2.4, 48.9), (503, 2.35, None, 2.4, 48.9)]
    left = spark.createDataFrame(a, "id long, xmin double, ymin double, xmax double, ymax double")
    right = spark.createDataFrame(b, "idx long, west double, south double, east double, north double")
    plain = [x for x in a if None not in x and x[0] not in (5001, 5003)], [x for x in b if None not in x]
    want = sorted((p[0], q[0]) for p in plain[0] for q in plain[1] if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    for size, block, share in ((1e-5, 64, 1), (1e-4, 500, 4), (1.0, 64, 1), (1000.0, 1 << 20, 16)):
        got = spatial.range_join(left, right, size, block=block, share=share)
        assert sorted((r.id, r.idx) for r in got.collect()) == want, size
    assert spatial.range_join(left.limit(0), right, 1.0).count() == spatial.range_join(left, right.limit(0), 1.0).count() == 0

    # A cell of 20,000 and 3000 boxes: its rows are dealt evenly.
    city = spark.range(20_000).select("id", *[(F.lit(2.35) + F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1e6).alias(n) for n in spatial.BOX])
    views = spark.range(3000).select(F.col("id").alias("idx"), *[(F.lit(2.35) + F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1e6).alias(n) for n in spatial.WINDOW])
    one = lambda df, box: spatial.to_cells(df, box, 100.0, F.array(F.lit(0)))
    x, y = one(city, spatial.BOX), one(views, spatial.WINDOW)
    p, q, keys = spatial.dealt(x, y, spatial.crowded_cells(x, y, 1, 512))
    sizes = [sorted(r[1] for r in side.repartition(16, *keys).groupBy(F.spark_partition_id()).count().collect()) for side in (p, q)]
    for s in sizes:
        assert len(s) == 16 and s[-1] < 3 * s[len(s) // 2]


def test_clipped_ring(spark):
    square = F.array(*[geo.point(x, y) for x, y in ((-1, -1), (3, -1), (3, 3), (-1, 3))])
    far = F.array(*[geo.point(x, y) for x, y in ((8, 8), (9, 8), (9, 9))])
    unit = tuple(F.lit(float(v)) for v in (0, 0, 2, 2))
    a, b = spark.range(1).select(tiles.clipped_ring(square, unit), tiles.clipped_ring(far, unit)).first()
    assert {(p.x, p.y) for p in a} == {(0, 0), (2, 0), (2, 2), (0, 2)} and b == []


def test_resample_and_pixels(spark):
    grid = F.array(*[F.lit(float(v)) for v in (0, 1, -9999, 3)])
    assert spark.range(1).select(rasters.resampled(grid, 2, 2, 3, 3, -9999.0)).first()[0] == pytest.approx([4 / 3, 4 / 3, 1, 4 / 3, 4 / 3, 2, 3, 3, 3])
    row = spark.range(1).select(P.bits_unpacked(F.lit(0b10100001)), P.alpha([F.lit(1)] * 3, [F.lit(9)] * 3), P.alpha([F.lit(250)] * 3, [F.lit(250), F.lit(245), F.lit(241)])).first()
    assert list(row[0]) == [255, 0, 255, 0, 0, 0, 0, 255] and row[1] == 0 and row[2] == 0


def test_lake_replaces_only_its_partitions(spark):
    rows = [(f"k{i}", r, y, float(i)) for i, (r, y) in enumerate([("nj", 2018), ("nj", 2022), ("ri", 2021), ("de", 2017)] * 3)]
    df = spark.createDataFrame(rows, "source_key string, region string, year int, xmin double").withColumns({"ymin": F.lit(0.0), "xmax": F.col("xmin") + 1, "ymax": F.lit(1.0), "collection": F.lit("naip")})
    path = files.scratch(spark, "lake")
    assert lake.write(df, path) == 12
    assert lake.write(df.where("region = 'ri'").limit(1), path) == 1
    assert lake.write(df.limit(0), path) == 0
    count = lambda *a: lake.scan(spark, path, *a).count()
    assert [count("naip"), count("naip", "nj"), count("naip", "nj", 2022), count("naip", "ri"), count("naip", "zz"), count("naip", None, 2017)] == [10, 6, 3, 1, 0, 3]
    assert {tuple(r) for r in files.partition_values(files.listing(spark, path, "*.parquet")).collect()} == {("nj", 2018), ("nj", 2022), ("ri", 2021), ("de", 2017)}


def test_strict_completeness(spark):
    listing = spark.createDataFrame([("nj", 2020)] * 3, "region string, year int")
    report = catalog.completeness(listing, listing.limit(2))
    r = report.first()
    assert (r.listed, r.ingested, r.dropped, r.incomplete) == (3, 2, 1, True)
    with pytest.raises(ValueError):
        catalog.require_complete(report)
    catalog.require_complete(catalog.completeness(listing, listing))


def test_entry_imports_without_the_text_operators():
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *a, **b):
        if name == "corpus_pipeline" or name.startswith("orthospark.llm") or (name == "orthospark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **b)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("orthospark.llm")}
    builtins.__import__ = blocked
    try:
        entry = importlib.import_module("__spark_entry__")
        assert "search_pipeline" in entry.queries() and "pipeline" not in entry.queries()
        assert set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        builtins.__import__ = real
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(kept)


def test_lake_keeps_rows_without_region(spark, tmp_path):
    from orthospark.sources import lake

    row = {f.name: None for f in lake.SCHEMA}
    rows = [row | {"source_key": k, "collection": "naip", "region": r, "year": y, "xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0} for k, r, y in (("a", "nj", 2000), ("b", None, 2000), ("c", "nj", None), ("d", None, None))]
    df = spark.createDataFrame([tuple(r[f.name] for f in lake.SCHEMA) for r in rows], lake.SCHEMA)
    assert lake.write(df, str(tmp_path / "lake")) == 4 and lake.write(df.limit(0), str(tmp_path / "none")) == 0
    found = spark.read.schema(lake.SCHEMA).parquet(str(tmp_path / "lake")).collect()
    assert sorted((r.source_key, r.region, r.year) for r in found) == [("a", "nj", 2000), ("b", None, 2000), ("c", "nj", None), ("d", None, None)]


def test_headers_beyond_the_first_fetch_and_cycles():
    from orthospark.plans.lake_queries import tiff
    from orthospark.sources import headers

    class File:
        def __init__(self, data):
            self.data, self.reads = data, []

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.reads.append((at, n))
            return self.data[at : at + n]

    near, far, cyclic = File(tiff(2)), File(tiff(101) + bytes(1 << 20)), File(tiff(50))
    assert headers.header(headers.Ranges(near))["proj_epsg"] == 26912 and len(near.reads) == 1
    found = headers.header(headers.Ranges(far))
    assert found["proj_epsg"] == 26911 and found["band_names"] == ["Red"] and sum(n for _, n in far.reads) < headers.PREFIX + 1000
    for data, reason in ((cyclic.data, "cycle"), (b"II*\0\x08\0\0\0", "cut off"), (b"", "not a TIFF"), (tiff(9), "no CRS")):
        with pytest.raises(ValueError, match=reason):
            headers.header(data)


def test_headers_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's own index of the files, which the driver holds, is not asked; the names' pattern holds, and what is missing fails as before."""
    from orthospark.plans.lake_queries import tiff
    from orthospark.sources import headers

    for n, name in ((2, "a/x.tif"), (3, "a/y.tif"), (4, "a/y.tiff"), (5, "b/_z.tif"), (9, "b/w.tif")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(tiff(n))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        headers.scan(spark, f"{tmp_path}/none").count()
    globbed = headers.scan(spark, f"{tmp_path}/*/").select("error").collect()
    monkeypatch.setattr(headers, "listing", None)
    for path in (f"{tmp_path}", f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = sorted((r.path.rpartition("/")[2], r.proj_epsg, r.error) for r in headers.scan(spark, path).collect())
        assert got == [("w.tif", None, "no CRS"), ("x.tif", 26912, None), ("y.tif", 26913, None)]
    assert len(globbed) == 3 and headers.scan(spark, str(tmp_path), "[xy].tif*").count() == 3


def test_listing_by_tasks(spark, tmp_path):
    """Folders, a file, the beginning of names, overlaps, hidden names, nothing; rounds of one folder a task give the same."""
    names = ["a/1/x.tif", "a/1/y.txt", "a/2/z.tif", "a/2/deep/er/w.tif", "b/v.tif", "b/_hidden/u.tif", "b/.t.tif", "ab.tif"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    below = lambda prefixes, **k: sorted((r.path.split(f"{tmp_path}/")[1], r.length) for r in files.listed(spark.createDataFrame([(f"file://{tmp_path}/{p}",) for p in prefixes], "prefix string"), ".tif", **k).collect())
    whole = [(n, len(n)) for n in sorted(names) if n.endswith(".tif") and "/_" not in n and "/." not in n]
    assert below([""]) == below([""], most=1) == below(["a", "b/", "ab.tif"]) == below(["", "a/1"]) == whole
    assert below(["a/2"]) == [x for x in whole if x[0].startswith("a/2")] and below(["a/1/x.tif"]) == [("a/1/x.tif", 9)] and below(["b/v"]) == [("b/v.tif", 7)]
    assert below(["none", "none/at/all", "b/v/"]) == [] and files.listed(spark.createDataFrame([], "prefix string")).count() == 0


def test_listing_hands_on_files_as_it_goes(spark, tmp_path, monkeypatch):
    """A task stops at a number of files and holds few of them; prefixes apart are not compared, others give a file once.  Objects take no blocks of disk."""
    from orthospark.plans.lake_queries import objects
    from orthospark.plans.registry import Views

    spark.range(500).selectExpr("id as o_orderkey", "timestamp'1995-03-04' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    path = objects(Views(spark, str(tmp_path))).removeprefix("file://")
    written = [p for p in __import__("pathlib").Path(path).rglob("*.tif")]
    assert len(written) == 550 and all(p.stat().st_blocks == 0 for p in written)
    monkeypatch.setattr(files, "MOST_FILES", 7)
    monkeypatch.setattr(files, "ROWS", 3)
    found = lambda names: files.listed(spark.createDataFrame([(f"file://{path}/{n}",) for n in names], "prefix string"), ".tif")
    for names, apart in ((("nj/", "ri/", "de/", "ca/", "ky/", "wa/", "tx/", "hi/"), True), (("nj", "nj/1995/", "ri", "de", "ca", "ky", "wa", "tx", "hi"), False)):
        rows = found(names)
        assert sorted(r.path.split(path)[1] for r in rows.collect()) == sorted(str(p).split(path)[1] for p in written)
        assert ("Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()) == apart


def test_replacement_survives_failures(spark, tmp_path):
    """A merge that is killed while it overwrites, after partitions are gone, loses no row when it is run again; what is done is not done twice."""
    import shutil

    schema = "source_key string, state string, year int, filename string"
    path, staging = str(tmp_path / "index"), str(tmp_path / "staging")
    old = spark.createDataFrame([(f"k{i}", "nj" if i % 2 else "ri", 2020, "old") for i in range(20)], schema)
    assert lake.staged_merge(old, path, "source_key", f"{staging}/0", "s-0") == 20
    new = spark.createDataFrame([("k1", "nj", 2020, "new"), ("k100", "nj", 2020, "new"), ("k100", "nj", 2020, "newest"), ("k0", "de", 2021, "new")], schema)
    put = lake.put_keys

    def killed(rows, where):
        shutil.rmtree(f"{where}/state=nj")  # Spark removes old partitions before it moves the new ones in
        raise RuntimeError("killed")

    lake.put_keys = killed
    try:
        with pytest.raises(RuntimeError):
            lake.staged_merge(new, path, "source_key", f"{staging}/1", "s-1")
    finally:
        lake.put_keys = put
    assert spark.read.schema(schema).parquet(path).count() == 10
    assert lake.staged_merge(new, path, "source_key", f"{staging}/1", "s-1") == 12
    rows = {(r.source_key, r.state): r.filename for r in spark.read.schema(schema).parquet(path).collect()}
    assert len(rows) == 22 and rows["k1", "nj"] == "new" and rows["k100", "nj"] == "newest" and rows["k3", "nj"] == "old" and rows["k0", "ri"] == "old"
    assert lake.staged_merge(old, path, "source_key", f"{staging}/1", "s-1") == 0 and not (tmp_path / "staging" / "1").exists()
    assert spark.read.schema(schema).parquet(path).count() == 22
    # A staging table that was not finished is written anew.
    (tmp_path / "staging" / "2").mkdir(parents=True)
    (tmp_path / "staging" / "2" / "part-0.parquet").write_bytes(b"half")
    assert lake.staged_merge(new.where("state = 'de'"), path, "source_key", f"{staging}/2", "s-2") == 1


def test_row_groups_are_read_one_by_one(spark, tmp_path):
    """Two far boxes: rows of the groups that they meet, and no others; more groups than allowed are refused."""
    from orthospark.sources import parquet_index

    path = str(tmp_path / "tiles")
    rows = spark.range(0, 10_000, 1, 4).select("id", *[(F.col("id") / 10.0 + d).alias(n) for n, d in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 0.05), ("ymax", 0.05))], F.lit("x" * 20).alias("other"))
    rows.write.option("parquet.block.row.count.limit", 100).parquet(path)
    index = parquet_index.scan_footers(spark, path).cache()
    assert index.count() == 100 and index.agg(F.sum("num_rows")).first()[0] == 10_000
    boxes = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0), (900.0, 900.0, 915.0, 915.0), (5.0, 500.0, 6.0, 501.0)], "west double, south double, east double, north double")
    found = parquet_index.read(spark, index, boxes, ["id", "xmin"], 10.0)
    ids = sorted(r.id for r in found.collect())
    hit = sorted((r.file, r.row_group) for r in parquet_index.hits(index, boxes, 10.0).collect())
    assert found.columns == ["id", "xmin"] and len(hit) == 3 and ids == [*range(100), *range(9000, 9200)]
    world = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0)], "west double, south double, east double, north double")
    assert len(parquet_index.read(spark, index, world, ["id"], 10.0, most=100).collect()) == 10_000
    with pytest.raises(ValueError, match="more than 96"):
        parquet_index.read(spark, index, world, ["id"], 10.0)
    assert parquet_index.read(spark, index, boxes.limit(0), ["id"], 10.0).count() == 0


def test_row_groups_without_a_limit(spark, tmp_path):
    """More row groups than the default allows, and boxes that repeat: all rows, each once."""
    from orthospark.sources import parquet_index

    path = str(tmp_path / "tiles")
    spark.range(0, 2000, 1, 1).select("id", *[(F.col("id") / 10.0).alias(n) for n in spatial.BOX]).write.option("parquet.block.row.count.limit", 10).parquet(path)
    boxes = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0)] * 3, "west double, south double, east double, north double")
    index = parquet_index.scan_footers(spark, path)
    assert index.count() > parquet_index.MOST_GROUPS
    assert sorted(r.id for r in parquet_index.read(spark, index, boxes, ["id"], 10.0, most=None).collect()) == [*range(2000)]


def test_counts_and_shares_of_row_groups(spark, sf_dir):
    """total_row_groups_hit, row_group_locality and index_freshness against the footers, read one after another."""
    import pyarrow.parquet as pq

    from orthospark.plans import QUERIES, lake_queries
    from orthospark.plans.registry import Views

    v = Views(spark, sf_dir)
    path, boxes = lake_queries.building_files(v), [tuple(r) for r in v.boxes.select("west", "south", "east", "north").collect()]
    before = lake_queries.building_files
    lake_queries.building_files = lambda _: path
    try:
        hit, shares = QUERIES["total_row_groups_hit"](spark, sf_dir).first(), {r.order: r.pct for r in QUERIES["row_group_locality"](spark, sf_dir).collect()}
    finally:
        lake_queries.building_files = before
    from pathlib import Path

    groups = []
    for file in Path(path.removeprefix("file://")).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        leaves = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stat = lambda n: meta.row_group(g).column(leaves[n]).statistics  # noqa: E731, B023
            groups.append((file.name, meta.row_group(g).num_rows, stat("xmin").min, stat("ymin").min, stat("xmax").max, stat("ymax").max))
    met = [x for x in groups if any(x[2] <= b[2] and x[4] >= b[0] and x[3] <= b[3] and x[5] >= b[1] for b in boxes)]
    assert (hit.row_groups, hit.files, hit.most_rows) == (len(met), len({x[0] for x in met}), sum(x[1] for x in met))
    whole = (max(x[4] for x in groups) - min(x[2] for x in groups)) * (max(x[5] for x in groups) - min(x[3] for x in groups))
    assert shares["hilbert"] == pytest.approx(sum((x[4] - x[2]) * (x[5] - x[3]) for x in groups) / len(groups) / whole * 100, abs=2e-3)
    assert shares["random"] > 3 * shares["hilbert"] if len(groups) > 20 else shares["random"] > 0
    assert QUERIES["index_freshness"](spark, sf_dir).first().stale is False  # files of today, orders of the last century
    from orthospark.sources.lake import is_stale

    times = spark.createDataFrame([("2020-01-01", "2020-01-02"), ("2020-01-02", "2020-01-02"), (None, "2020-01-02"), ("2020-01-02", None)], "a string, b string")
    assert [r[0] for r in times.select(is_stale(F.to_timestamp("a"), F.to_timestamp("b"))).collect()] == [True, False, True, True]


def test_projections_by_parameters(spark):
    """Snyder's worked examples on Clarke's ellipsoid, in metres; round trips of every kind, also in feet and south of the equator."""
    from orthospark.functions import projections as P

    clarke = {"a": P.CLARKE1866[0], "inv_f": P.CLARKE1866[1]}
    examples = [
        (P.crs("lcc", 23, -96, 33, 45, **clarke), -75.0, 35.0, 1894410.9, 1564649.5), (P.crs("albers", 23, -96, 29.5, 45.5, **clarke), -75.0, 35.0, 1885472.7, 1535925.0),
        (P.crs("tmerc", 0, -75, k0=0.9996, **clarke), -73.5, 40.5, 127106.5, 4484124.4),
    ]
    for own, lon, lat, x, y in examples:
        r = spark.range(1).select(P.from_lonlat(own, F.lit(lon), F.lit(lat)).alias("p")).first().p
        assert abs(r.x - x) < 0.06 and abs(r.y - y) < 0.06
    kinds = [
        P.crs("tmerc", 38.83, -74.5, k0=0.9999, x0=492125.0, unit=1200 / 3937), P.crs("lcc", 36.67, -119, 38.43, 37.07, x0=2e6, y0=5e5), P.crs("lcc", -30, 25, -28, -32), P.crs("lcc", 40, -100, 40, 40, k0=0.9998, unit=0.3048),
        P.crs("albers", 23, -96, 29.5, 45.5), P.crs("albers", -23, 135, -18, -36), P.crs("mercator", inv_f=0), P.crs("longlat"), P.of_epsg(F.lit(32633)), P.of_epsg(F.lit(32733)), P.crs("albers", 23, -96, 30, 30, inv_f=0),
    ]
    near = [(-74.2, 40.1), (-121.0, 37.2), (26.0, -29.0), (-99.0, 41.0), (-80.0, 36.0), (140.0, -30.0), (11.0, 47.0), (11.0, 47.0), (14.5, 50.0), (16.0, -20.0), (-90.0, 40.0)]
    for own, (lon, lat) in zip(kinds, near):
        r = spark.range(1).select(P.from_lonlat(own, F.lit(lon), F.lit(lat)).alias("p")).select(P.to_lonlat(own, F.col("p.x"), F.col("p.y")).alias("q")).first().q
        assert abs(r.x - lon) < 2e-8 and abs(r.y - lat) < 2e-8  # two millimetres
    assert spark.range(1).select(P.to_lonlat(F.lit(None).cast(P.TYPE), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_crs_from_text(spark):
    from orthospark.functions import projections as P

    geog = 'GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    nj = f'PROJCS["NAD83 / New Jersey (ftUS)",{geog},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",38.83333333333334],PARAMETER["central_meridian",-74.5],PARAMETER["scale_factor",0.9999],PARAMETER["false_easting",492125],PARAMETER["false_northing",0],UNIT["US survey foot",0.3048006096012192],AXIS["X",EAST],AUTHORITY["EPSG","3424"]]'
    ky = f'PROJCS["NAD83 / Kentucky Single Zone (ftUS)",{geog},PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",37.08333333333334],PARAMETER["standard_parallel_2",38.66666666666666],PARAMETER["latitude_of_origin",36.33333333333334],PARAMETER["central_meridian",-85.75],PARAMETER["false_easting",4921250],PARAMETER["false_northing",3280833.333],UNIT["US survey foot",0.3048006096012192]]'
    odd = f'PROJCS["x",{geog},PROJECTION["Hotine_Oblique_Mercator"],UNIT["metre",1]]'
    table = spark.createDataFrame([(3424, nj), (3089, ky), (4269, geog), (1, odd), (3424, nj)], "code int, wkt string")
    found = P.crs_parameters(table)
    got = {r.code: r for r in found.collect()}
    assert set(got) == {3424, 3089, 4269} and got[3424].name == "nad83 new jersey ftus"
    own = got[3424].crs
    assert (own.kind, own.lon0, own.k0, own.x0, own.a) == ("tmerc", -74.5, 0.9999, 492125.0, 6378137.0) and abs(own.unit - 0.3048006) < 1e-6 and got[3089].crs.lat2 == 38.66666666666666 and got[4269].crs.kind == "longlat"
    from orthospark.sources import headers

    rows = spark.createDataFrame(
        [("a", 3424, None, [492125.0, 0.0, 492126.0, 1.0]), ("b", 32767, "NAD83 / Kentucky Single Zone (ftUS)", [4921250.0, 3280833.333, 4921251.0, 3280834.0]), ("c", 26918, None, [500000.0, 4500000.0, 500001.0, 4500001.0]), ("d", 9999, None, [0.0, 0.0, 1.0, 1.0]), ("e", None, None, None)],
        "path string, proj_epsg int, citation string, proj_bbox array<double>",
    )
    got = {r.path: r for r in headers.footprints(rows, found).collect()}
    assert (round(got["a"].xmin, 6), round(got["a"].ymin, 6)) == (-74.5, 38.833333) and (round(got["b"].xmin, 6), round(got["b"].ymin, 6)) == (-85.75, 36.333333)
    assert abs(got["c"].xmin + 75) < 1e-9 and 40.6 < got["c"].ymin < 40.7 and len(got["c"].ring) == 5 and got["c"].ring[0] == got["c"].ring[4]
    assert got["d"].ring is None and got["d"].crs_error == "CRS is not known" and got["e"].ring is None and got["e"].crs_error is None
    assert headers.footprints(rows).where("ring is not null").count() == 1


def test_headers_of_other_files():
    """Big-endian, 64-bit offsets, strips, rationals, cut off, too many directories."""
    import struct

    from orthospark.sources import headers

    def file(order="<", big=False, tiles=True, rational=False, chain=1):
        count, entry, offset = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
        width = 8 if big else 4
        start = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8))
        doubles = struct.pack(f"{order}9d", 0.5, 0.5, 0.0, 0, 0, 0, 5e5, 4e6, 0)
        keys = struct.pack(f"{order}8H", 1, 1, 0, 1, 3072, 0, 1, 26915)
        tags = [(256, 3, 1, struct.pack(f"{order}H", 300)), (257, 4, 1, struct.pack(f"{order}I", 200))] + [(282, 5, 1, None)] * rational + [(322, 3, 1, struct.pack(f"{order}H", 256))] * tiles + [(33550, 12, 3, 0), (33922, 12, 6, 24), (34735, 3, 8, 72)]
        size = struct.calcsize(f"{order}{count}") + len(tags) * (struct.calcsize(f"{order}{entry}") + width) + width
        after = len(start) + size * chain
        out = start
        for k in range(chain):
            rows = b""
            for tag, kind, n, value in tags:
                raw = struct.pack(f"{order}{offset}", after + value) if isinstance(value, int) else (value or struct.pack(f"{order}{offset}", after)).ljust(width, b"\0")
                rows += struct.pack(f"{order}{entry}", tag, kind, n) + raw
            out += struct.pack(f"{order}{count}", len(tags)) + rows + struct.pack(f"{order}{offset}", len(start) + size * (k + 1) if k + 1 < chain else 0)
        return out + doubles + keys

    for order in "<>":
        for big in (False, True):
            found = headers.header(file(order, big, rational=True, chain=2))
            assert (found["proj_shape"], found["proj_epsg"], found["ifd_count"], found["proj_bbox"]) == ([200, 300], 26915, 2, [5e5, 4e6 - 100, 5e5 + 150, 4e6])
            for data, reason in ((file(order, big, tiles=False), "no internal tiling"), (file(order, big)[: 60 if big else 40], "cut off"), (file(order, big)[:7], "not a TIFF")):
                with pytest.raises(ValueError, match=reason):
                    headers.header(data)
    with pytest.raises(ValueError, match="more than 3 directories"):
        headers.directories(file(chain=4), most=3)
    assert len(headers.directories(file(chain=4))) == 4


def test_nearest_of_many_requests(spark):
    """The k nearest of every request, ties by id, dense and empty places, fewer items than k, requests far outside, nulls."""
    rng = random.Random(8)
    items = [(i, round(rng.gauss(5, 0.3), 2), round(rng.gauss(5, 0.3), 2)) for i in range(600)] + [(1000 + i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(60)] + [(5000, None, 1.0), (5001, float("nan"), 1.0)]
    asks = [(i, rng.uniform(4, 6), rng.uniform(4, 6)) for i in range(40)] + [(100 + i, rng.uniform(-500, 1500), rng.uniform(0, 1000)) for i in range(20)] + [(300, None, 2.0)]
    a = spark.createDataFrame(asks, "rid long, rx double, ry double")
    b = spark.createDataFrame(items, "id long, x double, y double")
    real = [x for x in items if x[0] < 5000]
    for k, few in ((4, real), (10, real[:7])):
        want = {}
        for rid, x, y in asks[:-1]:
            best = sorted(((p[1] - x) * (p[1] - x) + (p[2] - y) * (p[2] - y), p[0]) for p in few)[:k]
            want |= {(rid, n + 1): i for n, (_, i) in enumerate(best)}
        own = b if few is real else b.where(F.col("id").isin([x[0] for x in few]))
        got = spatial.nearest(a, own, k, 0.5).collect()
        assert {(r.rid, r["rank"]): r.id for r in got} == want and len(got) == len(want)
    assert spatial.nearest(a, b.limit(0), 3, 1.0).count() == spatial.nearest(a.limit(0), b, 3, 1.0).count() == 0


def test_pipelines_given_as_data(spark):
    from orthospark.functions import render

    df = spark.createDataFrame([(0.5, 0.25, 0.0, 0.5, 0.0, 1.0), (0.5, 0.25, 1.0, None, 0.0, 0.5), (0.0, 0.0, 0.0, 0.9, 0.0, 1.0), (None, 1.0, 1.0, 0.9, 0.0, 1.0)], "r double, g double, b double, nodata double, lo double, hi double")
    run = lambda pipeline, *names: [[*r.c, r.a] for r in (lambda c, a: df.select(F.array(*c).alias("c"), a.alias("a")))(*render.compiled(pipeline, [F.col(n) for n in names])).collect()]
    assert run([{"module": "mask", "props": {"nodata": F.col("nodata")}}], "r", "g") == [[None, 0.25, 0.0], [0.5, 0.25, 255.0], [0.0, 0.0, 255.0], [None, 1.0, 0.0]]
    assert run([{"module": "composite", "props": {"order": [2, None, 0]}}], "r", "g", "b")[1] == [1.0, 1.0, 0.5, 255.0]
    assert run([{"module": "rescale", "props": {"lo": F.col("lo"), "hi": F.col("hi")}}], "r", "b")[:2] == [[0.5, 0.0, 255.0], [1.0, 1.0, 255.0]]
    assert run([{"module": "colormap", "props": {"table": [[0, 0, 0], [0.1, 0.2, 0.3], [1, 1, 1]], "size": 3}}], "r")[:2] == [[0.1, 0.2, 0.3, 255.0]] * 2
    assert run([{"module": "gray", "props": {"white_is_zero": True}}], "g")[0] == [0.75, 0.75, 0.75, 255.0]
    assert [r[3] for r in run([{"module": "quantize"}, {"module": "collar"}], "r", "g", "b")] == [255.0, 255.0, 0.0, 0.0]
    assert run([{"module": "validity", "props": {"flag": F.col("b")}}], "g") == [[None, 0.0], [0.25, 255.0], [None, 0.0], [1.0, 255.0]]
    for bad in ({"module": "shade"}, {"module": "mask"}, {"module": "quantize", "props": {"x": 1}}, {"module": "quantize", "prop": {}}):
        with pytest.raises(ValueError):
            render.compiled([bad], [F.col("r")])


def test_mosaic_takes_the_first_that_is_opaque(spark):
    """A coarse and a fine source, holes, a clipped box, another CRS, a pixel of no source."""
    from orthospark.functions import projections as P

    fields = "source string, rank int, sx double, sy double, sw double, sh double, columns int, rows int, west double, south double, east double, north double, data array<double>"
    fine = ("fine", 1, 0.0, 4.0, 1.0, 1.0, 4, 4, 0.0, 0.0, 3.0, 4.0, [float(i) if i % 5 else None for i in range(16)])  # its last column may not be shown
    coarse = ("coarse", 2, 0.0, 4.0, 2.0, 2.0, 2, 2, 0.0, 0.0, 4.0, 4.0, [100.0, 101.0, 102.0, None])
    sources = spark.createDataFrame([coarse, fine], fields).withColumn("crs", P.crs("longlat"))
    targets = spark.createDataFrame([(7, 0.0, 4.0, 1.0, 1.0)], "target int, tx double, ty double, tw double, th double")
    for block in (4, 8, 64):
        got = {(r.row, r.col): (r.value, r.source) for r in rasters.mosaic(targets, sources, 5, 4, P.crs("longlat"), 1.0, block=block).collect()}
        want = {}
        for r in range(4):
            for c in range(5):
                i = r * 4 + c
                over = coarse[12][(r // 2) * 2 + c // 2] if c < 4 else None
                if c < 3 and i % 5:
                    want[r, c] = (float(i), "fine")
                elif over is not None:
                    want[r, c] = (over, "coarse")
        assert got == want
    # The same source in UTM: its pixels come out where the projection puts them.
    utm = P.of_epsg(F.lit(32631))
    places = spark.createDataFrame([(3.0, 45.0)], "lon double, lat double").select(P.from_lonlat(utm, F.col("lon"), F.col("lat")).alias("p")).first().p
    own = spark.createDataFrame([("u", 1, places.x, places.y, 10.0, 10.0, 2, 2, -180.0, -90.0, 180.0, 90.0, [1.0, 2.0, 3.0, 4.0])], fields).withColumn("crs", utm).withColumns({"west": F.lit(2.99), "south": F.lit(44.99), "east": F.lit(3.01), "north": F.lit(45.01)})
    got = rasters.mosaic(spark.createDataFrame([(1, 3.0, 45.0, 0.000127, 0.00009)], "target int, tx double, ty double, tw double, th double"), own, 2, 2, P.crs("longlat"), 0.001).collect()
    assert {(r.row, r.col): r.value for r in got} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}


def test_mosaic_of_a_crowd_of_sources(spark):
    """So many sources over a place that its cell is cut into blocks."""
    from orthospark.functions import projections as P

    sources = spark.range(12_000).select(
        F.col("id").alias("source"), F.col("id").alias("rank"), *[F.lit(x).alias(n) for n, x in zip(("sx", "sy", "sw", "sh", "west", "south", "east", "north"), (0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0))],
        F.lit(1).alias("columns"), F.lit(1).alias("rows"), F.array(F.when(F.col("id") >= 5, F.col("id").cast("double"))).alias("data"), P.crs("longlat").alias("crs"),
    )
    targets = spark.createDataFrame([(7, 0.0, 1.0, 0.5, 0.5)], "target int, tx double, ty double, tw double, th double")
    got = rasters.mosaic(targets, sources, 2, 2, P.crs("longlat"), 1.0).collect()
    assert sorted((r.row, r.col, r.value, r.source) for r in got) == [(r, c, 5.0, 5) for r in (0, 1) for c in (0, 1)]


def test_ranks_by_distance(spark):
    """One request with most of the items, ties by id, a request without a name, none."""
    rng = random.Random(10)
    rows = [(None if i % 50 == 0 else "big" if i % 10 else "small", i, float(rng.randrange(20)), float(rng.randrange(20))) for i in range(2000)]
    df = spark.createDataFrame(rows, "req string, id long, x double, y double").repartition(7)
    got = tiles.sorted_by_distance(df, "req", F.col("x"), F.col("y"), F.lit(3.0), F.lit(4.0), "id").collect()
    for name in ("big", "small", None):
        own = sorted(((x - 3) ** 2 + (y - 4) ** 2, i) for r, i, x, y in rows if r == name)
        assert sorted((r["rank"], r.id, r.distance2) for r in got if r.req == name) == [(k + 1, i, d) for k, (d, i) in enumerate(own)]
    assert tiles.sorted_by_distance(df.limit(0), "req", F.col("x"), F.col("y"), F.lit(3.0), F.lit(4.0), "id").count() == 0


def test_meshes_beyond_the_projection(spark, tmp_path):
    """Tiles far north on the grid's plane go through Albers and back, too."""
    from orthospark.plans import QUERIES

    parts = [0, 9_999, 10_000, 19_456, 29_999, 119_999, 7_199_999]
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.fid, r.i, r.j, r.x, r.y) for r in QUERIES["reproject_grid"](spark, str(tmp_path)).collect())
    assert got == [(p, i, j, p % 50 * 10000.0 + 2500.0 * i, p // 50 * 10000.0 + 10000.0 - 2500.0 * j) for p in parts for i in range(5) for j in range(5)]


@pytest.mark.parametrize("name, sides", [("multi_scale_range_join", (300, 3)), ("points_in_shapes", (None, 3)), ("shapes_meeting_boxes", (1000, 3)), ("sort_by_distance_from_point", (8000, 3)), ("tile_to_sources_join", (8000, 3))])
def test_what_repeats_is_joined_once(spark, tmp_path, monkeypatch, name, sides):
    """Four views of each place, two buildings and footprints of each: the join gets one of them, the result has all."""
    import duckdb

    from orthospark.plans import ORACLES, QUERIES

    views = [(a + 456 * j,) for a in (1, 2, 3) for j in range(4)]
    twice = lambda n, period, step: [(i * step + period * j,) for i in range(n) for j in (0, 1)]
    spark.createDataFrame(views, "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(twice(300, 4_560_000, 7), "event_id long").selectExpr("event_id", "'view' as event_type", "1D as value", "event_id as user_id", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(twice(4000, 45_600, 1), "o_orderkey long").withColumn("o_orderdate", F.lit("1995-03-04").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    seen, joined = [], spatial.range_join
    monkeypatch.setattr(spatial, "range_join", lambda a, b, *rest, **named: (seen.append((a.count(), b.count())), joined(a, b, *rest, **named))[1])
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("supplier", "events", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall()) and len(rows) > 3
    assert [(sides[0] and a, b) for a, b in seen] == [sides]
