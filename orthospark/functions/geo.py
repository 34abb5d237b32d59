"""Geometry without a geometry type: affine maps, boxes, rings, projections and curves, as column expressions.

A ring is an array of (x, y) structs whose last point repeats the first.  A shape is an array of parts, each an array of rings: an outer one, then its
holes.  A box is four columns.  Angles of longitude
and latitude are degrees.  Projections are the closed forms of Snyder, "Map Projections: A Working Manual" (1987).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid GRS 80, Web Mercator's radius and latitude limit, and CONUS Albers (EPSG:6350).
A, INV_F = 6378137.0, 298.257222101
E2 = 2 / INV_F - 1 / INV_F**2
MAX_LATITUDE = 85.05112877980659
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# Boxes


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Whether boxes (west, south, east, north) meet; touching counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_area(b: tuple) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap_area(a: tuple, b: tuple) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def box_contains(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def padded(b: tuple, fraction: float = 0.18, least: float = 0.01) -> tuple:
    px, py = F.greatest(F.lit(least), (b[2] - b[0]) * fraction), F.greatest(F.lit(least), (b[3] - b[1]) * fraction)
    return F.greatest(F.lit(-180.0), b[0] - px), F.greatest(F.lit(-90.0), b[1] - py), F.least(F.lit(180.0), b[2] + px), F.least(F.lit(90.0), b[3] + py)


# Rings


def point(x, y) -> Column:
    return F.struct(lit(x).alias("x"), lit(y).alias("y"))


def box_ring(b: tuple) -> Column:
    """Lower left, lower right, upper right, upper left, lower left."""
    return F.array(point(b[0], b[1]), point(b[2], b[1]), point(b[2], b[3]), point(b[0], b[3]), point(b[0], b[1]))


def edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (cross == 0) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))


def edges_cover(found: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside the closed lines of these edges, by the even-odd rule, or on one of them."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    odd = F.aggregate(found, F.lit(False), lambda inside, e: inside != F.coalesce(crossed(e), F.lit(False)))
    return odd | F.exists(found, lambda e: on_edge(e, x, y))


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether the ring has the point inside or on its boundary."""
    return edges_cover(edges(ring), x, y)


def edge_meets_box(e: Column, b: tuple) -> Column:
    """Whether a segment meets a box: the box's corners lie on both sides of its line and the boxes meet."""
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    corners = [side(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    own = (F.least(e["x1"], e["x2"]), F.least(e["y1"], e["y2"]), F.greatest(e["x1"], e["x2"]), F.greatest(e["y1"], e["y2"]))
    return boxes_meet(own, b) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def ring_meets_box(ring: Column, b: tuple) -> Column:
    """Exact, and touching counts: an edge meets the box, or the box lies inside the ring."""
    return F.exists(edges(ring), lambda e: edge_meets_box(e, b)) | covers(ring, b[0], b[1])


# Shapes


def shape_edges(parts: Column) -> Column:
    return F.flatten(F.transform(F.flatten(parts), edges))


def shape_covers(parts: Column, x: Column, y: Column) -> Column:
    """Whether the shape has the point: inside a part and outside its holes, or on the boundary of any of them.  A shape without parts has none."""
    return edges_cover(shape_edges(parts), x, y)


def shape_meets_box(parts: Column, b: tuple) -> Column:
    """Exact, and touching counts: an edge of any ring meets the box, or the box lies inside a part; one inside a hole doesn't."""
    found = shape_edges(parts)
    return F.exists(found, lambda e: edge_meets_box(e, b)) | edges_cover(found, b[0], b[1])


def shape_envelope(parts: Column) -> tuple:
    return envelope(F.flatten(F.flatten(parts)))


def shape_geojson(parts: Column) -> Column:
    """A Polygon, or a MultiPolygon where there are not one but several parts, or none."""
    numbers = F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(numbers, F.lit(0)).alias("coordinates")))
    return F.when(F.size(parts) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), numbers.alias("coordinates"))))


def geojson_shape(text: Column) -> Column:
    """The parts of a Polygon or MultiPolygon; null for other geometries.  Heights are dropped."""
    ring = "array<array<double>>"
    kind = F.get_json_object(text, "$.type")
    points = lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: point(p[0], p[1])))
    one = F.from_json(text, f"coordinates array<{ring}>")["coordinates"]
    several = F.from_json(text, f"coordinates array<array<{ring}>>")["coordinates"]
    return F.when(kind == "Polygon", F.array(points(one))).when(kind == "MultiPolygon", F.transform(several, points))


def envelope(ring: Column) -> tuple:
    get = lambda f, name: f(F.transform(ring, lambda p: p[name]))
    return get(F.array_min, "x"), get(F.array_min, "y"), get(F.array_max, "x"), get(F.array_max, "y")


def ring_geometry(ring: Column) -> Column:
    """The structure that a polygon's GeoJSON is written from."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def ring_geojson(ring: Column) -> Column:
    return F.to_json(ring_geometry(ring))


def geojson_ring(text: Column) -> Column:
    parsed = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    return F.transform(parsed["coordinates"][0], lambda p: point(p[0], p[1]))


# Affine maps: arrays [a, b, c, d, e, f] with x = a*col + b*row + c, y = d*col + e*row + f


def affine(*values) -> Column:
    return F.array(*[lit(v) for v in values])


def rotation(degrees: float) -> Column:
    s, c = {0: (0.0, 1.0), 90: (1.0, 0.0), 180: (0.0, -1.0), 270: (-1.0, 0.0)}.get(degrees % 360, (math.sin(math.radians(degrees)), math.cos(math.radians(degrees))))
    return affine(c, -s, 0, s, c, 0)


def apply(m: Column, x, y) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def compose(m: Column, n: Column) -> Column:
    """m after n."""
    return affine(m[0] * n[0] + m[1] * n[3], m[0] * n[1] + m[1] * n[4], m[0] * n[2] + m[1] * n[5] + m[2], m[3] * n[0] + m[4] * n[3], m[3] * n[1] + m[4] * n[4], m[3] * n[2] + m[4] * n[5] + m[5])


def inverse(m: Column) -> Column:
    """Null where the determinant is 0."""
    det = m[0] * m[4] - m[1] * m[3]
    a, b, d, e = m[4] / det, -m[1] / det, -m[3] / det, m[0] / det
    return F.when(det != 0, affine(a, b, -(a * m[2] + b * m[5]), d, e, -(d * m[2] + e * m[5])))


def header_transform(scale_x: Column, scale_y: Column, tie_x: Column, tie_y: Column, pixel_is_point: Column, matrix: Column | None = None) -> Column:
    """Of a header's pixel scale and tie point, else of its 4 x 4 matrix, else null; shifted by half a pixel where pixels are points."""
    own = F.when(scale_x.isNotNull() & tie_x.isNotNull(), affine(scale_x, 0, tie_x, 0, -scale_y, tie_y))
    if matrix is not None:
        own = F.coalesce(own, F.array(*[matrix[i] for i in (0, 1, 3, 4, 5, 7)]))
    return F.when(own.isNull(), None).when(pixel_is_point == 1, compose(own, affine(1, 0, -0.5, 0, 1, -0.5))).otherwise(own)


# Projections


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator of longitude and clamped latitude."""
    clamped = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    return F.radians(lon) * A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))


def _q(phi, sin, log) -> float | Column:
    e, s = math.sqrt(E2), sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - (1 / (2 * e)) * log((1 - e * s) / (1 + e * s)))


def _albers() -> tuple[float, float, float]:
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    q = lambda p: _q(p, math.sin, math.log)
    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return n, c, A * math.sqrt(c - n * q(p0)) / n


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    n, c, rho0 = _albers()
    rho = F.sqrt(F.lit(c) - n * _q(F.radians(lat), F.sin, F.log)) * (A / n)
    theta = F.radians(lon - ALBERS["lon0"]) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def from_albers(x: Column, y: Column) -> tuple[Column, Column]:
    n, c, rho0 = _albers()
    rho = F.sqrt(x * x + (F.lit(rho0) - y) ** 2)
    theta = F.atan2(x, F.lit(rho0) - y)
    q = (F.lit(c) - (rho * n / A) ** 2) / n
    beta = F.asin(q / _q(math.pi / 2, math.sin, math.log))
    s2, s4, s6 = E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360
    return F.degrees(theta / n) + ALBERS["lon0"], F.degrees(beta + s2 * F.sin(2 * beta) + s4 * F.sin(4 * beta) + s6 * F.sin(6 * beta))


_K0 = 0.9996
_EP2 = E2 / (1 - E2)


def _meridian(phi: Column) -> Column:
    return A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a northern zone."""
    phi = F.radians(lat)
    n, t, c = A / F.sqrt(1 - E2 * F.sin(phi) ** 2), F.tan(phi) ** 2, _EP2 * F.cos(phi) ** 2
    a = F.radians(lon - (zone * 6 - 183)) * F.cos(phi)
    x = _K0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * _EP2) * a**5 / 120)
    y = _K0 * (_meridian(phi) + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * _EP2) * a**6 / 720))
    return x + 500000.0, y


def from_utm(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    mu = y / _K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s = 1 - E2 * F.sin(phi) ** 2
    n, r, t, c = A / F.sqrt(s), A * (1 - E2) / s**1.5, F.tan(phi) ** 2, _EP2 * F.cos(phi) ** 2
    d = (x - 500000.0) / (n * _K0)
    lat = phi - (n * F.tan(phi) / r) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * _EP2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * _EP2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * _EP2 + 24 * t**2) * d**5 / 120) / F.cos(phi)
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def tile_box(z: Column, x: Column, y: Column) -> tuple:
    """Longitude and latitude box of a Web Mercator tile."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda row: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - row * 2 / n))))
    return x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y)


def ground_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points, by the radii of curvature at their middle."""
    phi = F.radians((lat1 + lat2) / 2)
    w = 1 - E2 * F.sin(phi) ** 2
    return F.hypot(F.radians(lat2 - lat1) * A * (1 - E2) / w**1.5, F.radians(lon2 - lon1) * A / F.sqrt(w) * F.cos(phi))


def ground_resolution(lat: Column, zoom: Column) -> Column:
    """Metres of a pixel of a 256-pixel tile."""
    return F.lit(40075016.686) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom + 8)


def meters_per_unit(unit: Column) -> Column:
    """Null for a unit that isn't known."""
    u = F.lower(unit)
    return F.when(u.isin("m", "metre", "meter", "meters"), 1.0).when(u == "foot", 0.3048).when(u == "us survey foot", 1200 / 3937).when(u == "degree", 2 * math.pi * A / 360)


def hilbert(x: Column, y: Column, bounds: tuple, bits: int = 16) -> Column:
    """Index on a Hilbert curve of 2 ** bits cells a side; only its order means something."""
    top = float((1 << bits) - 1)
    cell = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * top).cast("double")))
    start = F.struct(F.coalesce(cell(x, bounds[0], bounds[2]), F.lit(0.0)).cast("long").alias("x"), F.coalesce(cell(y, bounds[1], bounds[3]), F.lit(0.0)).cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        rx, ry = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long"), F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        flipped = (ry == 0) & (rx == 1)
        fx, fy = F.when(flipped, side - 1 - s["x"].bitwiseAND(side - 1)).otherwise(s["x"].bitwiseAND(side - 1)), F.when(flipped, side - 1 - s["y"].bitwiseAND(side - 1)).otherwise(s["y"].bitwiseAND(side - 1))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (s["d"] + side * side * ((rx * 3).bitwiseXOR(ry))).alias("d"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step)["d"]
