"""Map projections by their parameters, so that one expression serves rows of different coordinate reference systems.

A CRS is a struct column: kind (longlat, mercator, tmerc, lcc, albers), lat0, lon0, lat1, lat2 (degrees), k0, x0, y0 (in the CRS's units), unit (metres
a unit), a and inv_f (the ellipsoid; inv_f 0 is a sphere).  It comes from an EPSG code by rule (UTM zones, Web Mercator, longitude and latitude,
CONUS Albers) or from the text of a CRS table (state planes and others).  Formulas: Snyder, "Map Projections: A Working Manual" (1987).
Datum shifts are not applied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("lat0", "lon0", "lat1", "lat2", "k0", "x0", "y0", "unit", "a", "inv_f")
TYPE = "struct<kind:string," + ",".join(f"{n}:double" for n in FIELDS) + ">"
# Ellipsoids, names of projections in well-known text, and EPSG codes by rule.
GRS80, WGS84, CLARKE1866 = (6378137.0, 298.257222101), (6378137.0, 298.257223563), (6378206.4, 294.978698214)
_NAMES = {
    "transverse_mercator": "tmerc", "gauss_kruger": "tmerc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic": "lcc",
    "albers_conic_equal_area": "albers", "albers": "albers", "mercator_auxiliary_sphere": "mercator", "popular_visualisation_pseudo_mercator": "mercator",
}
#: (first code of zone 1, last zone, ellipsoid, false northing) of families of UTM zones.
_UTM = [(26901, 23, GRS80, 0.0), (6330, 19, GRS80, 0.0), (32601, 60, WGS84, 0.0), (32701, 60, WGS84, 1e7)]


def crs(kind, lat0=0.0, lon0=0.0, lat1=0.0, lat2=0.0, k0=1.0, x0=0.0, y0=0.0, unit=1.0, a=GRS80[0], inv_f=GRS80[1]) -> Column:
    own = dict(zip(FIELDS, (lat0, lon0, lat1, lat2, k0, x0, y0, unit, a, inv_f)))
    column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), *[column(v).cast("double").alias(n) for n, v in own.items()])


def of_epsg(code: Column) -> Column:
    """The CRS of codes that follow a rule; null for others."""
    out = F.lit(None).cast(TYPE)
    for first, zones, (a, inv_f), north in _UTM:
        zone = code - first + 1
        out = F.when((zone >= 1) & (zone <= zones), crs("tmerc", lon0=zone * 6 - 183, k0=0.9996, x0=500000.0, y0=north, a=a, inv_f=inv_f)).otherwise(out)
    out = F.when(code.isin(4326, 4269, 6318, 4258), crs("longlat")).otherwise(out)
    out = F.when(code.isin(3857, 900913, 102100), crs("mercator", inv_f=0.0)).otherwise(out)
    return F.when(code.isin(5070, 6350, 102039), crs("albers", 23.0, -96.0, 29.5, 45.5)).otherwise(out)


def of_wkt(wkt: Column) -> Column:
    """The CRS that a well-known text (version 1) describes; null where its projection is none of these."""
    number = r"([-+0-9.eE]+)"
    get = lambda pattern: F.nullif(F.regexp_extract(wkt, pattern, 1), F.lit("")).try_cast("double")
    parameter = lambda *names: F.coalesce(*[get(rf'(?i)PARAMETER\s*\[\s*"{n}"\s*,\s*{number}') for n in names])
    name = F.lower(F.regexp_extract(wkt, r'(?i)PROJECTION\s*\[\s*"([^"]+)"', 1))
    kind = F.when(wkt.rlike(r"(?i)^\s*GEOGCS"), "longlat").when(wkt.rlike(r'(?i)PROJCS\s*\[\s*"[^"]*Pseudo-?_?\s?Mercator'), "mercator")
    for text, own in _NAMES.items():
        kind = kind.when(name == text, own)
    lat0 = F.coalesce(parameter("latitude_of_origin", "latitude_of_center"), F.lit(0.0))
    lat1 = F.coalesce(parameter("standard_parallel_1"), lat0)
    # The last unit is the projected one; false easting and northing are in it.
    unit = F.when(kind == "longlat", 1.0).otherwise(F.coalesce(get(rf'(?is)^.*\bUNIT\s*\[\s*"[^"]*"\s*,\s*{number}'), F.lit(1.0)))
    lon0, zero = F.coalesce(parameter("central_meridian", "longitude_of_center", "longitude_of_origin"), F.lit(0.0)), F.lit(0.0)
    own = crs(
        kind, lat0, lon0, lat1, F.coalesce(parameter("standard_parallel_2"), lat1), F.coalesce(parameter("scale_factor"), F.lit(1.0)), F.coalesce(parameter("false_easting"), zero), F.coalesce(parameter("false_northing"), zero), unit,
        F.coalesce(get(rf'(?i)SPHEROID\s*\[\s*"[^"]*"\s*,\s*{number}'), F.lit(GRS80[0])), F.when(kind == "mercator", 0.0).otherwise(F.coalesce(get(rf'(?i)SPHEROID\s*\[\s*"[^"]*"\s*,\s*[-+0-9.eE]+\s*,\s*{number}'), F.lit(GRS80[1]))),
    )
    return F.when(kind.isNotNull(), own)


def _let(values: dict[str, Column], body) -> Column:
    """body(names) with each value computed once."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(n) for n, v in values.items()])), body)[0]


def _steps(first: dict[str, Column], *rest):
    """Names bound in order: each function of what is bound returns more names; the last one returns the result."""

    def bind(known: Column | None, names: list[str], values: dict[str, Column], left) -> Column:
        values = {**({n: known[n] for n in names} if known is not None else {}), **values}
        return _let(values, lambda s: left[0](s) if len(left) == 1 else bind(s, list(values), left[0](s), left[1:]))

    return bind(None, [], first, rest)


def _base(p: Column) -> dict[str, Column]:
    f = F.when(p["inv_f"] == 0, 0.0).otherwise(F.lit(1.0) / p["inv_f"])
    return {"e2": f * 2 - f * f, "a": p["a"], "k0": p["k0"], "lat0": F.radians(p["lat0"]), "lon0": F.radians(p["lon0"]), "lat1": F.radians(p["lat1"]), "lat2": F.radians(p["lat2"])}


def _meridian(s, phi: Column) -> Column:
    e2, e4, e6 = s["e2"], s["e2"] ** 2, s["e2"] ** 3
    return s["a"] * ((F.lit(1.0) - e2 / 4 - e4 * 3 / 64 - e6 * 5 / 256) * phi - (e2 * 3 / 8 + e4 * 3 / 32 + e6 * 45 / 1024) * F.sin(phi * 2) + (e4 * 15 / 256 + e6 * 45 / 1024) * F.sin(phi * 4) - (e6 * 35 / 3072) * F.sin(phi * 6))


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _tmerc(s) -> dict[str, Column]:
    sin2 = F.sin(s["phi"]) ** 2
    ep2 = s["e2"] / (F.lit(1.0) - s["e2"])
    return {"n": s["a"] / F.sqrt(F.lit(1.0) - s["e2"] * sin2), "t": F.tan(s["phi"]) ** 2, "c": ep2 * F.cos(s["phi"]) ** 2, "ep2": ep2, "d": (s["lam"] - s["lon0"]) * F.cos(s["phi"])}


def _tmerc_xy(s) -> Column:
    t, c, a, ep2, one = s["t"], s["c"], s["d"], s["ep2"], F.lit(1.0)
    x = s["k0"] * s["n"] * (a + (one - t + c) * a**3 / 6 + (F.lit(5.0) - t * 18 + t**2 + c * 72 - ep2 * 58) * a**5 / 120)
    y = _meridian(s, s["phi"]) - _meridian(s, s["lat0"]) + s["n"] * F.tan(s["phi"]) * (a**2 / 2 + (F.lit(5.0) - t + c * 9 + c**2 * 4) * a**4 / 24 + (F.lit(61.0) - t * 58 + t**2 + c * 600 - ep2 * 330) * a**6 / 720)
    return _pair(x, s["k0"] * y)


def _tmerc_foot(s) -> dict[str, Column]:
    e2, one = s["e2"], F.lit(1.0)
    mu = (_meridian(s, s["lat0"]) + s["y"] / s["k0"]) / (s["a"] * (one - e2 / 4 - e2**2 * 3 / 64 - e2**3 * 5 / 256))
    e1 = (one - F.sqrt(one - e2)) / (one + F.sqrt(one - e2))
    return {"phi": mu + (e1 * 3 / 2 - e1**3 * 27 / 32) * F.sin(mu * 2) + (e1**2 * 21 / 16 - e1**4 * 55 / 32) * F.sin(mu * 4) + (e1**3 * 151 / 96) * F.sin(mu * 6) + (e1**4 * 1097 / 512) * F.sin(mu * 8)}


def _tmerc_back(s) -> dict[str, Column]:
    w, ep2 = F.lit(1.0) - s["e2"] * F.sin(s["phi"]) ** 2, s["e2"] / (F.lit(1.0) - s["e2"])
    n = s["a"] / F.sqrt(w)
    return {"n": n, "r": s["a"] * (F.lit(1.0) - s["e2"]) / w**1.5, "t": F.tan(s["phi"]) ** 2, "c": ep2 * F.cos(s["phi"]) ** 2, "ep2": ep2, "d": s["x"] / (n * s["k0"])}


def _tmerc_lonlat(s) -> Column:
    t, c, d, ep2, phi, one = s["t"], s["c"], s["d"], s["ep2"], s["phi"], F.lit(1.0)
    lat = phi - (s["n"] * F.tan(phi) / s["r"]) * (d**2 / 2 - (F.lit(5.0) + t * 3 + c * 10 - c**2 * 4 - ep2 * 9) * d**4 / 24 + (F.lit(61.0) + t * 90 + c * 298 + t**2 * 45 - ep2 * 252 - c**2 * 3) * d**6 / 720)
    lon = s["lon0"] + (d - (one + t * 2 + c) * d**3 / 6 + (F.lit(5.0) - c * 2 + t * 28 - c**2 * 3 + ep2 * 8 + t**2 * 24) * d**5 / 120) / F.cos(phi)
    return _pair(F.degrees(lon), F.degrees(lat))


def _conic(s) -> dict[str, Column]:
    """Of both conics: m and, for the conformal one, t of the standard parallels and the origin; for Albers, q."""
    e, one = F.sqrt(s["e2"]), F.lit(1.0)
    m = lambda phi: F.cos(phi) / F.sqrt(one - s["e2"] * F.sin(phi) ** 2)
    out = {"e": e, "m1": m(s["lat1"]), "m2": m(s["lat2"])}
    for k in ("lat0", "lat1", "lat2"):
        es = e * F.sin(s[k])
        out |= {f"t_{k}": F.tan(F.lit(math.pi / 4) - s[k] / 2) / F.pow((one - es) / (one + es), e / 2), f"q_{k}": _q(s["e2"], e, F.sin(s[k]))}
    return out


def _q(e2: Column, e: Column, sin: Column) -> Column:
    one = F.lit(1.0)
    return F.when(e == 0, sin * 2).otherwise((one - e2) * (sin / (one - e2 * sin**2) - F.log((one - e * sin) / (one + e * sin)) / F.nullif(e * 2, F.lit(0.0))))


def _lcc(s) -> dict[str, Column]:
    n = F.when(s["lat1"] == s["lat2"], F.sin(s["lat1"])).otherwise(F.log(s["m1"] / s["m2"]) / F.nullif(F.log(s["t_lat1"] / s["t_lat2"]), F.lit(0.0)))
    f = s["m1"] / (n * F.pow(s["t_lat1"], n))
    return {"n": n, "f": f, "rho0": s["a"] * f * F.pow(s["t_lat0"], n) * s["k0"]}


def _lcc_xy(s) -> Column:
    es = s["e"] * F.sin(s["phi"])
    t = F.tan(F.lit(math.pi / 4) - s["phi"] / 2) / F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), s["e"] / 2)
    rho, theta = s["a"] * s["f"] * F.pow(t, s["n"]) * s["k0"], s["n"] * (s["lam"] - s["lon0"])
    return _pair(rho * F.sin(theta), s["rho0"] - rho * F.cos(theta))


def _polar(s) -> dict[str, Column]:
    sign, dy = F.when(s["n"] < 0, -1.0).otherwise(1.0), s["rho0"] - s["y"]
    return {"rho": sign * F.sqrt(s["x"] ** 2 + dy**2), "theta": F.atan2(sign * s["x"], sign * dy)}


def _lcc_lonlat(s) -> Column:
    chi = F.lit(math.pi / 2) - F.atan(F.pow(s["rho"] / (s["a"] * s["f"] * s["k0"]), F.lit(1.0) / s["n"])) * 2
    e2, e4, e6, e8 = (s["e2"] ** k for k in range(1, 5))
    lat = chi + (e2 / 2 + e4 * 5 / 24 + e6 / 12 + e8 * 13 / 360) * F.sin(chi * 2) + (e4 * 7 / 48 + e6 * 29 / 240 + e8 * 811 / 11520) * F.sin(chi * 4) + (e6 * 7 / 120 + e8 * 81 / 1120) * F.sin(chi * 6) + (e8 * 4279 / 161280) * F.sin(chi * 8)
    return _pair(F.degrees(s["theta"] / s["n"] + s["lon0"]), F.degrees(lat))


def _albers(s) -> dict[str, Column]:
    n = F.when(s["lat1"] == s["lat2"], F.sin(s["lat1"])).otherwise((s["m1"] ** 2 - s["m2"] ** 2) / F.nullif(s["q_lat2"] - s["q_lat1"], F.lit(0.0)))
    c = s["m1"] ** 2 + n * s["q_lat1"]
    return {"n": n, "c": c, "rho0": s["a"] * F.sqrt(c - n * s["q_lat0"]) / n}


def _albers_xy(s) -> Column:
    rho, theta = s["a"] * F.sqrt(s["c"] - s["n"] * _q(s["e2"], s["e"], F.sin(s["phi"]))) / s["n"], s["n"] * (s["lam"] - s["lon0"])
    return _pair(rho * F.sin(theta), s["rho0"] - rho * F.cos(theta))


def _albers_lonlat(s) -> Column:
    q = (s["c"] - (s["rho"] * s["n"] / s["a"]) ** 2) / s["n"]
    beta = F.asin(q / _q(s["e2"], s["e"], F.lit(1.0)))
    e2, e4, e6 = s["e2"], s["e2"] ** 2, s["e2"] ** 3
    lat = beta + (e2 / 3 + e4 * 31 / 180 + e6 * 517 / 5040) * F.sin(beta * 2) + (e4 * 23 / 360 + e6 * 251 / 3780) * F.sin(beta * 4) + (e6 * 761 / 45360) * F.sin(beta * 6)
    return _pair(F.degrees(s["theta"] / s["n"] + s["lon0"]), F.degrees(lat))


def to_lonlat(p: Column, x: Column, y: Column) -> Column:
    """(x, y) as longitude and latitude, of a place in the CRS p; null for a null CRS."""
    start = _base(p) | {"x": (x - p["x0"]) * p["unit"], "y": (y - p["y0"]) * p["unit"]}
    tmerc = _steps(start, _tmerc_foot, _tmerc_back, _tmerc_lonlat)
    lcc, albers = _steps(start, _conic, _lcc, _polar, _lcc_lonlat), _steps(start, _conic, _albers, _polar, _albers_lonlat)
    mercator = _pair(p["lon0"] + F.degrees((x - p["x0"]) * p["unit"] / p["a"]), F.degrees(F.atan(F.sinh((y - p["y0"]) * p["unit"] / p["a"]))))
    return F.when(p["kind"] == "tmerc", tmerc).when(p["kind"] == "lcc", lcc).when(p["kind"] == "albers", albers).when(p["kind"] == "mercator", mercator).when(p["kind"] == "longlat", _pair(x, y))


def from_lonlat(p: Column, lon: Column, lat: Column) -> Column:
    """(x, y) in the CRS p, of longitude and latitude; null for a null CRS."""
    start = _base(p) | {"phi": F.radians(lat), "lam": F.radians(lon)}
    found = F.when(p["kind"] == "tmerc", _steps(start, _tmerc, _tmerc_xy)).when(p["kind"] == "lcc", _steps(start, _conic, _lcc, _lcc_xy)).when(p["kind"] == "albers", _steps(start, _conic, _albers, _albers_xy))
    found = found.when(p["kind"] == "mercator", _pair(F.radians(lon - p["lon0"]) * p["a"], F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * p["a"]))
    return F.when(p["kind"] == "longlat", _pair(lon, lat)).otherwise(F.transform(F.array(found), lambda q: _pair(q["x"] / p["unit"] + p["x0"], q["y"] / p["unit"] + p["y0"]))[0])


def crs_parameters(table: DataFrame) -> DataFrame:
    """(code, name, crs) of a CRS table (code, wkt): entries whose projection is known; the name is lower case, its words one space apart."""
    rows = table.select("code", plain_name(F.regexp_extract("wkt", r'^\s*\w+\s*\[\s*"([^"]*)"', 1)).alias("name"), of_wkt(F.col("wkt")).alias("crs"))
    return rows.where("crs is not null").groupBy("code").agg(F.min(F.struct("name", "crs")).alias("one")).select("code", "one.*")


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
