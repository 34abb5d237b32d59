"""Pixel arithmetic on columns.  Values are doubles; null is no data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo=0.0, hi=1.0) -> Column:
    """Null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def masked(v: Column, nodata: float, bits: int | None = None) -> Column:
    """Null where the value is nodata; bits: values were scaled to 0..1 from so many bits."""
    return F.nullif(v, F.lit(float(nodata) / (2**bits - 1) if bits else float(nodata)))


def rescaled(v: Column, lo: float, hi: float) -> Column:
    return clamp((v - lo) / (hi - lo))


def to_display(v: Column, lo, hi) -> Column:
    """Raw values of a display domain as 0..255."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return half_up(clamp((v - lo) / F.greatest(hi - lo, F.lit(1.0))) * 255)


def adjusted(s: Column, brightness: float, contrast: float) -> Column:
    return half_up(clamp((s / 255 - 0.5) * contrast + 0.5 + brightness) * 255)


def alpha(raw: list[Column], out: list[Column]) -> Column:
    """0 for a black (before adjustment) or white (after it) collar, else 255."""
    black = F.greatest(*raw) <= 2
    white = (F.least(*out) >= 240) & (F.greatest(*out) - F.least(*out) <= 12)
    return F.when(black | white, 0).otherwise(255)


def bits_unpacked(byte: Column) -> Column:
    """The eight mask values (0 or 255) of a byte, most significant bit first."""
    return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", byte.cast("int"), i).bitwiseAND(F.lit(1)) * 255)


def gray(v: Column, white_is_zero: bool = False) -> list[Column]:
    return [(F.lit(1.0) - v if white_is_zero else v)] * 3


# Coefficients of the JFIF conversion, the D65 white point and the sRGB matrix.
YCBCR = ((0.0, 1.402), (-0.34414, -0.71414), (1.772, 0.0))
D65 = (0.95047, 1.0, 1.08883)
SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(F.lit(1.0) - v) * (F.lit(1.0) - k) for v in (c, m, y)]


def ycbcr(y: Column, cb: Column, cr: Column) -> list[Column]:
    return [y + (cb - 0.5) * b + (cr - 0.5) * r for b, r in YCBCR]


def cielab(lightness: Column, a: Column, b: Column) -> list[Column]:
    """From texture values of 0..1; black and negative light are 0 before the gamma curve."""
    y = (lightness * 255.0 + 16.0) / 116.0
    x, z = (a - 0.5) * 255.0 / 500.0 + y, y - (b - 0.5) * 255.0 / 200.0
    linear = lambda v: F.when(F.pow(v, F.lit(3.0)) >= 0.008856, F.pow(v, F.lit(3.0))).otherwise((v - 16.0 / 116.0) / 7.787)
    xyz = [linear(v) * w for v, w in zip((x, y, z), D65)]
    rgb = [sum((xyz[i] * row[i] for i in range(1, 3)), xyz[0] * row[0]) for row in SRGB]
    return [clamp(F.when(v >= 0.0031308, F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(v * 12.92)) for v in rgb]


# Stops of the elevation ramp, as integers and as shader colours.
STOPS = [(0.0, (60, 120, 60)), (0.4, (120, 150, 80)), (0.7, (170, 140, 100)), (0.9, (190, 175, 160)), (1.0, (245, 245, 245))]
SMOOTH = [(0.24, 0.47, 0.24), (0.47, 0.59, 0.31), (0.67, 0.55, 0.39), (0.75, 0.69, 0.63), (0.96, 0.96, 0.96)]


def hypsometric(t: Column) -> list[Column]:
    """Piecewise linear between the stops, in integers."""
    out = []
    for k in range(3):
        value = F.lit(STOPS[-1][1][k]).cast("long")
        for (t0, c0), (t1, c1) in reversed(list(zip(STOPS, STOPS[1:]))):
            value = F.when(t <= t1, half_up((t - t0) / (t1 - t0) * (c1[k] - c0[k]) + c0[k])).otherwise(value)
        out.append(value)
    return out


def smooth_ramp(t: Column) -> list[Column]:
    """The stops mixed one after another by smooth steps."""
    out = [F.lit(x) for x in SMOOTH[0]]
    for (t0, _), (t1, _), colour in zip(STOPS, STOPS[1:], SMOOTH[1:]):
        s = clamp((t - t0) / (t1 - t0))
        s = s * s * (F.lit(3.0) - s * 2)
        out = [a * (F.lit(1.0) - s) + s * b for a, b in zip(out, colour)]
    return out


def lambert(nx: Column, ny: Column, nz: Column) -> Column:
    """Light from (0.5, 0.6, 0.8), with ambient light."""
    size = (0.5**2 + 0.6**2 + 0.8**2) ** 0.5
    return clamp((nx * 0.5 + ny * 0.6 + nz * 0.8) / size) * 0.7 + 0.35


def bilinear(v00: Column, v01: Column, v10: Column, v11: Column, wx: Column, wy: Column, otherwise) -> Column:
    """Of four values; the mean of those there are if some are null; `otherwise` if all are."""
    four = F.array(v00, v01, v10, v11)
    there = F.filter(four, lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(there), F.lit(0))
    one = F.lit(1.0)
    full = (v00 * (one - wx) + v01 * wx) * (one - wy) + (v10 * (one - wx) + v11 * wx) * wy
    return F.coalesce(full, mean, otherwise)


def band_separate(data: Column, bands: int) -> Column:
    """Interleaved samples as one array a band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.filter(data, lambda _, i: F.pmod(i, F.lit(bands)) == b))


def interleaved(separate: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(separate[0]) - 1), lambda i: F.transform(separate, lambda band: F.get(band, i))))


def packed_rgba(bands: Column, order: tuple = (0, 1, 2, None), fill: float = 0.0) -> list[Column]:
    """A band a channel; null in the order is the fill value."""
    return [F.coalesce(F.get(bands, F.lit(b)), F.lit(fill)) if b is not None else F.lit(fill) for b in order]


def compose(*modules):
    """A pixel pipeline: the modules in order, each a function of what the one before it returns."""

    def run(value: Column) -> Column:
        for module in modules:
            value = module(value)
        return value

    return run
