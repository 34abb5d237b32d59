"""Pixel pipelines given as data: an ordered list of {"module": name, "props": {...}}, compiled to column expressions.

A pixel is a list of channels (doubles; null is no data); a module takes the channels so far and returns new ones.  A prop is a
number, a list, or a column, so that what differs by collection (nodata, display domains) comes from a join, not from Python.
The raw channels stay at hand for the collar rule, which looks at them before adjustment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pixels as P


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(None if x is None else float(x)).cast("double")


class Pixel:
    """The channels of a pixel on its way; raw: as they came in; alpha: 0 or 255, or null where no module has set it."""

    def __init__(self, channels: list[Column]):
        self.raw = self.channels = list(channels)
        self.alpha: Column | None = None

    def each(self, f: Callable[[Column], Column]) -> None:
        self.channels = [f(c) for c in self.channels]


def mask(p: Pixel, nodata, digits: int | None = None) -> None:
    """Channels that are equal to nodata, where asked after rounding to so many digits, are null; a null nodata masks nothing."""
    p.each(lambda c: F.when(~F.coalesce((c if digits is None else F.round(c, digits)) == _column(nodata), F.lit(False)), c))


def validity(p: Pixel, flag) -> None:
    """Null where the validity mask's flag is 0."""
    p.each(lambda c: F.when(_column(flag) != 0, c))


def composite(p: Pixel, order) -> None:
    """Channels by number; null in the order is a channel of ones."""
    p.channels = [F.lit(1.0) if i is None else p.channels[i] for i in order]


def rescale(p: Pixel, lo, hi) -> None:
    """lo..hi as 0..1, clamped; an empty domain is widened by the least amount that is positive."""
    lo, hi = _column(lo), _column(hi)
    p.each(lambda c: P.clamp((c - lo) / F.greatest(hi - lo, F.lit(1e-12))))


def adjust(p: Pixel, brightness=0.0, contrast=1.0) -> None:
    p.each(lambda c: P.clamp((c - 0.5) * _column(contrast) + 0.5 + _column(brightness)))


def colormap(p: Pixel, table, size: int) -> None:
    """The first channel (0..1) as an index into a table of [r, g, b] entries (a column or a list), each 0..1."""
    table = table if isinstance(table, Column) else F.array(*[F.array(*[F.lit(float(v)) for v in entry]) for entry in table])
    at = P.half_up(p.channels[0] * (size - 1)).cast("int")
    p.channels = [F.get(F.get(table, at), F.lit(k)) for k in range(3)]


def gray(p: Pixel, white_is_zero=False) -> None:
    p.channels = P.gray(p.channels[0], bool(white_is_zero))


def quantize(p: Pixel) -> None:
    """0..1 as whole numbers of 0..255."""
    p.each(lambda c: P.half_up(c * 255).cast("double"))


def collar(p: Pixel) -> None:
    """Transparent where the raw channels (0..1) are black, or the channels so far (0..255) white."""
    p.alpha = F.when(P.alpha([P.half_up(c * 255) for c in p.raw[:3]], p.channels[:3]) == 0, 0.0).otherwise(255.0)


MODULES = {f.__name__: f for f in (mask, validity, composite, rescale, adjust, colormap, gray, quantize, collar)}


def compiled(pipeline: list[dict], channels: list[Column]) -> tuple[list[Column], Column]:
    """(channels, alpha) after the modules, in order; alpha is 0 where a channel is null.  Unknown modules and props are refused."""
    pixel = Pixel(channels)
    for step in pipeline:
        if (name := step.get("module")) not in MODULES:
            raise ValueError(f"no module {name!r}")
        if unknown := set(step) - {"module", "props"}:
            raise ValueError(f"{name}: {', '.join(sorted(unknown))}")
        try:
            MODULES[name](pixel, **step.get("props", {}))
        except TypeError as e:
            raise ValueError(f"{name}: {e}") from e
    there = F.lit(True)
    for c in pixel.channels:
        there = there & c.isNotNull()
    return pixel.channels, F.when(there, F.coalesce(pixel.alpha, F.lit(255.0)) if pixel.alpha is not None else F.lit(255.0)).otherwise(0.0)
