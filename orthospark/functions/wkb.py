"""Well-known binary at the edge: shapes (parts of rings) and single rings, in and out."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Types of well-known binary, and the flags that an extended form adds.
_POLYGON, _MULTIPOLYGON = 3, 6
_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE, _RING = "array<array<array<struct<x:double,y:double>>>>", "array<struct<x:double,y:double>>"


class _Reader:
    """Reads geometries one after another; raises ValueError with the reason where it can't."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("cut off")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, order: str) -> int:
        return struct.unpack(f"{order}I", self.take(4))[0]

    def header(self) -> tuple[str, int, int]:
        """(byte order, type, numbers a point)."""
        order = {0: ">", 1: "<"}.get(self.take(1)[0])
        if order is None:
            raise ValueError("no byte order")
        code = self.number(order)
        if code & _SRID:
            self.take(4)
        extra, kind = divmod(code & 0xFFFFFFF, 1000)  # thousands: with height, with measure, with both
        return order, kind, 2 + (extra in (1, 3) or bool(code & _Z)) + (extra in (2, 3) or bool(code & _M))

    def rings(self, order: str, width: int) -> list:
        out = []
        for _ in range(self.number(order)):
            n = self.number(order)
            xy = np.frombuffer(self.take(8 * width * n), dtype=f"{order}f8").reshape(-1, width)[:, :2].tolist()
            out.append([{"x": x, "y": y} for x, y in xy])
        return out

    def shape(self) -> list:
        order, kind, width = self.header()
        if kind == _POLYGON:
            rings = self.rings(order, width)
            return [rings] if rings else []
        if kind != _MULTIPOLYGON:
            raise ValueError(f"type {kind} is no polygon")
        parts = []
        for _ in range(self.number(order)):
            order_, kind, width = self.header()
            if kind != _POLYGON:
                raise ValueError(f"a part of type {kind}")
            if rings := self.rings(order_, width):
                parts.append(rings)
        return parts


def decoded(raw: bytes | None) -> tuple[list | None, str | None]:
    """(parts, reason): one of them is null, both for a null."""
    if raw is None:
        return None, None
    try:
        return _Reader(raw).shape(), None
    except ValueError as e:
        return None, str(e)


def encoded(parts) -> bytes | None:
    """A polygon, or a multipolygon where there are several parts or none; null stays null."""
    if parts is None:
        return None
    bodies = []
    for rings in parts:
        body = struct.pack("<BII", 1, _POLYGON, len(rings))
        for ring in rings:
            xy = np.array([(p["x"], p["y"]) for p in ring], dtype="<f8")
            body += struct.pack("<I", len(xy)) + xy.tobytes()
        bodies.append(body)
    return bodies[0] if len(bodies) == 1 else struct.pack("<BII", 1, _MULTIPOLYGON, len(bodies)) + b"".join(bodies)


def _with_columns(df: DataFrame, column: str, work, added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """df and the columns that work() makes of each value of one."""

    def each(batches):
        for batch in batches:
            rows = [work(x) for x in batch.column(column).to_pylist()]
            made = [pa.array(list(c), kind) for c, (_, _, kind) in zip(zip(*rows) if rows else [()] * len(added), added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[n for n, _, _ in added]])

    return df.mapInArrow(each, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {kind}" for n, kind, _ in added]))


def shape_to_wkb(df: DataFrame, parts: str, out: str = "geometry") -> DataFrame:
    """df and the WKB of its shapes."""
    return _with_columns(df, parts, lambda x: (encoded(x),), [(out, "binary", pa.binary())])


def shape_from_wkb(df: DataFrame, geometry: str, out: str = "parts", reason: str = "reason") -> DataFrame:
    """df, the shapes of its WKB polygons and multipolygons (heights, measures and SRIDs are dropped), and why one could not be read."""
    return _with_columns(df, geometry, decoded, [(out, _SHAPE, pa.list_(pa.list_(pa.list_(_POINT)))), (reason, "string", pa.string())])


def to_wkb(df: DataFrame, ring: str, out: str = "geometry") -> DataFrame:
    """df and the WKB of its ring column as a polygon; null stays null."""
    return _with_columns(df, ring, lambda x: (None if x is None else encoded([[x]]),), [(out, "binary", pa.binary())])


def from_wkb(df: DataFrame, geometry: str, out: str = "ring") -> DataFrame:
    """df and the ring of its WKB polygons of one ring; anything else, which a ring cannot hold, raises."""

    def ring(raw):
        parts, reason = decoded(raw)
        if raw is not None and (reason or len(parts) != 1 or len(parts[0]) != 1):
            raise ValueError(f"not a polygon of one ring: {reason or 'it has holes, parts or nothing'}; read it with shape_from_wkb")
        return (parts[0][0] if parts else None,)

    return _with_columns(df, geometry, ring, [(out, _RING, pa.list_(_POINT))])
