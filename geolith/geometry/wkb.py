"""Well-known binary, read into and written from NumPy coordinate arrays."""

from __future__ import annotations

import struct

import numpy as np

from geolith.geometry.wkt import BadGeometry, Geom, collect

_CODES = {"POINT": 1, "LINESTRING": 2, "LINEARRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
_NAMES = {v: k for k, v in _CODES.items() if k != "LINEARRING"}


def _path(path) -> bytes:
    a = np.asarray([tuple(c)[:2] for c in path] if not isinstance(path, np.ndarray) else path[:, :2], dtype="<f8")
    return struct.pack("<I", len(a)) + a.tobytes()


def dump(g: Geom) -> bytes:
    """Little-endian two-dimensional WKB. An empty point is written with NaN coordinates."""
    code = _CODES[g.kind]
    head = struct.pack("<BI", 1, code)
    if code == 1:
        return head + struct.pack("<dd", *(tuple(g.points[0])[:2] if g.points else (np.nan, np.nan)))
    if code == 2:
        return head + (_path(g.lines[0]) if g.lines else struct.pack("<I", 0))
    if code == 3:
        rings = g.polygons[0] if g.polygons else []
        return head + struct.pack("<I", len(rings)) + b"".join(map(_path, rings))
    if code == 4:
        parts = [Geom("POINT", points=[p]) for p in g.points]
    elif code == 5:
        parts = [Geom("LINESTRING", lines=[x]) for x in g.lines]
    elif code == 6:
        parts = [Geom("POLYGON", polygons=[x]) for x in g.polygons]
    else:
        parts = g.members
    return head + struct.pack("<I", len(parts)) + b"".join(map(dump, parts))


def load(data: bytes) -> Geom:
    """Read WKB or EWKB of either byte order; Z and M are kept as further columns."""
    try:
        g, end = _load(bytes(data), 0)
    except (struct.error, ValueError, IndexError, KeyError) as error:
        raise BadGeometry("corrupt WKB") from error
    return g


def _load(data: bytes, at: int):
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    dims = 2
    if code & 0x20000000:
        at += 4
    if code & 0xC0000000:
        dims += bin(code >> 30).count("1")
        code &= 0x0FFFFFFF
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    code %= 1000
    kind = _NAMES[code]

    def count(at):
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    def path(at):
        n, at = count(at)
        a = np.frombuffer(data, dtype=order + "f8", count=n * dims, offset=at).reshape(n, dims)
        return a, at + 8 * n * dims

    if code == 1:
        c = struct.unpack_from(f"{order}{dims}d", data, at)
        return Geom(kind, points=[] if c[0] != c[0] and c[1] != c[1] else [c]), at + 8 * dims
    if code == 2:
        a, at = path(at)
        return Geom(kind, lines=[a] if len(a) else []), at
    n, at = count(at)
    if code == 3:
        rings = []
        for _ in range(n):
            a, at = path(at)
            if len(a):
                rings.append(a)
        return Geom(kind, polygons=[rings] if rings else []), at
    parts = []
    for _ in range(n):
        part, at = _load(data, at)
        parts.append(part)
    if code == 7:
        return collect(parts), at
    whole = collect(parts)
    return Geom(kind, whole.points, whole.lines, whole.polygons), at
