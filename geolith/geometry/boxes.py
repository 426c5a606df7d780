"""Plain boxes: polygons of one ring of four corners with sides parallel to the axes, of which batches are measured without an object each."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geolith.geometry import wkb
from geolith.geometry.batch import POLYGON_HEAD, _starts, read_plain
from geolith.geometry.measure import TOUCH

BOX_HEAD = POLYGON_HEAD + struct.pack("<I", 5)
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_FIVE = rf"^\s*(?i:POLYGON)\s*\(\s*\((?:\s*{_NUMBER}\s+{_NUMBER}\s*,){{4}}\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*\)\s*$"
_BLANKS = bytes.maketrans(b"POLYGNpolygn(),", b" " * 15)


def _upright(corners: np.ndarray) -> np.ndarray:
    """Which rings of five vertices are boxes of some width and height."""
    x, y = corners[..., 0], corners[..., 1]
    closed = (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4]) & np.isfinite(corners).all((1, 2))
    level = (y[:, 0] == y[:, 1]) & (x[:, 1] == x[:, 2]) & (y[:, 2] == y[:, 3]) & (x[:, 3] == x[:, 0])
    steep = (x[:, 0] == x[:, 1]) & (y[:, 1] == y[:, 2]) & (x[:, 2] == x[:, 3]) & (y[:, 3] == y[:, 0])
    return closed & (level | steep) & (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2])


def boxes_of(values: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """(rows, corners of five vertices each) of the boxes among WKT texts and WKB."""
    at, polygon, n, xy = read_plain(values)
    five = polygon & (n == 5)
    corners = [xy[_starts(n)[:-1][five][:, None] + np.arange(5)]]
    rows = [at[five]]
    binary = [i for i, d in enumerate(values) if isinstance(d, (bytes, bytearray)) and len(d) == 93 and d.startswith(BOX_HEAD)]
    rows.append(np.array(binary, dtype=np.int64))
    corners.append(np.frombuffer(b"".join(values[i][13:] for i in binary), dtype="<f8").reshape(-1, 5, 2))
    rows, corners = np.concatenate(rows), np.concatenate(corners)
    good = _upright(corners)
    return rows[good], corners[good]


def read_boxes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What boxes_of gives of WKT texts in Arrow, read without an object each."""
    five = pc.fill_null(pc.match_substring_regex(texts, _FIVE), False)
    kept = texts.filter(five).cast(pa.large_string())
    rows = np.flatnonzero(five.to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.empty((0, 5, 2))
    ends = np.frombuffer(kept.buffers()[1], dtype=np.int64)[kept.offset : kept.offset + len(kept) + 1]
    corners = np.fromstring(kept.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(_BLANKS), sep=" ").reshape(-1, 5, 2)
    good = _upright(corners)
    return rows[good], corners[good]


def column_boxes(values: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """What boxes_of gives of a column of texts or of WKB."""
    text = isinstance(next((v for v in values if v is not None), None), str)
    return read_boxes(pa.array(values, pa.large_string())) if text else boxes_of(values)


def sides_of(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths and heights."""
    return np.abs(corners[:, 2, 0] - corners[:, 0, 0]), np.abs(corners[:, 2, 1] - corners[:, 0, 1])


def bounds_of(corners: np.ndarray) -> np.ndarray:
    """(rows, 4): x0, y0, x1, y1."""
    return np.hstack((corners.min(1), corners.max(1)))


def texts_of(corners: np.ndarray) -> list[str] | None:
    """WKT of boxes of whole coordinates; None if some are not."""
    if not ((corners == np.floor(corners)) & (np.abs(corners) < 1e15)).all():
        return None
    return ["POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))" % tuple(c) for c in corners.reshape(-1, 10).astype(np.int64).tolist()]


def polygons_of(data: bytes) -> list:
    """The polygons of a WKB, for overlays."""
    if data.startswith(BOX_HEAD) and len(data) == 93:
        v = struct.unpack_from("<10d", data, 13)
        return [[list(zip(v[::2], v[1::2]))]]
    return wkb.load(data).polygons


def paired(left: Sequence, right: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bounds on the left, bounds on the right) of the pairs that are boxes on both sides."""
    (l, a), (r, b) = boxes_of(left), boxes_of(right)
    both, i, j = np.intersect1d(l, r, assume_unique=True, return_indices=True)
    return both, bounds_of(a[i]), bounds_of(b[j])


def box_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least distance of closed boxes, 0 where they meet."""
    return np.hypot(*np.maximum(0.0, np.maximum(b[:, :2] - a[:, 2:], a[:, :2] - b[:, 2:])).T)


def box_shared_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the left's boundary that lies on the right's."""
    out = np.zeros(len(a))
    for k in (0, 1):
        # Sides that are k-lines: both of a box span the same part of the other axis.
        m = 1 - k
        span = a[:, m + 2] - a[:, m]
        common = np.maximum(0.0, np.minimum(a[:, m + 2], b[:, m + 2]) - np.maximum(a[:, m], b[:, m]))
        for side in (a[:, k], a[:, k + 2]):
            out += np.where(np.minimum(np.abs(side - b[:, k]), np.abs(side - b[:, k + 2])) <= TOUCH * span, common, 0.0)
    return out
