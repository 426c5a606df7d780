"""Measures and similarities of many geometries at once.

A :class:`Flat` holds the vertices, segments and edges of a batch of geometries in common arrays.  Pairs are scored in
groups of like size, padded to rectangles, so that an Arrow batch costs a few hundred array operations whatever the
number of its pairs.  Plain polygons of one ring and plain lines are read from text and WKB without an object each;
everything else goes through :class:`Shape`, and pairs that mix dimensions, or touch without common area, are scored
one by one.  Results agree with geolith.geometry.measure up to the last digits.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence

import numpy as np

from geolith.geometry import wkb
from geolith.geometry.measure import TOUCH, Shape, dissolved_length, hausdorff, iou, same_vertices

POLYGON_HEAD = struct.pack("<BIII", 1, 3, 1, 0)[:9]
LINE_HEAD = struct.pack("<BI", 1, 2)
_PLAIN = re.compile(r"\s*(POLYGON|LINESTRING)\s*\(\s*(\(?)([^()]*)(\)?)\s*\)\s*\Z", re.I)
CELLS = 1 << 21


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def read_plain(texts: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, whether polygon, vertex counts, coordinates) of the texts that are plain polygons of one ring or plain lines with finite two-dimensional coordinates."""
    rows, polygon, counts, flat = [], [], [], []
    match = _PLAIN.match
    for row, text in enumerate(texts):
        if not isinstance(text, str) or not (m := match(text)):
            continue
        is_polygon = m.group(1)[0] in "Pp"
        if bool(m.group(2)) != is_polygon or bool(m.group(4)) != is_polygon:
            continue
        parts = [c.split() for c in m.group(3).split(",")]
        if any(len(c) != 2 for c in parts):
            continue
        try:
            numbers = [float(v) for c in parts for v in c]
        except ValueError:
            continue
        if len(parts) < (4 if is_polygon else 2) or (is_polygon and numbers[:2] != numbers[-2:]):
            continue
        rows.append(row)
        polygon.append(is_polygon)
        counts.append(len(parts))
        flat += numbers
    xy, n, kinds, at = np.array(flat, dtype=float).reshape(-1, 2), np.array(counts, dtype=np.int64), np.array(polygon, dtype=bool), np.array(rows, dtype=np.int64)
    if len(n):
        good = np.logical_and.reduceat(np.isfinite(xy).all(1), _starts(n)[:-1])
        if not good.all():
            xy, n, kinds, at = xy[np.repeat(good, n)], n[good], kinds[good], at[good]
    return at, kinds, n, xy


def without_repeats(xy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths without vertices equal to the one before."""
    keep = np.ones(len(xy), dtype=bool)
    keep[1:] = (xy[1:] != xy[:-1]).any(1)
    keep[_starts(n)[:-1]] = True
    return xy[keep], np.add.reduceat(keep, _starts(n)[:-1]).astype(np.int64)


def signed_areas(xy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shoelace areas of closed rings, each relative to its first vertex."""
    at = _starts(n)[:-1]
    q = xy - np.repeat(xy[at], n, axis=0)
    c = np.zeros(len(xy))
    c[:-1] = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
    c[at + n - 1] = 0
    return np.add.reduceat(c, at) / 2


def settled_rings(xy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed rings without repeats, counter-clockwise, from their least vertex on."""
    xy, n = without_repeats(xy + 0.0, n)
    m = np.maximum(n - 1, 1)  # without the closing vertex; a ring of one point keeps it
    at = _starts(n)[:-1]
    back = signed_areas(xy, n) <= 0
    owner, k = np.repeat(np.arange(len(n)), m), _ranges(m)
    body = at[owner] + k
    order = np.lexsort((xy[body, 1], xy[body, 0], owner))
    first = k[order[_starts(m)[:-1]]]
    # Turned rings run down from their first least vertex; where it comes twice, the place in the turned ring counts.
    last = np.zeros(len(n), dtype=np.int64)
    least = (xy[body] == xy[at + first][owner]).all(1)
    np.maximum.at(last, owner[least], k[least])
    start, step = np.where(back, last, first), np.where(back, -1, 1)
    owner, k = np.repeat(np.arange(len(n)), m + 1), _ranges(m + 1)
    return xy[at[owner] + (start[owner] + step[owner] * k) % m[owner]], m + 1


def settled_lines(xy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines without repeats, two vertices at least, in the direction whose coordinates come first."""
    xy, n = without_repeats(xy + 0.0, n)
    one = n == 1
    if one.any():
        xy, n = np.repeat(xy, np.where(np.repeat(one, n), 2, 1), axis=0), np.where(one, 2, n)
    at = _starts(n)[:-1]
    owner, k = np.repeat(np.arange(len(n)), n), _ranges(n)
    mirror = at[owner] + n[owner] - 1 - k
    # Tuples of coordinates compare; the backward one starts with the last vertex's x and y.
    unlike = xy != xy[mirror]
    side = np.where(unlike[:, 0], np.sign(xy[:, 0] - xy[mirror, 0]), np.where(unlike[:, 1], np.sign(xy[:, 1] - xy[mirror, 1]), 0))
    place = np.where(side != 0, k, n[owner])
    first = np.minimum.reduceat(place, at)
    back = np.zeros(len(n), dtype=bool)
    some = first < n
    back[some] = side[at[some] + first[some]] > 0
    return np.where(back[owner, None], xy[mirror], xy), n


def as_wkb(xy: np.ndarray, n: np.ndarray, polygon: np.ndarray) -> list[bytes]:
    data, ends = np.ascontiguousarray(xy, dtype="<f8").tobytes(), (_starts(n) * 16).tolist()
    heads = [(POLYGON_HEAD if p else LINE_HEAD) + struct.pack("<I", k) for p, k in zip(polygon.tolist(), n.tolist())]
    return [h + data[a:b] for h, a, b in zip(heads, ends, ends[1:])]


MULTI_POLYGON_HEAD = struct.pack("<BI", 1, 6)
MULTI_LINE_HEAD = struct.pack("<BI", 1, 5)
ANY_POLYGON_HEAD = struct.pack("<BI", 1, 3)


def _paths(data: bytes) -> list[tuple[int, bytes]] | None:
    """(sign, coordinates) of the paths of a little-endian two-dimensional geometry of polygons or lines alone: 1 for shells, -1 for holes, 0 for lines. None for any other."""
    count = struct.Struct("<I").unpack_from
    out = []

    def polygon(at: int) -> int:
        (rings,) = count(data, at)
        at += 4
        for k in range(rings):
            (n,) = count(data, at)
            if not n:
                raise ValueError("an empty ring")
            out.append((-1 if k else 1, data[at + 4 : at + 4 + 16 * n]))
            at += 4 + 16 * n
        return at

    try:
        if data.startswith(ANY_POLYGON_HEAD):
            at = polygon(5)
        elif data.startswith(MULTI_POLYGON_HEAD):
            at = 9
            for _ in range(count(data, 5)[0]):
                if data[at : at + 5] != ANY_POLYGON_HEAD:
                    return None
                at = polygon(at + 5)
        elif data.startswith(LINE_HEAD) or data.startswith(MULTI_LINE_HEAD):
            at, parts = (0, 1) if data.startswith(LINE_HEAD) else (9, count(data, 5)[0])
            for _ in range(parts):
                if data[at : at + 5] != LINE_HEAD:
                    return None
                (n,) = count(data, at + 5)
                if not n:
                    return None
                out.append((0, data[at + 9 : at + 9 + 16 * n]))
                at += 9 + 16 * n
        else:
            return None
    except (struct.error, ValueError):
        return None
    return out if out and at == len(data) else None


class Flat:
    """Vertices, segments (all), edges (of rings, not upright, from left to right) and measures of a batch of geometries."""

    def __init__(self, xy: np.ndarray, n: np.ndarray, sign: np.ndarray, rows: np.ndarray, size: int, others: dict[int, Shape] | None = None, data: Sequence[bytes] = ()):
        """Paths (n vertices each; sign 1 for shells, -1 for holes, 0 for lines) of the geometries at rows, which rise, and prepared shapes at the others. data: WKB by row, where single shapes may be asked for."""
        self.others, self.size, self.data = dict(others or {}), size, data
        at = _starts(n)
        owner = np.repeat(rows, n)
        inner = np.ones(len(xy), dtype=bool)
        inner[at[1:] - 1] = False
        seg = np.hstack((xy[:-1], xy[1:]))[inner[:-1]] if len(xy) else np.empty((0, 4))
        seg_owner = owner[inner]
        ring = np.repeat(sign != 0, n)[inner]
        lengths = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1])
        self.area, self.length, self.dissolved, self.bounds = np.zeros(size), np.zeros(size), np.full(size, np.nan), np.full((size, 4), np.nan)
        if len(n):
            rings = sign != 0
            if rings.any():
                self.area += np.bincount(rows[rings], np.abs(signed_areas(xy[np.repeat(rings, n)], n[rings])) * sign[rings], size)
            if len(seg):
                self.length += np.bincount(seg_owner, lengths, size)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            self.bounds[owner[first]] = np.hstack((np.minimum.reduceat(xy, first), np.maximum.reduceat(xy, first)))
        parts = [(owner, xy, seg_owner, seg, *self._edges(seg_owner[ring], seg[ring]))]
        for row, s in self.others.items():
            self.area[row], self.length[row], self.bounds[row] = s.area, s.length, s.bounds
            parts.append((np.full(len(s.vertices), row), s.vertices, np.full(len(s.segments), row), s.segments, np.full(len(s.edges), row), s.edges))
        for name, k, width in (("vertices", 0, 2), ("segments", 2, 4), ("edges", 4, 4)):
            who, what = np.concatenate([p[k] for p in parts]), np.vstack([p[k + 1].reshape(-1, width) for p in parts])
            counts = np.bincount(who, minlength=size) if len(who) else np.zeros(size, dtype=np.int64)
            setattr(self, name, what[np.argsort(who, kind="stable")] if self.others else what)
            setattr(self, name + "_n", counts)
            setattr(self, name + "_at", _starts(counts)[:-1])
        self.measure = np.where(self.area > 0, self.area, self.length)

    @staticmethod
    def _edges(owner, seg):
        keep = seg[:, 0] != seg[:, 2]
        owner, seg = owner[keep], seg[keep]
        back = seg[:, 0] > seg[:, 2]
        return owner, np.where(back[:, None], seg[:, [2, 3, 0, 1]], seg)

    @classmethod
    def load(cls, values: Sequence[bytes]) -> Flat:
        """From WKB."""
        rows, counts, sign, chunks, others = [], [], [], [], {}
        for row, data in enumerate(values):
            if data.startswith(POLYGON_HEAD) and len(data) - 13 == 16 * struct.unpack_from("<I", data, 9)[0] > 0:
                found = ((1, data[13:]),)
            else:
                found = _paths(data)
            if found is None:
                others[row] = Shape(wkb.load(data))
                continue
            for s, chunk in found:
                chunks.append(chunk)
                sign.append(s)
                rows.append(row)
                counts.append(len(chunk) >> 4)
        xy = np.frombuffer(b"".join(chunks), dtype="<f8").reshape(-1, 2)
        return cls(xy, np.array(counts, dtype=np.int64), np.array(sign, dtype=np.int64), np.array(rows, dtype=np.int64), len(values), others, values)

    def shape(self, row: int) -> Shape:
        found = self.others.get(row)
        if found is None:
            found = self.others[row] = Shape(wkb.load(self.data[row]))
        return found

    def padded(self, name: str, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, width, columns) with the last element repeated, and which are real."""
        n = getattr(self, name + "_n")[rows]
        k = np.arange(width)
        index = getattr(self, name + "_at")[rows][:, None] + np.minimum(k, n[:, None] - 1)
        return getattr(self, name)[index], k < n[:, None]


def _groups(a: np.ndarray, b: np.ndarray):
    """(indices, width of a, width of b) of pairs of like size, of at most CELLS cells."""
    up = lambda n: np.where(n <= 32, (n + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ua, ub = up(a), up(b)
    key = ua << 32 | ub
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            wa, wb = int(a[some].max()), int(b[some].max())
            step = max(1, CELLS // max(1, wa * wb))
            for i in range(0, len(some), step):
                yield some[i : i + step], wa, wb


def _farthest(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Greatest squared distance of each row's points to its nearest segment."""
    p, q = segments[..., :2], segments[..., 2:]
    d = q - p
    n2 = (d * d).sum(-1)
    wx, wy = points[:, :, None, 0] - p[:, None, :, 0], points[:, :, None, 1] - p[:, None, :, 1]
    t = wx * d[:, None, :, 0]
    t += wy * d[:, None, :, 1]
    t /= np.where(n2 > 0, n2, 1)[:, None, :]
    np.clip(t, 0, 1, out=t)
    wx -= t * d[:, None, :, 0]
    wy -= t * d[:, None, :, 1]
    wx *= wx
    wy *= wy
    wx += wy
    return wx.min(2).max(1)


def point_distances(f: Flat, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distance of each point to the linework of the geometry at its row."""
    n = f.segments_n[rows]
    seg = f.segments[np.repeat(f.segments_at[rows], n) + _ranges(n)]
    p = np.repeat(points, n, axis=0)
    d = seg[:, 2:] - seg[:, :2]
    n2 = (d * d).sum(1)
    wx, wy = p[:, 0] - seg[:, 0], p[:, 1] - seg[:, 1]
    t = np.clip((wx * d[:, 0] + wy * d[:, 1]) / np.where(n2 > 0, n2, 1), 0, 1)
    rx, ry = wx - t * d[:, 0], wy - t * d[:, 1]
    out = np.full(len(points), np.inf)
    if len(seg):
        out[n > 0] = np.minimum.reduceat(np.sqrt(rx * rx + ry * ry), _starts(n)[:-1][n > 0])
    return out


def hausdorff_distances(f: Flat, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Discrete Hausdorff distance of each pair."""
    out = np.empty(len(l))
    for some, _, _ in _groups(np.maximum(f.vertices_n[l], f.segments_n[l]), np.maximum(f.vertices_n[r], f.segments_n[r])):
        a, b = l[some], r[some]
        if len(some) == 1 and f.vertices_n[a[0]] * f.vertices_n[b[0]] > CELLS:
            out[some] = hausdorff(f.shape(int(a[0])), f.shape(int(b[0])))
            continue
        far = []
        for x, y in ((a, b), (b, a)):
            points, _ = f.padded("vertices", x, int(f.vertices_n[x].max()))
            segments, _ = f.padded("segments", y, int(f.segments_n[y].max()))
            far.append(_farthest(points, segments))
        out[some] = np.sqrt(np.maximum(*far))
    return out


def _heights(edges: np.ndarray, mids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, mids, edges): ordinate of each edge over each mid, and whether it is over it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (edges[..., 3] - edges[..., 1]) / (edges[..., 2] - edges[..., 0])
    y = mids[:, :, None] - edges[:, None, :, 0]
    away = y <= 0
    away |= mids[:, :, None] >= edges[:, None, :, 2]
    with np.errstate(invalid="ignore"):
        y *= slope[:, None, :]
    y += edges[:, None, :, 1]
    return y, ~away


def common_areas(f: Flat, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(pairs, 3): areas of both sides and of their common part, by even-odd coverage of slabs."""
    out = np.empty((len(l), 3))
    for some, wa, wb in _groups(f.edges_n[l], f.edges_n[r]):
        step = max(1, CELLS // (8 * (wa + wb) * max(wa, wb)))
        for k in range(0, len(some), step):
            part = some[k : k + step]
            out[part] = _slab_areas(f, l[part], r[part], wa, wb)
    return out


def _slab_areas(f: Flat, l: np.ndarray, r: np.ndarray, wa: int, wb: int) -> np.ndarray:
    ea, real_a = f.padded("edges", l, wa)
    eb, real_b = f.padded("edges", r, wb)
    ea[..., 2] = np.where(real_a, ea[..., 2], ea[..., 0])  # what pads is over nothing
    eb[..., 2] = np.where(real_b, eb[..., 2], eb[..., 0])
    dx, dy = (ea[..., 2] - ea[..., 0])[:, :, None], (ea[..., 3] - ea[..., 1])[:, :, None]
    ex, ey = (eb[..., 2] - eb[..., 0])[:, None, :], (eb[..., 3] - eb[..., 1])[:, None, :]
    wx, wy = eb[:, None, :, 0] - ea[:, :, None, 0], eb[:, None, :, 1] - ea[:, :, None, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = dx * ey - dy * ex
        t = (wx * ey - wy * ex) / d
        u = (wx * dy - wy * dx) / d
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1) & real_a[:, :, None] & real_b[:, None, :]
    pair, i, j = np.nonzero(hit)
    crossing = ea[pair, i, 0] + t[pair, i, j] * dx[pair, i, 0]
    most = np.bincount(pair, minlength=len(l))
    cuts = np.repeat(ea[:, :1, 0], int(most.max(initial=0)), axis=1)
    cuts[pair, _ranges(most)] = crossing
    xs = np.sort(np.concatenate((ea[..., 0], ea[..., 2], eb[..., 0], eb[..., 2], cuts), axis=1), axis=1)
    # Equal abscissae make slabs of no width: each pair's own go to the end and the rest is cut to the longest.
    wide = np.diff(xs, axis=1)
    n = (wide > 0).sum(1)
    order = np.argsort(wide <= 0, axis=1, kind="stable")[:, : max(1, int(n.max(initial=0)))]
    lo = np.take_along_axis(xs[:, :-1], order, 1)
    width = np.take_along_axis(wide, order, 1)
    mids = (lo + np.take_along_axis(xs[:, 1:], order, 1)) / 2
    (ya, over_a), (yb, over_b) = _heights(ea, mids), _heights(eb, mids)
    na, nb = over_a.sum(2), over_b.sum(2)
    la, lb, both = np.zeros(mids.shape), np.zeros(mids.shape), np.zeros(mids.shape)
    once = (na <= 2) & (nb <= 2) & (width > 0)
    if once.any():
        low = [np.where(over, y, np.inf).min(2) for y, over in ((ya, over_a), (yb, over_b))]
        high = [np.where(over, y, -np.inf).max(2) for y, over in ((ya, over_a), (yb, over_b))]
        for length, k in ((la, 0), (lb, 1)):
            length[once] = np.maximum(high[k] - low[k], 0)[once]
        both[once] = np.maximum(np.minimum(*high) - np.maximum(*low), 0)[once]
    many = ~once & (width > 0)
    if many.any():
        sides = []
        for y, count, length in ((np.where(over_a, ya, np.inf)[many], na[many], la), (np.where(over_b, yb, np.inf)[many], nb[many], lb)):
            k = int(count.max())
            k += k % 2
            y = np.sort(y, axis=1)
            y = np.hstack((y, np.full((len(y), max(0, k - y.shape[1])), np.inf)))[:, :k]
            lower, upper = y[:, ::2], y[:, 1::2]
            with np.errstate(invalid="ignore"):
                length[many] = np.where(np.isfinite(upper), upper - lower, 0).sum(1)
            sides.append((lower, upper))
        with np.errstate(invalid="ignore"):
            span = np.minimum(sides[0][1][:, :, None], sides[1][1][:, None, :]) - np.maximum(sides[0][0][:, :, None], sides[1][0][:, None, :])
        both[many] = np.where(np.isfinite(span) & (span > 0), span, 0).sum((1, 2))
    return np.stack([(x * width).sum(1) for x in (la, lb, both)], axis=1)


def dissolved_lengths(f: Flat, rows: np.ndarray) -> np.ndarray:
    """Length of the union of each geometry's segments."""
    out = f.length[rows].copy()
    lap = np.zeros(len(rows), dtype=bool)
    for some, w, _ in _groups(f.segments_n[rows], f.segments_n[rows]):
        if w > 1:
            s, real = f.padded("segments", rows[some], w)
            _, lo, hi = _spans(s, s)
            other = real[:, :, None] & real[:, None, :] & ~np.eye(w, dtype=bool)
            lap[some] = ((hi > lo) & other).any((1, 2))
    for k in np.flatnonzero(lap):
        a = f.segments_at[rows[k]]
        out[k] = dissolved_length(f.segments[a : a + f.segments_n[rows[k]]])
    return out


def _spans(a: np.ndarray, b: np.ndarray):
    """Lengths of a's segments, and the spans of each that lie on each of b's, as parameters; hi <= lo where they do not."""
    d = a[..., 2:] - a[..., :2]
    n2 = (d * d).sum(-1)
    safe = np.where(n2 > 0, n2, 1)
    ends, far = [], np.zeros(())
    for k in (0, 2):
        w = b[:, None, :, k : k + 2] - a[:, :, None, :2]
        far = np.maximum(far, np.abs(w[..., 0] * d[:, :, None, 1] - w[..., 1] * d[:, :, None, 0]))
        ends.append((w * d[:, :, None, :]).sum(-1) / safe[:, :, None])
    lo, hi = np.maximum(np.minimum(*ends), 0), np.minimum(np.maximum(*ends), 1)
    on = (far <= TOUCH * n2[:, :, None]) & (n2 > 0)[:, :, None]
    return np.sqrt(n2), np.where(on, lo, 0), np.where(on, hi, 0)


def common_lengths(f: Flat, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of l's lines that lies on r's, and whether that is sure: no stretch counts twice."""
    out, sure = np.empty(len(l)), np.empty(len(l), dtype=bool)
    for some, wa, wb in _groups(f.segments_n[l], f.segments_n[r]):
        a, real_a = f.padded("segments", l[some], wa)
        b, real_b = f.padded("segments", r[some], wb)
        length, lo, hi = _spans(a, b)
        on = (hi > lo) & real_a[:, :, None] & real_b[:, None, :]
        out[some] = (np.where(on, hi - lo, 0) * length[:, :, None]).sum((1, 2))
        sure[some] = (on.sum(2) <= 1).all(1)
    return out, sure


def similarities_of(f: Flat, l: np.ndarray, r: np.ndarray, weights: tuple[float, float, float], least: float) -> np.ndarray:
    """(pairs, 3): overlap, Hausdorff and shape similarity. Where the last two tell that the weighted sum is below ``least``, the overlap stays 0."""
    la, ra = f.area[l], f.area[r]
    ml, mr = f.measure[l], f.measure[r]
    top = np.maximum(ml, mr)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(top > 0, np.minimum(ml, mr) / top, 0.0)
        box = (f.bounds[:, 2] - f.bounds[:, 0]) * (f.bounds[:, 3] - f.bounds[:, 1])
        fill = np.where(box != 0, f.area / box, 1.0)
    for k in np.flatnonzero(top == 0):
        ratio[k] = float(same_vertices(f.shape(int(l[k])), f.shape(int(r[k]))))
    shape = np.clip((ratio + 1 - np.abs(fill[l] - fill[r])) / 2, 0, 1)
    lo, hi = np.minimum(f.bounds[l, :2], f.bounds[r, :2]), np.maximum(f.bounds[l, 2:], f.bounds[r, 2:])
    scale = np.hypot(hi[:, 0] - lo[:, 0], hi[:, 1] - lo[:, 1])
    far = hausdorff_distances(f, l, r)
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(scale > 0, np.maximum(0.0, 1 - far / scale), (far == 0).astype(float))
    overlap = np.zeros(len(l))
    open_ = weights[0] + weights[1] * near + weights[2] * shape + 1e-9 >= least
    apart = (f.bounds[l, 0] > f.bounds[r, 2]) | (f.bounds[r, 0] > f.bounds[l, 2]) | (f.bounds[l, 1] > f.bounds[r, 3]) | (f.bounds[r, 1] > f.bounds[l, 3])
    areal = open_ & ~apart & (la > 0) & (ra > 0) & (f.edges_n[l] > 0) & (f.edges_n[r] > 0)
    linear = open_ & ~apart & (la == 0) & (ra == 0) & (ml > 0) & (mr > 0) & (f.edges_n[l] == 0) & (f.edges_n[r] == 0)
    rest = open_ & ~areal & ~linear
    if areal.any():
        at = np.flatnonzero(areal)
        big = np.maximum(f.edges_n[l[at]], f.edges_n[r[at]]) > 512  # dense slabs of one such pair would not fit
        rest[at[big]] = True
        at = at[~big]
        a, b, both = common_areas(f, l[at], r[at]).T
        touching = np.flatnonzero(both <= TOUCH * np.minimum(la[at], ra[at]))
        both[touching] = 0
        union = a + b - both
        if len(touching):  # then the length of the common boundary counts
            both[touching], sure = common_lengths(f, l[at[touching]], r[at[touching]])
            rest[at[touching[~sure]]] = True
        overlap[at] = np.clip(np.where(union > 0, both / np.where(union > 0, union, 1), 0), 0, 1)
    if linear.any():
        at = np.flatnonzero(linear)
        used = np.unique(np.concatenate((l[at], r[at])))
        f.dissolved[used] = dissolved_lengths(f, used)
        both, sure = common_lengths(f, l[at], r[at])
        sure |= f.dissolved[r[at]] >= f.length[r[at]] * (1 - 1e-12)  # what does not cover itself covers no stretch twice
        sure &= f.dissolved[l[at]] >= f.length[l[at]] * (1 - 1e-12)
        rest[at[~sure]] = True
        union = f.dissolved[l[at]] + f.dissolved[r[at]] - both
        overlap[at] = np.clip(both / np.where(union > 0, union, 1), 0, 1)
    for k in np.flatnonzero(rest):
        overlap[k] = iou(f.shape(int(l[k])), f.shape(int(r[k])))
    return np.stack((overlap, near, shape), axis=1)


def of_pairs(left_ids, right_ids, left: Sequence[bytes], right: Sequence[bytes], one_table: bool) -> tuple[Flat, np.ndarray, np.ndarray]:
    """The geometries of a batch of pairs, each read once, and the rows of either side. one_table: equal ids on both sides are one geometry."""
    ids = [np.asarray(left_ids, dtype=np.int64), np.asarray(right_ids, dtype=np.int64)]
    data = [np.asarray(left, dtype=object), np.asarray(right, dtype=object)]
    if one_table:
        _, first, row = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        n = len(ids[0])
        return Flat.load(np.concatenate(data)[first].tolist()), row[:n], row[n:]
    (_, fl, l), (_, fr, r) = (np.unique(x, return_index=True, return_inverse=True) for x in ids)
    return Flat.load(data[0][fl].tolist() + data[1][fr].tolist()), l, r + len(fl)
