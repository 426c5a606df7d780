"""Topological equality of exact decimal coordinates.

Coordinates are scaled to integers, so nothing rounds.  Three point sets are compared: the points outside the
lines, the lines as maximal collinear intervals, and the polygons as the signed boundary chain of the sum of
their indicators.  That chain is the same for every way of writing a region without overlapping parts: ring
start, direction, extra vertices on an edge, splitting into touching parts.  For regions whose parts overlap
or rings cross themselves the chains may differ although the sets agree; then the exact area of the symmetric
difference decides.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from math import gcd

from geolith.geometry.wkt import BadGeometry, Geom, exact, parse


def _scale(*geoms: Geom):
    """The integer-valued copies of the geometries on one common power of ten."""
    least = min((v[1] for g in geoms for c in g.coords() for v in c[:2]), default=0)
    power = [10**k for k in range(1 - least)]

    def seq(path):
        return [(c[0][0] * power[c[0][1] - least], c[1][0] * power[c[1][1] - least]) for c in path]

    return [Geom(g.kind, seq(g.points), [seq(x) for x in g.lines], [[seq(r) for r in p] for p in g.polygons]) for g in geoms]


def _line_of(p, q):
    """Normalised supporting line (a, b, c) with ax + by = c, and whether p to q runs along its positive direction."""
    a, b = q[1] - p[1], p[0] - q[0]
    k = gcd(a, b)
    a, b = a // k, b // k
    forward = (-b, a) > (0, 0)
    if not forward:
        a, b = -a, -b
    return (a, b, a * p[0] + b * p[1]), forward


def _area2(ring) -> int:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))


def chain(polygons):
    """Signed boundary chain: {(line, from, to): multiplicity} with maximal intervals, shells counter-clockwise."""
    steps = defaultdict(lambda: defaultdict(int))
    for polygon in polygons:
        for k, ring in enumerate(polygon):
            twice = _area2(ring)
            if twice == 0:
                continue
            sign = 1 if (twice > 0) == (k == 0) else -1
            for p, q in zip(ring, ring[1:]):
                if p != q:
                    line, forward = _line_of(p, q)
                    s = sign if forward else -sign
                    lo, hi = (p, q) if forward else (q, p)
                    steps[line][lo] += s
                    steps[line][hi] -= s
    out = {}
    for line, changes in steps.items():
        level, start = 0, None
        for at in sorted(changes):
            if changes[at] == 0:
                continue
            if level:
                out[line, start, at] = level
            level, start = level + changes[at], at
    return out


def maximal_segments(lines):
    """The union of the lines' segments as maximal intervals on their supporting lines, and the points of degenerate lines."""
    by, points = defaultdict(list), set()
    for path in lines:
        moved = False
        for p, q in zip(path, path[1:]):
            if p != q:
                moved = True
                line, forward = _line_of(p, q)
                by[line].append((p, q) if forward else (q, p))
        if not moved and path:
            points.add(path[0])
    out = set()
    for line, spans in by.items():
        spans.sort()
        lo, hi = spans[0]
        for a, b in spans[1:]:
            if a <= hi:
                hi = max(hi, b)
            else:
                out.add((line, lo, hi))
                lo, hi = a, b
        out.add((line, lo, hi))
    return out, points


def _on_segments(p, segments) -> bool:
    return any(a * p[0] + b * p[1] == c and lo <= p <= hi for (a, b, c), lo, hi in segments)


def symmetric_difference_is_null(a, b) -> bool:
    """Exact test that two lists of polygons (even-odd inside each, union between them) cover the same area."""
    sides = [[[e for ring in poly for e in zip(ring, ring[1:]) if e[0][0] != e[1][0]] for poly in side] for side in (a, b)]
    edges = [tuple(sorted(e)) for side in sides for poly in side for e in poly]
    cuts = {Fraction(p[0]) for e in edges for p in e}
    for i, (p, q) in enumerate(edges):
        for r, s in edges[:i]:
            if max(p[0], r[0]) >= min(q[0], s[0]):
                continue
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = Fraction((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0]), d)
                if 0 < t < 1:
                    cuts.add(p[0] + t * (q[0] - p[0]))
    xs = sorted(cuts)
    for lo, hi in zip(xs, xs[1:]):
        x = (lo + hi) / 2
        spans = []
        for side in sides:
            cover = []
            for poly in side:
                ys = sorted(e[0][1] + Fraction(e[1][1] - e[0][1]) * (x - e[0][0]) / (e[1][0] - e[0][0]) for e in poly if min(e[0][0], e[1][0]) < x < max(e[0][0], e[1][0]))
                cover += [(ys[i], ys[i + 1]) for i in range(0, len(ys) - 1, 2) if ys[i] < ys[i + 1]]
            cover.sort()
            merged = []
            for a0, a1 in cover:
                if merged and a0 <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], a1)
                else:
                    merged.append([a0, a1])
            spans.append(merged)
        if spans[0] != spans[1]:
            return False
    return True


def _overlapping(polygons) -> bool:
    """Whether rings cross themselves or one another, or parts overlap; only such regions need the area test."""
    edges = [tuple(sorted((p, q))) + (i,) for i, poly in enumerate(polygons) for ring in poly for p, q in zip(ring, ring[1:]) if p != q]
    edges.sort()

    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    live = []
    for p, q, i in edges:
        live = [e for e in live if e[1][0] >= p[0]]
        for r, s, j in live:
            if side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0:
                return True
        live.append((p, q, i))
    levels = chain(polygons)
    if any(abs(v) > 1 for v in levels.values()):
        return True
    if len(polygons) > 1:  # without crossings an overlap means that a part lies in another: test a vertex of each
        for i, poly in enumerate(polygons):
            for j, other in enumerate(polygons):
                if i != j and any(_inside(v, other) for v in poly[0]):
                    return True
    return False


def _inside(p, polygon) -> bool:
    """Strictly inside by even-odd; on the boundary is not inside."""
    odd = False
    for ring in polygon:
        for a, b in zip(ring, ring[1:]):
            d = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            if d == 0 and min(a, b) <= p <= max(a, b):
                return False
            if (a[1] > p[1]) != (b[1] > p[1]) and (d > 0) == (b[1] > a[1]):
                odd = not odd
    return odd


def same_point_set(left: Geom, right: Geom) -> bool:
    """left and right hold exact coordinates."""
    if left.empty or right.empty:
        return left.empty and right.empty
    a, b = _scale(left, right)
    if bool(a.polygons) != bool(b.polygons):
        return False
    if a.polygons and chain(a.polygons) != chain(b.polygons):
        if not (_overlapping(a.polygons) or _overlapping(b.polygons)) or not symmetric_difference_is_null(a.polygons, b.polygons):
            return False
    lines, dots = zip(*(maximal_segments(g.lines) for g in (a, b)))
    if a.polygons and (a.lines or b.lines or a.points or b.points):
        cover = [e for poly in a.polygons for ring in poly for e in zip(ring, ring[1:]) if e[0] != e[1]]
        bounds = maximal_segments([[p, q] for p, q in cover])[0]
        keep = lambda p: not (_on_segments(p, bounds) or any(_inside(p, poly) for poly in a.polygons))
        lines = [{s for s in x if keep(s[1]) or keep(s[2])} for x in lines]
    else:
        keep = lambda p: True
    if lines[0] != lines[1]:
        return False
    points = [{p for p in set(g.points) | d if keep(p) and not _on_segments(p, lines[0])} for g, d in zip((a, b), dots)]
    return points[0] == points[1]


def topologically_equal(left: str | None, right: str | None) -> bool:
    """Whether two WKT texts describe the same point set. Null equals only null; text that is no geometry equals only the same text."""
    if left is None or right is None or left == right:
        return left == right
    try:
        return same_point_set(parse(left, exact), parse(right, exact))
    except BadGeometry:
        return False
