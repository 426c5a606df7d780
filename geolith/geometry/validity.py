"""Validity and simplicity of geometries, with the first defect as reason.

Reasons name the defect classes of the simple-features standard. Orientation tests are exact where floats could
not decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, pairwise

from geolith.geometry.wkt import Geom

# Reasons that concern the rings of a polygon.
RING_REASONS = ("Ring Self-intersection", "Too few points in geometry component", "Hole lies outside shell", "Holes are nested", "Nested shells")
SELF_INTERSECTION = "Self-intersection"
MOST_LOCATIONS = 20


def turn(o, a, b) -> int:
    """Sign of the turn o, a, b; exact."""
    l, r = (a[0] - o[0]) * (b[1] - o[1]), (a[1] - o[1]) * (b[0] - o[0])
    d = l - r
    if abs(d) > 1e-14 * (abs(l) + abs(r)):
        return 1 if d > 0 else -1
    f = [[Fraction(v) for v in p[:2]] for p in (o, a, b)]
    d = (f[1][0] - f[0][0]) * (f[2][1] - f[0][1]) - (f[1][1] - f[0][1]) * (f[2][0] - f[0][0])
    return (d > 0) - (d < 0)


def _within(p, a, b) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(p, q, r, s):
    """How two segments meet: None, ("cross", point), ("overlap", point) or ("touch", point)."""
    if max(p[0], q[0]) < min(r[0], s[0]) or max(r[0], s[0]) < min(p[0], q[0]) or max(p[1], q[1]) < min(r[1], s[1]) or max(r[1], s[1]) < min(p[1], q[1]):
        return None
    a, b = turn(p, q, r), turn(p, q, s)
    if a * b > 0:
        return None
    c, d = turn(r, s, p), turn(r, s, q)
    if c * d > 0:
        return None
    if a == b == c == d == 0:
        shared = sorted({v for v in (p, q) if _within(v, r, s)} | {v for v in (r, s) if _within(v, p, q)})
        return None if not shared else ("overlap", shared[0]) if len(shared) > 1 else ("touch", shared[0])
    if a and b and c and d:
        x = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / ((q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0]))
        return "cross", (p[0] + x * (q[0] - p[0]), p[1] + x * (q[1] - p[1]))
    for v, k, (e, f) in ((r, a, (p, q)), (s, b, (p, q)), (p, c, (r, s)), (q, d, (r, s))):
        if k == 0 and _within(v, e, f):
            return "touch", v
    return None


def _flat(path):
    out = [(float(c[0]), float(c[1])) for c in path]
    return [v for i, v in enumerate(out) if i == 0 or v != out[i - 1]]


def position(p, ring) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    odd = False
    for a, b in pairwise(ring):
        if turn(a, b, p) == 0 and _within(p, a, b):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and (turn(a, b, p) > 0) == (b[1] > a[1]):
            odd = not odd
    return 1 if odd else -1


def _meetings(segments):
    """Pairs of segments that meet, by a sweep over x. segments: (p, q, path, k)."""
    order = sorted(segments, key=lambda s: min(s[0][0], s[1][0]))
    live = []
    for s in order:
        left = min(s[0][0], s[1][0])
        live = [o for o in live if max(o[0][0], o[1][0]) >= left]
        for o in live:
            if found := meet(o[0], o[1], s[0], s[1]):
                yield o, s, found
        live.append(s)


def _side(ring, other) -> tuple[bool, bool]:
    """Whether vertices or edge middles of ring lie inside and outside of other."""
    spots = [position(v, other) for v in ring[:-1]]
    if all(k == 0 for k in spots):
        spots = [position(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), other) for a, b in pairwise(ring)]
    return 1 in spots, -1 in spots


def _at(reason, p) -> str:
    return f"{reason}[{p[0]:.12g} {p[1]:.12g}]"


def _simple_upright(ring) -> bool:
    """Whether a closed ring without repeats has sides parallel to the axes that meet their neighbours alone, at their ends."""
    n = len(ring) - 1
    sides = []
    for (a, b), (c, d) in pairwise(ring):
        if a != c and b != d:
            return False
        sides.append((a, b, c, d) if a < c or b < d else (c, d, a, b))
    for k in range(n):
        (a, b), (c, d), (e, f) = ring[k - 1] if k else ring[n - 1], ring[k], ring[k + 1]
        if (c - a) * (e - c) < 0 or (d - b) * (f - d) < 0:  # back over itself
            return False
        x0, y0, x1, y1 = sides[k]
        for u0, v0, u1, v1 in sides[k + 2 : n - (k == 0)]:
            if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1:
                return False
    return n >= 4


def _polygons_reason(polygons) -> str | None:
    if len(polygons) == 1 and len(polygons[0]) == 1 and 5 <= len(polygons[0][0]) <= 64:
        flat = _flat(polygons[0][0])
        if len(flat) >= 5 and flat[0] == flat[-1] and _simple_upright(flat):
            return None
    rings, owner = [], []
    for i, polygon in enumerate(polygons):
        for ring in polygon:
            flat = _flat(ring)
            if len(flat) < 4 or flat[0] != flat[-1]:
                return _at("Too few points in geometry component", flat[0])
            rings.append(flat)
            owner.append(i)
    segments = [(p, q, i, k) for i, ring in enumerate(rings) for k, (p, q) in enumerate(pairwise(ring))]
    touches: dict[tuple[int, int], set] = {}
    ring_touch = None
    for (p, q, i, k), (r, s, j, m), (how, at) in _meetings(segments):
        if how in ("cross", "overlap"):
            return _at(SELF_INTERSECTION, at)
        if i != j:
            touches.setdefault((min(i, j), max(i, j)), set()).add(at)
        elif abs(k - m) not in (1, len(rings[i]) - 2):
            ring_touch = ring_touch or at
    if ring_touch:
        return _at("Ring Self-intersection", ring_touch)
    for (i, j), points in touches.items():  # rings that cross at a vertex
        inside, outside = _side(rings[j], rings[i])
        if inside and outside:
            return _at(SELF_INTERSECTION, min(points))
    first = {}
    for i, o in enumerate(owner):
        first.setdefault(o, i)
    for i, o in enumerate(owner):
        if i != first[o] and _side(rings[i], rings[first[o]])[1]:
            return _at("Hole lies outside shell", rings[i][0])
    for o, shell in first.items():
        holes = [i for i, x in enumerate(owner) if x == o and i != shell]
        for i, j in combinations(holes, 2):
            if _side(rings[i], rings[j])[0] or _side(rings[j], rings[i])[0]:
                return _at("Holes are nested", rings[j][0])
    for o, u in combinations(first, 2):
        for a, b in ((o, u), (u, o)):
            if _side(rings[first[a]], rings[first[b]])[0]:
                holes = [rings[i] for i, x in enumerate(owner) if x == b and i != first[b]]
                if not any(not _side(rings[first[a]], h)[1] for h in holes):
                    return _at("Nested shells", rings[first[a]][0])
    root = list(range(len(rings)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen: dict = {}
    for (i, j), points in sorted(touches.items()):
        if owner[i] != owner[j]:
            continue
        for at in sorted(points):
            group = seen.setdefault((owner[i], at), [])
            for x in (i, j):
                if x in group:
                    continue
                if group and find(x) in {find(y) for y in group}:
                    return _at("Interior is disconnected", at)
                if group:
                    root[find(x)] = find(group[0])
                group.append(x)
    return None


def invalid_reason(g: Geom) -> str | None:
    """None for a valid geometry, else the first defect with its place."""
    for c in g.coords():
        if not (math.isfinite(c[0]) and math.isfinite(c[1])):
            return f"Invalid Coordinate[{c[0]} {c[1]}]"
    if g.members:
        return next((r for m in g.members if (r := invalid_reason(m))), None)
    for line in g.lines:
        if len(_flat(line)) < 2:
            return _at("Too few points in geometry component", line[0])
    return _polygons_reason(g.polygons) if g.polygons else None


def lines_simple(lines) -> bool:
    """Whether lines neither cross themselves nor meet one another elsewhere than at ends of both."""
    flats = [f for f in map(_flat, lines) if len(f) > 1]
    segments = [(p, q, i, k) for i, f in enumerate(flats) for k, (p, q) in enumerate(pairwise(f))]
    for (p, q, i, k), (r, s, j, m), (how, at) in _meetings(segments):
        if how in ("cross", "overlap"):
            return False
        if i == j:
            last = len(flats[i]) - 2
            if abs(k - m) == 1 or (flats[i][0] == flats[i][-1] and {k, m} == {0, last} and at == flats[i][0]):
                continue
            return False
        if at not in (flats[i][0], flats[i][-1]) or at not in (flats[j][0], flats[j][-1]):
            return False
    return True


def _lines_of(g: Geom):
    return [x for m in g.members for x in _lines_of(m)] if g.members else g.lines


def _polygonal(g: Geom) -> Iterator[Geom]:
    if g.members:
        for m in g.members:
            yield from _polygonal(m)
    elif g.polygons:
        yield g
        if len(g.polygons) > 1:
            for p in g.polygons:
                yield Geom("POLYGON", polygons=[p])


def _sequences(g: Geom, path: str = "geometry"):
    """(path, coordinates, closed) of every part, named by its place; members of a multipoint count together."""
    kind = g.kind
    if g.members:
        for i, m in enumerate(g.members):
            yield from _sequences(m, f"{path}.geoms[{i}]")
    elif kind in ("POINT", "MULTIPOINT"):
        if g.points:
            yield path, g.points, False
    elif kind == "MULTILINESTRING":
        for i, x in enumerate(g.lines):
            yield f"{path}.geoms[{i}]", x, tuple(x[0]) == tuple(x[-1])
    elif kind in ("LINESTRING", "LINEARRING"):
        for x in g.lines:
            yield path, x, tuple(x[0]) == tuple(x[-1])
    else:
        for i, p in enumerate(g.polygons):
            at = f"{path}.geoms[{i}]" if kind == "MULTIPOLYGON" else path
            yield f"{at}.exterior", p[0], True
            for k, h in enumerate(p[1:]):
                yield f"{at}.interiors[{k}]", h, True


def _repeats(path, closed: bool) -> bool:
    seen = [tuple(map(float, c)) for c in path]
    if closed and len(seen) > 2 and seen[0] == seen[-1]:
        seen = seen[:-1]
    return len(set(seen)) < len(seen)


def issues(g: Geom | None) -> list[tuple[str, str]]:
    """(issue_type, message) of a geometry in the fixed order of checks; none for a sound one."""
    if g is None:
        return [("empty_geometry", "Geometry is missing.")]
    found = []
    if g.empty:
        found.append(("empty_geometry", "Geometry is empty."))
    reason = invalid_reason(g)
    if reason:
        found.append(("invalid_geometry", f"Not valid: {reason}."))
    ring = crossing = None
    if reason and not reason.startswith("Invalid Coordinate"):
        for part in _polygonal(g):
            why = invalid_reason(part)
            if why and ring is None and why.startswith(RING_REASONS):
                ring = why
            if why and crossing is None and SELF_INTERSECTION.lower() in why.lower():
                crossing = why
    if ring:
        found.append(("ring_error", f"Ring error: {ring}."))
    lines = [x for x in _lines_of(g) if invalid_reason(Geom("LINESTRING", lines=[x])) is None]
    if crossing or (lines and not lines_simple(lines)):
        found.append(("self_intersection", f"Self-intersection: {crossing or 'linework is not simple'}."))
    places = [path for path, coords, closed in _sequences(g) if _repeats(coords, closed)]
    if places:
        more = ", and additional locations" if len(places) > MOST_LOCATIONS else ""
        found.append(("duplicate_vertex", f"Repeated vertex in: {', '.join(places[:MOST_LOCATIONS])}{more}."))
    return found
