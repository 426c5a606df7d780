"""Boolean operations on regions, with exact arithmetic.

All edges are cut where they meet, with rational crossings, so the pieces only share end points.  A piece bounds
the result if the wanted combination of even-odd memberships differs on its two sides; the bounding pieces, with
the inside to their left, are chained to rings, rings that touch themselves are split, and holes go to the least
shell around them.  Only the finished coordinates are rounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import pairwise

from geolith.geometry.wkt import Geom

Polygons = list[list[list[tuple]]]


def _plain(v):
    """A whole Fraction as int, which is far faster."""
    return v.numerator if v.denominator == 1 else v


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _pieces(edges: Sequence[tuple]) -> dict[tuple, dict[int, int]]:
    """{(p, q): {owner: times}} with p < q, where pieces share end points only. edges: (p, q, owner)."""
    cuts = [[p, q] for p, q, _ in edges]
    order = sorted(range(len(edges)), key=lambda i: min(edges[i][0][0], edges[i][1][0]))
    live: list[int] = []
    for i in order:
        p, q, _ = edges[i]
        left = min(p[0], q[0])
        live = [j for j in live if max(edges[j][0][0], edges[j][1][0]) >= left]
        lo, hi = min(p[1], q[1]), max(p[1], q[1])
        for j in live:
            r, s, _ = edges[j]
            if max(r[1], s[1]) < lo or min(r[1], s[1]) > hi:
                continue
            d1, d2 = _cross(p, q, r), _cross(p, q, s)
            if (d1 > 0 and d2 > 0) or (d1 < 0 and d2 < 0):
                continue
            d3, d4 = _cross(r, s, p), _cross(r, s, q)
            if (d3 > 0 and d4 > 0) or (d3 < 0 and d4 < 0):
                continue
            for c, d, (a, b), k in ((r, d1, (p, q), i), (s, d2, (p, q), i), (p, d3, (r, s), j), (q, d4, (r, s), j)):
                if d == 0 and min(a, b) <= c <= max(a, b):
                    cuts[k].append(c)
            if d1 and d2 and d3 and d4:
                t = Fraction(d3) / (d3 - d4)
                x = (_plain(p[0] + t * (q[0] - p[0])), _plain(p[1] + t * (q[1] - p[1])))
                cuts[i].append(x)
                cuts[j].append(x)
        live.append(i)
    out: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for (_, _, owner), points in zip(edges, cuts):
        for a, b in pairwise(sorted(set(points))):
            out[a, b][owner] += 1
    return out


def _bounding(pieces, wanted: Callable[[frozenset[int]], bool]):
    """Directed pieces with the wanted set to their left."""
    plain = [(p, q, owners) for (p, q), owners in pieces.items() if p[0] != q[0]]
    for (p, q), owners in pieces.items():
        odd = {o for o, n in owners.items() if n % 2}
        inside: dict[int, int] = defaultdict(int)
        x2, y2 = p[0] + q[0], p[1] + q[1]  # twice the middle, so nothing is divided
        if p[0] != q[0]:
            for a, b, others in plain:
                if 2 * a[0] <= x2 < 2 * b[0] and (a, b) != (p, q):
                    run = b[0] - a[0]
                    if 2 * a[1] * run + (b[1] - a[1]) * (x2 - 2 * a[0]) < y2 * run:
                        for o, n in others.items():
                            inside[o] += n
            right = {o for o, n in inside.items() if n % 2}  # below; p to q runs to the right, so below is to its right
            left = right ^ odd
        else:
            for (a, b), others in pieces.items():
                lo, hi = (a, b) if a[1] < b[1] else (b, a)
                if 2 * lo[1] <= y2 < 2 * hi[1] and (a, b) != (p, q):
                    rise = hi[1] - lo[1]
                    if 2 * lo[0] * rise + (hi[0] - lo[0]) * (y2 - 2 * lo[1]) < 2 * p[0] * rise:
                        for o, n in others.items():
                            inside[o] += n
            left = {o for o, n in inside.items() if n % 2}  # west; p to q runs up, so west is to its left
            right = left ^ odd
        a, b = wanted(frozenset(left)), wanted(frozenset(right))
        if a and not b:
            yield p, q
        elif b and not a:
            yield q, p


def _upright(edges: Sequence[tuple], wanted: Callable[[frozenset[int]], bool]):
    """What _bounding gives of the _pieces of edges that are all parallel to an axis, in the same order: memberships are those of the cells between all abscissae and ordinates."""
    xs, ys = sorted({p[0] for p, _, _ in edges}), sorted({p[1] for p, _, _ in edges})
    column, row = {x: k for k, x in enumerate(xs)}, {y: k for k, y in enumerate(ys)}
    cells = [[0] * (len(xs) + 1) for _ in range(len(ys) + 1)]  # the last column and row lie outside, on both ends
    cuts, level, upright = [], [], []
    for i, (p, q, owner) in enumerate(edges):
        cuts.append({p, q})
        if p[0] == q[0]:
            lo, hi = (p[1], q[1]) if p[1] < q[1] else (q[1], p[1])
            upright.append((i, p[0], lo, hi))
            k, bit = column[p[0]], 1 << owner
            for j in range(row[lo], row[hi]):
                cells[j][k] ^= bit
        else:
            level.append((i, p[1], *((p[0], q[0]) if p[0] < q[0] else (q[0], p[0]))))
    for line in cells:
        mask = 0
        for k, bits in enumerate(line):
            line[k] = mask = mask ^ bits
    for i, y, lo, hi in level:
        for j, x, lower, upper in upright:
            if lo <= x <= hi and lower <= y <= upper:
                cuts[i].add((x, y))
                cuts[j].add((x, y))
    for some in (level, upright):
        alike = defaultdict(list)
        for i, at, lo, hi in some:
            alike[at].append((i, lo, hi))
        for at, own in alike.items():
            for i, lo, hi in own if len(own) > 1 else ():
                for _, a, b in own:
                    for v in (a, b):
                        if lo < v < hi:
                            cuts[i].add((v, at) if some is level else (at, v))
    known: dict[int, bool] = {}

    def is_wanted(mask: int) -> bool:
        found = known.get(mask)
        if found is None:
            found = known[mask] = wanted(frozenset(o for o in range(mask.bit_length()) if mask >> o & 1))
        return found

    seen = set()
    for points in cuts:
        for p, q in pairwise(sorted(points)):
            if (p, q) in seen:
                continue
            seen.add((p, q))
            k, j = column[p[0]], row[p[1]]
            left, right = (cells[j][k - 1], cells[j][k]) if p[0] == q[0] else (cells[j][k], cells[j - 1][k])
            if left != right and (a := is_wanted(left)) != is_wanted(right):
                yield (p, q) if a else (q, p)


def _clockwise_from(back, candidates, at):
    """The first candidate met when the direction at -> back turns clockwise."""

    def half(d, ref):
        c = ref[0] * d[1] - ref[1] * d[0]
        return 0 if c < 0 or (c == 0 and ref[0] * d[0] + ref[1] * d[1] < 0) else 1

    ref = (back[0] - at[0], back[1] - at[1])
    best = None
    for c in candidates:
        d = (c[0] - at[0], c[1] - at[1])
        if best is not None:
            h, bh = half(d, ref), half(best[1], ref)
            turn = best[1][0] * d[1] - best[1][1] * d[0]
            if h > bh or (h == bh and turn <= 0):
                continue
        best = (c, d)
    return best[0]


def _rings(directed):
    out_of = defaultdict(list)
    for p, q in directed:
        out_of[p].append(q)
    rings = []
    while out_of:
        start = next(iter(out_of))
        path = [start]
        at = start
        where = {start: 0}
        while True:
            options = out_of[at]
            to = options[0] if len(options) == 1 or len(path) < 2 else _clockwise_from(path[-2], options, at)
            options.remove(to)
            if not options:
                del out_of[at]
            if to in where:  # a closed part splits off, so no ring touches itself
                k = where[to]
                ring = [*path[k:], to]
                rings.append(ring)
                for v in path[k + 1 :]:
                    del where[v]
                path = path[: k + 1]
                at = to
                if k == 0 and (at not in out_of or not out_of[at]):
                    break
                if at not in out_of:
                    break
            else:
                where[to] = len(path)
                path.append(to)
                at = to
    return rings


def ring_area(ring):
    """Signed area, exact for exact coordinates."""
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in pairwise(ring))
    return Fraction(twice) / 2 if isinstance(twice, int) else twice / 2


def _contains(ring, p) -> bool:
    odd = False
    for a, b in pairwise(ring):
        if (a[1] > p[1]) != (b[1] > p[1]):
            d = _cross(a, b, p)
            if (d > 0) == (b[1] > a[1]):
                odd = not odd
    return odd


def _straightened(ring, keep):
    """The ring without the cuts at which it does not turn; vertices of the input stay."""
    body = ring[:-1]
    n = len(body)
    left = [v for i, v in enumerate(body) if v in keep or _cross(body[i - 1], v, body[(i + 1) % n]) != 0]
    return [*left, left[0]] if len(left) >= 3 else ring


def _unscaled(v, scale: int) -> float:
    return v / scale if isinstance(v, int) else float(v / scale)


def combine(regions: Sequence[Polygons], wanted: Callable[[frozenset[int]], bool]) -> Polygons:
    """The set of points whose memberships (indices of the regions they are in, by even-odd) are wanted.

    wanted(frozenset()) must be false, the result being bounded.
    """
    floats = [[[[(float(c[0]), float(c[1])) for c in ring] for ring in polygon] for polygon in polygons] for polygons in regions]
    if all(x.is_integer() and y.is_integer() for polygons in floats for polygon in polygons for ring in polygon for x, y in ring):
        scale = 1
    else:
        scale = max((v.as_integer_ratio()[1] for polygons in floats for polygon in polygons for ring in polygon for c in ring for v in c), default=1)  # powers of two
    edges, keep = [], set()
    for i, polygons in enumerate(floats):
        for polygon in polygons:
            for ring in polygon:
                exact = [(int(x), int(y)) for x, y in ring] if scale == 1 else [tuple(n * (scale // d) for n, d in (x.as_integer_ratio(), y.as_integer_ratio())) for x, y in ring]
                keep.update(exact)
                edges += [(p, q, i) for p, q in pairwise(exact) if p != q]
    if not edges:
        return []
    if all(p[0] == q[0] or p[1] == q[1] for p, q, _ in edges):
        bounding = _upright(edges, wanted)
    else:
        bounding = _bounding(_pieces(edges), wanted)
    rings = [_straightened(r, keep) for r in _rings(bounding)]
    sized = sorted(((ring_area(r), r) for r in rings), key=lambda x: abs(x[0]))
    shells = [(a, r, [r]) for a, r in sized if a > 0]
    for a, hole in sized:
        if a < 0:
            probe = next((v for v in hole if True), None)
            for size, shell, polygon in shells:
                points = [v for v in hole if v not in shell] or [(Fraction(hole[0][0] + hole[1][0]) / 2, Fraction(hole[0][1] + hole[1][1]) / 2)]
                if size > -a and probe is not None and _contains(shell, points[0]):
                    polygon.append(hole)
                    break
    return [[[(_unscaled(x, scale), _unscaled(y, scale)) for x, y in r] for r in polygon] for _, _, polygon in shells]


def intersection(a: Polygons, b: Polygons) -> Polygons:
    return combine([a, b], lambda s: len(s) == 2)


def difference(a: Polygons, *others: Polygons) -> Polygons:
    return combine([a, *others], lambda s: s == frozenset({0}))


def symmetric_difference(a: Polygons, b: Polygons) -> Polygons:
    return combine([a, b], lambda s: len(s) == 1)


def union(regions: Sequence[Polygons]) -> Polygons:
    """The union, in a balanced tree so that inner edges vanish early."""
    regions = [r for r in regions if r]
    if not regions:
        return []
    while len(regions) > 1:
        regions = [combine(regions[i : i + 4], bool) for i in range(0, len(regions), 4)]
    return regions[0]


def make_valid(polygons: Polygons) -> Polygons:
    """The even-odd interior as valid polygons."""
    return combine([polygons], bool)


def region(polygons: Polygons) -> Geom:
    """The polygons as the simplest geometry."""
    return Geom("POLYGON", polygons=polygons) if len(polygons) <= 1 else Geom("MULTIPOLYGON", polygons=polygons)


def area_of(polygons: Polygons) -> float:
    return float(sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons))
