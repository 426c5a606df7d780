"""Repair of single geometries and of the parts of coverages."""

from __future__ import annotations

import math
from dataclasses import dataclass

from geolith.geometry import overlay, wkt
from geolith.geometry.measure import Shape, hausdorff
from geolith.geometry.validity import invalid_reason, issues
from geolith.geometry.wkt import Geom

AREA_EPSILON = 1e-12


@dataclass(frozen=True)
class RepairConfig:
    """What may be repaired, and how far a repair may go."""

    remove_duplicate_vertices: bool = True
    duplicate_vertex_tolerance: float = 0.0
    fix_invalid: bool = True
    remove_slivers: bool = True
    sliver_area_threshold: float = 1e-9
    sliver_thinness_threshold: float = 1e-3
    resolve_overlaps: bool = True
    fill_gaps: bool = True
    gap_area_threshold: float = 1e-6
    max_shape_shift: float | None = None
    max_relative_area_change: float | None = None

    def __post_init__(self):
        for name, value in self.__dict__.items():
            if isinstance(value, float) and not (value >= 0):
                raise ValueError(f"{name} must not be negative")


def _thin(path, tolerance: float, closed: bool):
    out = [path[0]]
    for c in path[1:]:
        if math.dist(c[:2], out[-1][:2]) > tolerance:
            out.append(c)
    if closed and tuple(out[-1][:2]) != tuple(path[-1][:2]):
        out[-1 if len(out) > 3 else len(out) :] = [path[-1]]
    elif not closed and len(out) > 1 and tuple(out[-1][:2]) != tuple(path[-1][:2]):
        out[-1] = path[-1]
    return out if len(out) >= (4 if closed else 2) else list(path)


def remove_repeated_points(g: Geom, tolerance: float = 0.0) -> Geom:
    """The geometry without consecutive vertices within tolerance; parts that would collapse stay as they are."""
    if g.members:
        return wkt.collect(remove_repeated_points(m, tolerance) for m in g.members)
    points = list(dict.fromkeys(map(tuple, g.points)))
    return Geom(g.kind, points, [_thin(x, tolerance, False) for x in g.lines], [[_thin(r, tolerance, True) for r in p] for p in g.polygons])


def vertex_count(g: Geom) -> int:
    return sum(1 for _ in g.coords())


def area(g: Geom) -> float:
    return Shape(g).area if g.polygons else 0.0


def made_valid(g: Geom) -> Geom:
    """Polygons become the even-odd inside of their rings; lines of one point become points."""
    if g.members:
        return wkt.collect(made_valid(m) for m in g.members)
    if g.polygons:
        parts = [overlay.make_valid([p]) for p in g.polygons]
        return overlay.region(overlay.union(parts) if len(parts) > 1 else parts[0])
    if g.lines:
        good = [x for x in g.lines if len({tuple(c[:2]) for c in x}) > 1]
        dots = [x[0] for x in g.lines if len({tuple(c[:2]) for c in x}) == 1]
        if not dots:
            return g
        if not good:
            return Geom("POINT" if len(dots) == 1 else "MULTIPOINT", points=dots)
        lines = Geom("LINESTRING" if len(good) == 1 else "MULTILINESTRING", lines=good)
        return wkt.collect([lines, *[Geom("POINT", points=[d]) for d in dots]])
    return g


def is_sliver(polygon, config: RepairConfig) -> bool:
    s = Shape(Geom("POLYGON", polygons=[polygon]))
    if s.area < config.sliver_area_threshold or s.length <= 0:
        return True
    return 4 * math.pi * s.area / s.length**2 < config.sliver_thinness_threshold


def drop_slivers(g: Geom, config: RepairConfig) -> tuple[Geom, int]:
    """The geometry without its sliver parts, and how many there were; it never loses everything."""
    if not g.polygons:
        return g, 0
    kept = [p for p in g.polygons if not is_sliver(p, config)]
    gone = len(g.polygons) - len(kept)
    if gone == 0 or (not kept and not g.lines and not g.points):
        return g, 0
    if g.kind != "GEOMETRYCOLLECTION":
        return overlay.region(kept), gone
    parts = [Geom("POINT", points=[p]) for p in g.points] + [Geom("LINESTRING", lines=[x]) for x in g.lines] + [Geom("POLYGON", polygons=[p]) for p in kept]
    return (parts[0] if len(parts) == 1 else wkt.collect(parts)), gone


def repair(g: Geom, config: RepairConfig) -> tuple[Geom, list[tuple[str, str, str]]]:
    """The repaired geometry and the actions (issue_type, strategy, detail) taken, in order."""
    actions, current = [], g
    if config.remove_duplicate_vertices:
        thinner = remove_repeated_points(current, config.duplicate_vertex_tolerance)
        if vertex_count(thinner) < vertex_count(current):
            actions.append(("duplicate_vertex", "remove_repeated_points", "Dropped consecutive vertices at one place."))
            current = thinner
    if config.fix_invalid and (reason := invalid_reason(current)):
        kinds = {i for i, _ in issues(current)}
        named = [a for a, i in (("invalid_ring", "ring_error"), ("self_intersection", "self_intersection")) if i in kinds]
        actions += [(a, "make_valid", reason) for a in named or ["self_intersection"]]
        current = made_valid(current)
    if config.remove_slivers:
        current, gone = drop_slivers(current, config)
        if gone:
            actions.append(("sliver_polygon", "drop_sliver_parts", f"Dropped {gone} part(s) below the sliver limits."))
    return current, actions


def shift(before: Geom, after: Geom) -> float:
    return 0.0 if before.empty or after.empty else hausdorff(Shape(before), Shape(after))


def polygonal(g: Geom) -> bool:
    return g.kind in ("POLYGON", "MULTIPOLYGON") and not g.empty


def unsafe(before: Geom, after: Geom, config: RepairConfig, known: tuple[float, float, float] | None = None) -> str | None:
    """Why a candidate may not replace a geometry; None if it may. known: both areas and the shift, where they are at hand."""
    if invalid_reason(after):
        return "invalid candidate"
    if not before.empty and after.empty:
        return "everything erased"
    if polygonal(before) and not polygonal(after):
        return "no polygon any more"
    if config.max_shape_shift is not None and (known[2] if known else shift(before, after)) > config.max_shape_shift:
        return "shape shift over limit"
    if config.max_relative_area_change is not None:
        old, new = known[:2] if known else (area(before), area(after))
        if old > AREA_EPSILON and abs(new - old) / old > config.max_relative_area_change:
            return "area change over limit"
    return None


def snapped(g: Geom, references, tolerance: float) -> Geom:
    """The geometry with vertices moved to the nearest reference vertex within tolerance, and reference vertices let into edges they are near.

    references: coordinate sequences.
    """
    targets = list(dict.fromkeys((float(c[0]), float(c[1])) for path in references for c in path))

    def nearest(p):
        best = min(targets, key=lambda t: (math.dist(t, p), t), default=None)
        return best if best is not None and math.dist(best, p) <= tolerance else p

    def path(coords, closed):
        moved = [nearest(tuple(c[:2])) for c in coords]
        if closed:
            moved[-1] = moved[0]
        for t in targets:
            if t in moved:
                continue
            near = []
            for i, (a, b) in enumerate(zip(moved, moved[1:])):
                n2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                if n2:
                    u = ((t[0] - a[0]) * (b[0] - a[0]) + (t[1] - a[1]) * (b[1] - a[1])) / n2
                    d = math.dist(t, (a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])))
                    if 0 < u < 1 and d <= tolerance:
                        near.append((d, i))
            if near:
                moved.insert(min(near)[1] + 1, t)
        return [c for i, c in enumerate(moved) if i == 0 or c != moved[i - 1]]

    return Geom(g.kind, g.points, [path(x, False) for x in g.lines], [[path(r, True) for r in p] for p in g.polygons])
