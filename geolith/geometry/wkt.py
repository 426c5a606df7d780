"""Well-known text.

A parsed geometry is a :class:`Geom`: flat lists of points, lines and polygons, whatever the nesting of the
text was, plus the written type.  Coordinates are passed through ``number``: ``float`` for measures, or
:func:`exact` for predicates that must not round.
"""

from __future__ import annotations

import re
from decimal import Decimal

_HEAD = re.compile(r"\s*(?:SRID\s*=\s*\d+\s*;)?\s*([A-Za-z]+?)\s*(ZM|Z|M)?\s*(?=\(|EMPTY|\s|$)", re.I)
_LEAF = re.compile(r"\(([^()]*)\)")
_POLYGON = re.compile(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)|EMPTY", re.I)
_LINE = re.compile(r"\(([^()]*)\)|EMPTY", re.I)
TYPES = ("POINT", "LINESTRING", "LINEARRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


MOST_DIGITS = 400


class BadGeometry(ValueError):
    """The text or bytes do not describe a geometry."""


class Geom:
    """points: [(x, y, ...)], lines: [[(x, y, ...)]], polygons: [[shell, hole, ...]]; members: parts of a collection."""

    __slots__ = ("kind", "points", "lines", "polygons", "members")

    def __init__(self, kind, points=(), lines=(), polygons=(), members=()):
        self.kind, self.points, self.lines, self.polygons, self.members = kind, list(points), list(lines), list(polygons), list(members)

    @property
    def empty(self) -> bool:
        return not (self.points or self.lines or self.polygons)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0 if self.points else -1

    def rings(self):
        for polygon in self.polygons:
            yield from polygon

    def paths(self):
        """Every coordinate sequence: points singly, then lines, then rings."""
        for p in self.points:
            yield [p]
        yield from self.lines
        yield from self.rings()

    def coords(self):
        for path in self.paths():
            yield from path


def exact(text: str) -> tuple[int, int]:
    """The decimal number m * 10**e as its only pair (m, e) with e <= 0 and no trailing zero of a fraction in m."""
    if "e" in text or "E" in text:
        value = Decimal(text)
        if not value.is_finite() or abs(value.adjusted()) > MOST_DIGITS or len(text) > MOST_DIGITS:
            raise BadGeometry(f"out of all proportion: {text[:40]!r}")
        text = format(value, "f")
    whole, point, part = text.partition(".")
    part = part.rstrip("0")
    if not part:
        return int(whole) if whole not in ("", "-", "+") or not point else 0, 0
    if len(part) > MOST_DIGITS:
        raise BadGeometry(f"out of all proportion: {text[:40]!r}")
    return int(whole + part), -len(part)


def _coords(body: str, number, least: int, closed: bool = False):
    out = []
    for part in body.split(","):
        values = part.split()
        if not 2 <= len(values) <= 4:
            raise BadGeometry(f"a coordinate needs two to four numbers: {part!r}")
        try:
            out.append(tuple(map(number, values)))
        except (ValueError, ArithmeticError) as error:
            raise BadGeometry(f"no number in {part!r}") from error
    if len(out) < least:
        raise BadGeometry("too few points")
    if closed and out[0][:2] != out[-1][:2]:
        raise BadGeometry("the ring is not closed")
    return out


def _polygon(body: str, number):
    return [_coords(m, number, 4, closed=True) for m in _LEAF.findall(body)]


def _split_members(body: str):
    depth, start = 0, 0
    for i, c in enumerate(body):
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            yield body[start:i]
            start = i + 1
    yield body[start:]


def parse(text: str, number=float) -> Geom:
    """Parse WKT. Raises BadGeometry for anything that is not a geometry (unclosed rings and short rings included)."""
    head = _HEAD.match(text)
    kind = head.group(1).upper() if head else ""
    if kind.endswith("EMPTY") and kind != "EMPTY":
        kind = kind[:-5]
    for suffix in ("ZM", "Z", "M"):
        if kind not in TYPES and kind.endswith(suffix) and kind[: -len(suffix)] in TYPES:
            kind = kind[: -len(suffix)]
    if kind not in TYPES:
        raise BadGeometry(f"unknown geometry type in {text[:40]!r}")
    rest = text[head.end(1) :] if not head.group(1).upper().endswith("EMPTY") else "EMPTY"
    if "(" not in rest:
        if "EMPTY" in rest.upper():
            return Geom(kind)
        raise BadGeometry("no coordinates")
    rest = rest[rest.index("(") :].rstrip()
    if rest.count("(") != rest.count(")") or not rest.endswith(")"):
        raise BadGeometry("unbalanced brackets")
    inner = rest[1:-1]
    if kind == "POINT":
        points = _coords(inner, number, 1)
        if len(points) != 1:
            raise BadGeometry("a point has one coordinate")
        return Geom(kind, points=points)
    if kind in ("LINESTRING", "LINEARRING"):
        return Geom(kind, lines=[_coords(inner, number, 2)])
    if kind == "POLYGON":
        return Geom(kind, polygons=[_polygon(inner, number)] if "(" in inner else [])
    if kind == "MULTIPOINT":
        flat = re.sub(r"[()]|EMPTY", " ", inner, flags=re.I)
        parts = [p for p in flat.split(",") if p.strip()]
        return Geom(kind, points=_coords(",".join(parts), number, 1) if parts else [])
    if kind == "MULTILINESTRING":
        return Geom(kind, lines=[_coords(m.group(1), number, 2) for m in _LINE.finditer(inner) if m.group(1) is not None])
    if kind == "MULTIPOLYGON":
        return Geom(kind, polygons=[_polygon(m.group(1), number) for m in _POLYGON.finditer(inner) if m.group(1) is not None])
    members = [parse(part.strip(), number) for part in _split_members(inner)]
    return collect(members)


def collect(members) -> Geom:
    members = list(members)
    return Geom(
        "GEOMETRYCOLLECTION",
        [p for m in members for p in m.points],
        [x for m in members for x in m.lines],
        [x for m in members for x in m.polygons],
        members,
    )


def _num(v) -> str:
    v = float(v)
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def _seq(path) -> str:
    return "(" + ", ".join(" ".join(_num(v) for v in c) for c in path) + ")"


def dump(g: Geom) -> str:
    """Full-precision WKT."""
    if g.kind == "GEOMETRYCOLLECTION":
        return "GEOMETRYCOLLECTION " + ("(" + ", ".join(map(dump, g.members)) + ")" if g.members else "EMPTY")
    if g.empty:
        return f"{g.kind} EMPTY"
    if g.kind == "POINT":
        return f"POINT {_seq(g.points)}"
    if g.kind == "MULTIPOINT":
        return "MULTIPOINT (" + ", ".join(_seq([p]) for p in g.points) + ")"
    if g.kind in ("LINESTRING", "LINEARRING"):
        return f"{g.kind} {_seq(g.lines[0])}"
    if g.kind == "MULTILINESTRING":
        return "MULTILINESTRING (" + ", ".join(map(_seq, g.lines)) + ")"
    polygon = lambda rings: "(" + ", ".join(map(_seq, rings)) + ")"
    if g.kind == "POLYGON":
        return "POLYGON " + polygon(g.polygons[0])
    return "MULTIPOLYGON (" + ", ".join(map(polygon, g.polygons)) + ")"
