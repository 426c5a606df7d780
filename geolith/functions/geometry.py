"""Geometry scalars as column expressions over coordinate arrays, all in the JVM.

A path is an array of structs with the fields x and y. A null path gives null, an empty one 0 or null as stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(path: Column) -> Column:
    """Indices 1 .. n - 1 of the path's segments; none for fewer than two vertices."""
    return F.when(F.size(path) >= 2, F.sequence(F.lit(1), F.size(path) - 1)).otherwise(F.array().cast("array<int>"))


def _sum(path: Column, of) -> Column:
    step = lambda acc, i: acc + of(F.element_at(path, i), F.element_at(path, i + 1))
    return F.aggregate(_steps(path), F.lit(0.0), step)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    return _sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(path: Column) -> Column:
    """Length of a path; the perimeter of a closed ring."""
    return _sum(path, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter squared; 0 without perimeter."""
    n = length(ring)
    return F.when(n > 0, 4 * math.pi * area(ring) / (n * n)).otherwise(0.0)


def measure(path: Column) -> Column:
    """Area if positive, else length."""
    return F.when(area(path) > 0, area(path)).otherwise(length(path))


def bounds(path: Column) -> Column:
    """Struct x0, y0, x1, y1; nulls for an empty path."""
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def vertex_count(path: Column) -> Column:
    return F.size(path)


def is_closed(path: Column) -> Column:
    return F.coalesce((F.size(path) > 2) & (F.element_at(path, 1) == F.element_at(path, -1)), F.lit(False))


def has_repeated_vertex(path: Column) -> Column:
    """Whether a vertex occurs twice anywhere; the closing vertex of a path of more than two does not count."""
    return F.size(F.array_distinct(path)) < F.size(path) - F.when(is_closed(path), 1).otherwise(0)


def without_repeats(path: Column) -> Column:
    """The path without vertices equal to the one before."""
    return F.filter(path, lambda p, i: (i == 0) | (p != F.get(path, i - 1)))


def centroid(path: Column) -> Column:
    """Struct x, y: centre of a path's length; of its vertices where it has none."""
    n = length(path)
    mean = lambda c: _sum(path, lambda p, q: (p[c] + q[c]) / 2 * F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))) / n
    flat = lambda c: F.aggregate(path, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(path)
    return F.struct(*[F.when(n > 0, mean(c)).otherwise(flat(c)).alias(c) for c in "xy"])


def envelopes_meet(a: str, b: str, tolerance: float = 0.0) -> Column:
    """Whether two envelopes (structs named a and b), the first grown by the tolerance, share a point."""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (c(a, "x0") - tolerance <= c(b, "x1")) & (c(b, "x0") <= c(a, "x1") + tolerance) & (c(a, "y0") - tolerance <= c(b, "y1")) & (c(b, "y0") <= c(a, "y1") + tolerance)


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The polygon of an envelope as WKT."""
    s = lambda c: c.cast("double").cast("string")
    at = lambda x, y: F.concat(s(x), F.lit(" "), s(y))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)), F.lit("))"))


def line_wkt(path: Column) -> Column:
    """A path as WKT; a path of no vertices is empty."""
    text = F.array_join(F.transform(path, lambda p: F.concat(p["x"].cast("double").cast("string"), F.lit(" "), p["y"].cast("double").cast("string"))), ", ")
    return F.when(F.size(path) > 0, F.concat(F.lit("LINESTRING ("), text, F.lit(")"))).otherwise("LINESTRING EMPTY")
