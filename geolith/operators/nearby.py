"""Points near other points, and the regions that contain points.

Regions: a trapezoidal decomposition. Each polygon's boundary is cut into vertical slabs at its vertices and at the
borders of the tiles, and the edges over a slab are ordered by height.  A tile holds, for each polygon, its slabs in
order, and of each slab only the edges that reach into the tile and the number of those below it.  A point meets one row
for each polygon of its tile; its slab and then its place among the slab's edges are found by binary search, in
generated code, and the number of edges below it tells whether it is inside.

Points: bands of latitude, twice as high as the distance, cut into cells twice as wide as the distance reaches at the
band's latitude, with wrap-around.  A point is kept in its own cell, and in the neighbours to the west and south where
it is within reach of them, so each pair is met once; cells are keys of an equi-join, so a crowded one can be split.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.geometry import wkt
from geolith.storage import Scratch

EARTH_RADIUS_M = 6_371_008.8
TILE_DEGREES = 1.0
SLABS = "region bigint, part int, tx bigint, ty bigint, starts array<double>, slabs array<struct<x1:double,below:int,edges:array<struct<ax:double,ay:double,bx:double,by:double>>,walls:array<struct<lo:double,hi:double>>>>"


def slabs_of(polygon):
    """Slabs (x0, x1, edges, walls) of one polygon; edges from left to right, ordered by height over the slab, holes among them.

    walls: the spans of the boundary that lie on the slab's left side, upright edges and vertices.

    Edges that cross (an invalid ring) would not keep one order; slabs are cut there too.
    """
    e = [tuple(sorted((tuple(p[:2]), tuple(q[:2])))) for ring in polygon for p, q in zip(ring, ring[1:]) if p[0] != q[0]]
    if not e:
        return
    walls: dict[float, set] = {}
    for ring in polygon:
        for p, q in zip(ring, ring[1:]):
            walls.setdefault(float(p[0]), set()).add((float(p[1]), float(p[1])))
            if p[0] == q[0]:
                walls[float(p[0])].add((float(min(p[1], q[1])), float(max(p[1], q[1]))))
    a = np.array([(*p, *q) for p, q in e], dtype=float)
    a = a[np.argsort(a[:, 0], kind="stable")]
    cuts = [a[:, 0], a[:, 2]]
    slope = (a[:, 3] - a[:, 1]) / (a[:, 2] - a[:, 0])
    for i in range(len(a)):
        b = a[i + 1 :]
        b = b[b[:, 0] < a[i, 2]]
        if len(b):
            d = slope[i] - (b[:, 3] - b[:, 1]) / (b[:, 2] - b[:, 0])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = b[:, 0] + (b[:, 1] - a[i, 1] - slope[i] * (b[:, 0] - a[i, 0])) / d
            inner = (x > np.maximum(b[:, 0], a[i, 0])) & (x < np.minimum(b[:, 2], a[i, 2]))
            if inner.any():
                cuts.append(x[inner])
    xs = np.unique(np.concatenate(cuts))
    for x0, x1 in zip(xs, xs[1:]):
        over = np.flatnonzero((a[:, 0] <= x0) & (a[:, 2] >= x1))
        if len(over):
            mid = a[over, 1] + ((x0 + x1) / 2 - a[over, 0]) * slope[over]
            yield x0, x1, a[over[np.argsort(mid, kind="stable")]], sorted(walls.get(float(x0), ()))


def tiles_of(polygon, tile: float):
    """{(tx, ty): [(x0, x1, below, edges, walls)]}: the polygon's slabs by tile, from left to right; tiles that no inside reaches are left out."""
    out: dict[tuple[int, int], list] = {}
    for x0, x1, edges, walls in slabs_of(polygon):
        slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
        for tx in range(math.floor(x0 / tile), math.ceil(x1 / tile)):
            lo, hi = max(float(x0), tx * tile), min(float(x1), (tx + 1) * tile)
            if lo >= hi:
                continue
            a, b = edges[:, 1] + (lo - edges[:, 0]) * slope, edges[:, 1] + (hi - edges[:, 0]) * slope
            low, high = np.minimum(a, b), np.maximum(a, b)
            pad = 1e-9 * max(1.0, float(np.abs(low).max()), float(np.abs(high).max()))
            for ty in range(math.floor((low.min() - pad) / tile), math.floor((high.max() + pad) / tile) + 1):
                over, under = np.flatnonzero(high + pad >= ty * tile), np.flatnonzero(low - pad <= (ty + 1) * tile)
                first, last = int(over[0]) if len(over) else len(edges), int(under[-1]) + 1 if len(under) else 0
                if first % 2 == 0 and first >= last:
                    continue
                spans = [w for w in walls if w[0] <= (ty + 1) * tile and w[1] >= ty * tile] if lo == x0 else []
                out.setdefault((tx, ty), []).append((lo, hi, first, edges[first:last], spans))
    return out


def decompose(tile: float):
    """region, geometry -> SLABS rows. Null, empty and unreadable geometries, points and lines have no slabs."""

    def run(batches):
        for batch in batches:
            rows = []
            for region, text in zip(batch["region"], batch["geometry"]):
                try:
                    g = wkt.parse(text)
                except wkt.BadGeometry:
                    continue
                for part, polygon in enumerate(g.polygons):
                    if not all(math.isfinite(v) for ring in polygon for c in ring for v in c[:2]):
                        continue
                    for (tx, ty), slabs in tiles_of(polygon, tile).items():
                        cells = [
                            {"x1": x1, "below": below, "edges": [dict(zip(("ax", "ay", "bx", "by"), map(float, e))) for e in edges], "walls": [{"lo": lo, "hi": hi} for lo, hi in walls]}
                            for _, x1, below, edges, walls in slabs
                        ]
                        rows.append((region, part, tx, ty, [x[0] for x in slabs], cells))
            yield pd.DataFrame(rows, columns=["region", "part", "tx", "ty", "starts", "slabs"])

    return run


def _side(edge: Column, x: Column, y: Column) -> Column:
    """Positive if the point is above the edge, 0 on it."""
    return (edge["bx"] - edge["ax"]) * (y - edge["ay"]) - (edge["by"] - edge["ay"]) * (x - edge["ax"])


def _search(df: DataFrame, at: str, most: int, goes_on) -> DataFrame:
    """The rows with column ``at``: how many of the first elements of a sorted array goes_on(index) holds for, by binary search.

    goes_on is null beyond the array's end. most: the longest array's length. One projection a step, so that every step is
    evaluated once and all of them are generated code; the last one holds a value that is not deterministic, as a filter
    on the result would else be pushed down with the whole nest of steps in it.
    """
    out = df.withColumn(at, F.lit(0))
    for k in reversed(range(max(1, most).bit_length())):
        out = out.withColumn(at, F.when(goes_on(F.col(at) + (1 << k) - 1), F.col(at) + (1 << k)).otherwise(F.col(at)))
    return out.withColumn(at, F.when(F.monotonically_increasing_id() >= 0, F.col(at)))


def region_slabs(regions: DataFrame, region: str = "region_id", geometry: str = "geometry_wkt", tile: float = TILE_DEGREES) -> DataFrame:
    """The slabs of all polygons by tile. Rows that repeat a region's geometry have the same slabs once."""
    texts = regions.select(regions[region].cast("bigint").alias("region"), regions[geometry].alias("geometry")).where("region is not null and geometry is not null").distinct()
    # One task would decompose all polygons where their texts are small.
    spread = texts.repartition(regions.sparkSession.sparkContext.defaultParallelism, "region")
    return spread.mapInPandas(decompose(tile), SLABS)


def points_in_regions(points: DataFrame, regions: DataFrame, *, point: str = "point_id", x: str = "longitude", y: str = "latitude", region: str = "region_id", geometry: str = "geometry_wkt", tile: float = TILE_DEGREES) -> DataFrame:
    """Distinct (left_id, right_id): the point lies in the interior of the region's polygon or one of its polygons.

    Plane coordinates; holes are outside and so is the boundary.  Points with a null id, null or NaN coordinates are
    nowhere; so is everything where either table is empty.  tile is the side of the tiles slabs are spread by.
    """
    slabs = Scratch(points.sparkSession, "slabs").save(region_slabs(regions, region, geometry, tile))
    longest = slabs.agg(F.max(F.size("starts")).alias("slabs"), F.max(F.array_max(F.transform("slabs", lambda s: F.size(s["edges"])))).alias("edges")).first()  # two numbers
    at = points.select(points[point].cast("bigint").alias("left_id"), points[x].cast("double").alias("px"), points[y].cast("double").alias("py"))
    at = at.where("left_id is not null and px is not null and py is not null and not isnan(px) and not isnan(py)")
    at = at.withColumns({"tx": F.floor(F.col("px") / tile), "ty": F.floor(F.col("py") / tile)})
    met = at.join(slabs, ["tx", "ty"]).select("left_id", "region", "px", "py", "starts", "slabs")
    met = _search(met, "n", longest["slabs"] or 0, lambda i: F.get("starts", i) <= F.col("px")).where("n > 0")
    met = met.select("left_id", "region", "px", "py", (F.get("starts", F.col("n") - 1) == F.col("px")).alias("left"), F.get("slabs", F.col("n") - 1).alias("s")).where("px < s.x1")
    on_wall = F.col("left") & F.exists("s.walls", lambda w: (w["lo"] <= F.col("py")) & (F.col("py") <= w["hi"]))
    met = met.where(~F.col("left") | ~on_wall).select("left_id", "region", "px", "py", "s.below", "s.edges")
    side = lambda i: _side(F.get("edges", i), F.col("px"), F.col("py"))
    met = _search(met, "m", longest["edges"] or 0, lambda i: side(i) > 0)
    inside = met.where(((F.col("below") + F.col("m")) % 2 == 1) & ~F.coalesce(side(F.col("m")) == 0, F.lit(False)))
    return inside.select("left_id", F.col("region").alias("right_id")).distinct()


def _cells(lat_band: Column, height: float, meters: float) -> tuple[Column, Column]:
    """(number of cells in a band, reach in degrees of longitude within the band and the ones beside it). Cells are two reaches wide at least."""
    reach = meters / (2 * EARTH_RADIUS_M)
    top = F.least(F.lit(90.0), F.greatest(F.abs((lat_band - 1) * height - 90), F.abs((lat_band + 2) * height - 90)))
    across = math.sin(reach) * (1 + 1e-9) / F.cos(F.radians(top))
    width = F.when(across < 1, F.degrees(2 * F.asin(across)) * (1 + 1e-9)).otherwise(F.lit(360.0))
    return F.greatest(F.lit(1), F.floor(F.lit(180.0) / width)), width


def points_near_points(points: DataFrame, meters: float, *, point: str = "point_id", longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """Distinct (left_id, right_id), left < right, of points at most ``meters`` apart along a great circle.

    Positions outside -180..180 and -90..90, null and NaN ones and null ids take no part; a point given with several
    positions is near another if any of them is.  Across the antimeridian and the poles points are near as on the
    sphere.  Rows given twice change nothing.
    """
    if not 0 < meters < EARTH_RADIUS_M / 100:
        raise ValueError("the distance must be positive and small against the sphere")
    degrees = math.degrees(meters / EARTH_RADIUS_M) * (1 + 1e-9)
    height = 2 * degrees
    at = points.select(points[point].cast("bigint").alias("id"), points[longitude].cast("double").alias("lon"), points[latitude].cast("double").alias("lat"))
    at = at.where("id is not null and lon between -180 and 180 and lat between -90 and 90").distinct()
    at = at.withColumn("band", F.floor((F.col("lat") + 90) / height))
    lon, band = F.col("lon"), F.col("band")
    for name, of in (("own", band), ("south", band - 1)):
        n, width = _cells(of, height, meters)
        at = at.withColumns({name + "_n": n, name + "_reach": width})
    place = lambda lon, n: (lon + 180) / 360 * F.col(n)
    cell = lambda lon, n: F.pmod(F.floor(place(lon, n)), F.col(n))
    at = at.withColumns({"own": cell(lon, "own_n"), "offset": (place(lon, "own_n") - F.floor(place(lon, "own_n"))) * 360 / F.col("own_n")})
    at = at.withColumns({"s1": cell(lon - F.col("south_reach"), "south_n"), "s2": cell(lon + F.col("south_reach"), "south_n")})
    # Kept in its own cell, in the one west of it and in those of the band to the south, where they are within reach; looked up in its own cell only.
    key = lambda b, c: F.struct(b.alias("b"), c.alias("c"))
    west = (F.col("own_n") > 1) & (F.col("offset") <= F.col("own_reach") * (1 + 1e-9))
    south = F.col("lat") + 90 - band * height <= degrees * (1 + 1e-6)
    away = F.array(F.when(west, key(band, F.pmod(F.col("own") - 1, F.col("own_n")))), F.when(south, key(band - 1, F.col("s1"))), F.when(south & (F.col("s1") != F.col("s2")), key(band - 1, F.col("s2"))), key(band, F.col("own")))
    kept = at.select(F.struct("id", "lon", "lat").alias("r"), "band", F.posexplode(away).alias("i", "k")).where("k is not null").select("r", F.col("k.b").alias("band"), F.col("k.c").alias("cell"), (F.col("i") == 3).alias("home"))
    seek = at.select(F.struct("id", "lon", "lat").alias("l"), "band", F.col("own").alias("cell"))
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), F.lit(2))
    h = half(F.col("l.lat"), F.col("r.lat")) + F.cos(F.radians("l.lat")) * F.cos(F.radians("r.lat")) * half(F.col("l.lon"), F.col("r.lon"))
    close = 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h))) <= meters
    once = F.when(F.col("home"), F.col("l.id") < F.col("r.id")).otherwise(F.col("l.id") != F.col("r.id"))
    met = seek.join(kept, ["band", "cell"]).where(once & (F.abs(F.col("l.lat") - F.col("r.lat")) <= degrees * (1 + 1e-6)) & close)
    return met.select(F.least("l.id", "r.id").alias("left_id"), F.greatest("l.id", "r.id").alias("right_id")).distinct()


def usable(points: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """Points with a position on the globe."""
    return points.where(points[longitude].between(-180, 180) & points[latitude].between(-90, 90))


def neighbourhood(points: DataFrame, regions: DataFrame, meters: float = 50.0) -> DataFrame:
    """relation, left_id, right_id: `near` pairs of points and `inside` pairs of a point and a region."""
    kept = usable(points)
    near = points_near_points(kept, meters).select(F.lit("near").alias("relation"), "left_id", "right_id")
    return near.unionByName(points_in_regions(kept, regions).select(F.lit("inside").alias("relation"), "left_id", "right_id"))
