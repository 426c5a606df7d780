import math
import random

import pytest

from geolith.operators.nearby import EARTH_RADIUS_M, neighbourhood, points_in_regions, points_near_points

POINTS = "point_id long, longitude double, latitude double, cell string, band string"
REGIONS = "region_id long, geometry_wkt string, x0 string"


def points(spark, rows):
    return spark.createDataFrame([(i, None if x is None else float(x), float(y), "clash", "clash") for i, x, y in rows], POINTS)


def near(spark, rows, meters=50.0):
    return sorted((r.left_id, r.right_id) for r in points_near_points(points(spark, rows), meters).collect())


def apart(a, b):
    (x0, y0), (x1, y1) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for k, (cx, cy) in enumerate([(0, 0), (180, 10), (-180, 10), (20, 89.9999), (-160, 89.9999), (77, -89.99999), (-30, 60), (12, 45)]):
        for i in range(40):
            lat = max(-90, min(90, cy + rng.uniform(-0.001, 0.001)))
            lon = cx + rng.uniform(-0.001, 0.001) / max(1e-6, math.cos(math.radians(min(89.9, abs(lat))))) if abs(cy) < 89 else rng.uniform(-180, 180)
            lon = lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon
            rows.append((k * 100 + i, lon, lat))
    expected = sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if apart(a[1:], b[1:]) <= 50)
    assert near(spark, rows) == expected and len(expected) > 100


def test_bad_positions_repeats_and_equal_places(spark):
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, 200.0, 0.0), (None, 0.0, 0.0), (6, 0.0, 91.0), (7, 10.0, 10.0)]
    assert near(spark, rows) == [(1, 2)]
    assert near(spark, []) == []
    with pytest.raises(ValueError):
        points_near_points(points(spark, rows), 0)


def test_crowded_cell_is_complete(spark):
    rows = [(i, 5.0, 5.0) for i in range(120)]
    assert len(near(spark, rows)) == 120 * 119 // 2


REGION_ROWS = [
    (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", "clash"),
    (2, "MULTIPOLYGON (((20 0, 25 0, 22 8, 20 0)), ((5 5, 5.5 5, 5.5 5.5, 5 5)))", "clash"),
    (3, "POLYGON ((2 2, 3 2, 3 3, 2 3, 2 2))", "clash"), (3, "POLYGON ((2 2, 3 2, 3 3, 2 3, 2 2))", "clash"),
    (4, None, "clash"), (5, "POLYGON EMPTY", "clash"), (6, "LINESTRING (0 0, 9 9)", "clash"), (7, "broken", "clash"), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))", "clash"),
]


def test_regions_with_holes_parts_and_overlaps(spark):
    rows = [(1, 1.0, 1.0), (2, 5.0, 4.5), (3, 2.5, 2.5), (4, 22.0, 1.0), (5, 5.4, 5.2), (6, 0.0, 5.0), (7, 10.0, 10.0), (8, None, 1.0), (9, -5.0, -5.0), (10, 4.0, 5.0)]
    out = points_in_regions(points(spark, rows), spark.createDataFrame(REGION_ROWS, REGIONS))
    assert sorted((r.left_id, r.right_id) for r in out.collect()) == [(1, 1), (3, 1), (3, 3), (4, 2), (5, 2)]


def test_random_regions_against_even_odd(spark):
    rng = random.Random(8)
    rings = []
    for k in range(6):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(30))
        ring = [(3 * k % 7 + rng.uniform(1, 4) * math.cos(t), 2 * k % 5 + rng.uniform(1, 4) * math.sin(t)) for t in turns]
        rings.append([*ring, ring[0]])
    regions = spark.createDataFrame([(k, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in r) + "))", "") for k, r in enumerate(rings)], REGIONS)
    rows = [(i, rng.uniform(-5, 12), rng.uniform(-5, 10)) for i in range(300)]

    def inside(p, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    expected = sorted((i, k) for i, x, y in rows for k, r in enumerate(rings) if inside((x, y), r))
    assert sorted((r.left_id, r.right_id) for r in points_in_regions(points(spark, rows), regions).collect()) == expected and expected


def test_both_relations(spark):
    out = neighbourhood(points(spark, [(1, 1.0, 1.0), (2, 1.0001, 1.0)]), spark.createDataFrame(REGION_ROWS, REGIONS))
    assert sorted((r.relation, r.left_id, r.right_id) for r in out.collect()) == [("inside", 1, 1), ("inside", 2, 1), ("near", 1, 2)]
