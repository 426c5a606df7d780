import math
import random
from datetime import datetime

import pytest

from geolith.geometry import wkt
from geolith.geometry.measure import Shape, similarities
from geolith.llm.near_duplicates import WEIGHTS, near_duplicate_features

SCHEMA = "feature_index long, geometry_wkt string, edited_at timestamp, kind string, level string"
T0, T1 = datetime(2030, 1, 1), datetime(2030, 1, 2)


def pairs(spark, scratch, rows, least=0.85):
    frame = spark.createDataFrame([(i, g, t, "clash", "clash") for i, g, t in rows], SCHEMA)
    return sorted((r.left_index, r.right_index) for r in near_duplicate_features(frame, scratch, least).collect())


def brute(rows, least=0.85):
    shapes = {i: Shape(wkt.parse(g)) for i, g in rows}
    out = []
    for i in sorted(shapes):
        for j in sorted(shapes):
            a, b = shapes[i], shapes[j]
            meet = a.bounds[0] <= b.bounds[2] and b.bounds[0] <= a.bounds[2] and a.bounds[1] <= b.bounds[3] and b.bounds[1] <= a.bounds[3]
            if i < j and meet and sum(w * s for w, s in zip(WEIGHTS, similarities(a, b))) + 1e-12 >= least:
                out.append((i, j))
    return out


def ring(rng, x, y, size, n):
    turns = [2 * math.pi * k / n for k in range(n)]
    return [(x + size * rng.uniform(0.8, 1.2) * math.cos(t), y + size * rng.uniform(0.8, 1.2) * math.sin(t)) for t in turns]


def polygon(points):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*points, points[0]]) + "))"


def test_edited_polygons_of_all_sizes_against_all_pairs(spark, scratch):
    rng, rows = random.Random(4), []
    for k in range(45):
        size = 2 ** rng.uniform(-3, 7)
        points = ring(rng, rng.uniform(-300, 300), rng.uniform(-300, 300), size, rng.randint(4, 14))
        rows.append((10 * k, polygon(points)))
        for e in range(1, 4):
            shift = size * rng.uniform(0, 0.2)
            moved = [(x + shift + size * rng.uniform(-0.05, 0.05), y - shift / 2) for x, y in points]
            if rng.random() < 0.5:
                moved = moved[3:] + moved[:3]
            rows.append((10 * k + e, polygon(moved[::-1] if rng.random() < 0.5 else moved)))
    expected = brute(rows)
    assert pairs(spark, scratch, [(i, g, T0) for i, g in rows]) == expected and len(expected) > 40


def test_lines_points_and_mixed(spark, scratch):
    rows = [
        (1, "LINESTRING (0 0, 10 0, 20 5)"), (2, "MULTILINESTRING ((20 5, 10 0, 0 0))"), (3, "LINESTRING (0 0, 10 0, 19 4.5)"), (4, "LINESTRING (0 0.5, 10 0.5, 20 5.5)"),
        (5, "POINT (7 7)"), (6, "MULTIPOINT ((7 7))"), (7, "POINT (7 7.0001)"),
        (8, "POLYGON ((0.1 50, 100.1 50, 100.1 50.6, 0.1 50.6, 0.1 50))"), (9, "LINESTRING (0.1 50.3, 60 50.3)"), (10, "LINESTRING (0.1 50, 100.1 50.6)"),
        (11, "POLYGON ((200 0, 200.4 0, 200.4 0.5, 200 0.5, 200 0))"), (12, "POLYGON ((200.4 0, 200.8 0, 200.8 0.5, 200.4 0.5, 200.4 0))"),
    ]
    expected = brute(rows)
    assert (1, 2) in expected and (5, 6) in expected and (11, 12) in expected and (8, 10) in expected
    assert pairs(spark, scratch, [(i, g, T0) for i, g in rows]) == expected


def test_newest_row_nulls_repeats_and_unreadable(spark, scratch):
    a, b = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((50 50, 54 50, 54 54, 50 54, 50 50))"
    rows = [(1, a, T0), (1, b, T1), (2, a, T1), (2, a, T1), (3, "polygon((4 4,0 4,0 0,4 0,4 4))", T0), (4, None, T0), (5, "POLYGON EMPTY", T0), (6, "POLYGON ((0 0, 1 1, 0 0))", T0), (None, a, T0), (7, "POINT (NaN 1)", T0), (8, b, None)]
    assert pairs(spark, scratch, rows) == [(1, 8), (2, 3)]
    assert pairs(spark, scratch, []) == []


def test_a_class_of_equal_copies_keeps_all_links(spark, scratch):
    copies = [(i, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", T0) for i in range(30)]
    near = [(100 + i, "POLYGON ((0 0, 4.2 0, 4.2 4, 0 4, 0 0))", T0) for i in range(3)]
    assert len(pairs(spark, scratch, copies + near)) == 30 * 29 // 2 + 3 + 30 * 3


def test_too_low_similarity_is_refused(spark, scratch):
    with pytest.raises(ValueError):
        pairs(spark, scratch, [(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", T0)], least=0.5)


def serpentine(sweeps, size, x=0.0, y=0.0):
    out = []
    for k in range(sweeps):
        ends = [(x, y + size * k / (sweeps - 1)), (x + size, y + size * k / (sweeps - 1))]
        out += ends if k % 2 == 0 else ends[::-1]
    return out


def line(*paths):
    parts = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in p) + ")" for p in paths]
    return "LINESTRING " + parts[0] if len(parts) == 1 else f"MULTILINESTRING ({', '.join(parts)})"


def test_pairs_of_any_ratio_of_diagonals(spark, scratch):
    body = serpentine(41, 0.7)
    tails = [(-0.7, 0.0), *body, (1.4, 0.7)]
    dense, at = serpentine(200, 0.1, 300.0), (300.05, 0.05)
    star = [[at, (at[0] + 0.25 * i, at[1] + 0.25 * j)] for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    dots = [[(500.05 + i, 0.05 + j), (500.05001 + i, 0.05 + j)] for i, j in ((20, 0), (-20, 0), (0, 20), (0, -20))]
    corners = [[(700.0, 0.0), (700.0 + i, 0.0)] for i in (0.5, -0.5)], [[(700.0, 0.0), (700.0, j)] for j in (0.5, -0.5)]
    rows = [
        (1, line(body)), (2, line(tails)),
        (3, line(dense)), (4, line(dense, *star)),
        (5, line(serpentine(200, 0.1, 500.0))), (6, line(serpentine(200, 0.1, 500.0), *dots)),
        (7, line(serpentine(200, 0.05, 700.0), corners[0][0], corners[1][0])), (8, line(serpentine(200, 0.05, 700.0), corners[0][1], corners[1][1])),
    ]
    expected = brute(rows)
    assert {(1, 2), (3, 4), (5, 6)} <= set(expected)
    assert pairs(spark, scratch, [(i, g, T0) for i, g in rows]) == expected


def test_repeated_stretches_and_points_without_length(spark, scratch):
    rows = [
        (1, "LINESTRING (0 0, 10 0)"), (2, "LINESTRING (0 0, 10 0, 0 0)"), (3, "MULTILINESTRING ((0 0, 10 0), (0 0, 10 0))"), (4, "LINESTRING (0 0, 10 0, 5 0)"), (5, "LINESTRING (0 0, 10 0, 0 0, 10 0)"),
        (6, "MULTIPOINT ((50 0), (52 2), (54 0))"), (7, "MULTIPOINT ((50 0), (52 1), (54 0))"),
        (8, "GEOMETRYCOLLECTION (POINT (90 5), LINESTRING (92 0, 92 0))"), (9, "MULTIPOINT ((90 5), (92 0))"),
    ]
    expected = brute(rows)
    assert {(1, 2), (1, 3), (1, 4), (1, 5), (8, 9)} <= set(expected) and (6, 7) not in expected
    assert pairs(spark, scratch, [(i, g, T0) for i, g in rows]) == expected


def test_plain_writing_is_settled_as_the_rest(spark):
    from geolith.geometry import wkb
    from geolith.llm.near_duplicates import FEATURE, describe, one_writing

    rng, texts = random.Random(11), ["POLYGON ((1 1, 1 1, 5 1, 5 5, 1 5, 1 1))", "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "POLYGON ((0 0, 2 2, 4 4, 2 2, 0 0))", "POLYGON ((3 3, 3 3, 3 3, 3 3))", "POLYGON ((0 0, 2 1, 4 0, 0 0, 2 3, 0 0))", "LINESTRING (5 5, 5 5)", "LINESTRING (-0 0, 1 1, 1 1)", "LINESTRING (3 3, 1 0, 3 3)", "LINESTRING (0 5, 0 2, 1 9, 0 2, 0 4)"]
    for _ in range(60):
        points = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.randint(3, 8))]
        texts += [polygon(points), polygon(points[::-1]), "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in points) + ")"]
    frame = spark.createDataFrame(list(enumerate(texts)), "feature_index long, geometry_wkt string").coalesce(1)
    got = {r.feature_index: r for r in frame.mapInPandas(describe, FEATURE).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        g = one_writing(wkt.parse(text))
        assert bytes(got[i].shape) == wkb.dump(g), text
        assert math.isclose(got[i].area, Shape(g).area, abs_tol=1e-9) and math.isclose(got[i].length, Shape(g).length)
