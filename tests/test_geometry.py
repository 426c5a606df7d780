import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolith.geometry import batch, overlay, wkb, wkt
from geolith.geometry.exact import topologically_equal
from geolith.geometry.measure import Shape, distance, hausdorff, intersects, overlay_areas, similarities
from geolith.geometry.repair import RepairConfig, repair, snapped
from geolith.geometry.validity import invalid_reason, issues

SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


def shape(text):
    return Shape(wkt.parse(text))


def kinds(text):
    return [k for k, _ in issues(wkt.parse(text))]


@pytest.mark.parametrize(
    "text",
    [
        "POINT (1 2)", "POINT EMPTY", "MULTIPOINT ((1 2), (3 4))", "LINESTRING (0 0, 1 1.5)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", SQUARE,
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POLYGON EMPTY",
    ],
)
def test_text_and_bytes_round_trip(text):
    g = wkt.parse(text)
    assert wkt.dump(g) == text
    assert wkt.dump(wkb.load(wkb.dump(g))) == text


@pytest.mark.parametrize("text", ["", "CIRCLE (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 1))", "POLYGON ((0 0, 1 0, 0 0))", "POINT (1)", "LINESTRING (0 0)", "POINT (a b)", "POLYGON ((0 0, 1 0, 1 1, 0 0)"])
def test_bad_text_raises(text):
    with pytest.raises(wkt.BadGeometry):
        wkt.parse(text)


def test_bad_bytes_raise():
    with pytest.raises(wkt.BadGeometry):
        wkb.load(b"\x01\x03\x00")


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [
        (SQUARE, "polygon((2 2,0 2,0 0,1 0,2.0 0,2 2))", True),
        (SQUARE, "MULTIPOLYGON (((0 0,1 0,1 2,0 2,0 0)),((1 0,2 0,2 2,1 2,1 0)))", True),
        (SQUARE, "MULTIPOLYGON (((0 0,1.5 0,1.5 2,0 2,0 0)),((1 0,2 0,2 2,1 2,1 0)))", True),
        (SQUARE, "POLYGON ((0 0, 2 0, 2 2.0000000000000000001, 0 2, 0 0))", False),
        ("POLYGON ((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "POLYGON ((0 0,4 0,4 4,0 4,0 0))", False),
        ("LINESTRING (0 0, 2 0)", "MULTILINESTRING ((2 0,1 0),(0 0,1.5 0))", True),
        ("LINESTRING (0 0, 2 0)", "LINESTRING (0 0, 1 0.001, 2 0)", False),
        ("POINT (1 2)", "MULTIPOINT ((1.0 2e0),(1 2))", True),
        ("POINT (3.648875000000000e+03 -0.5)", "POINT (3648.875 -.50)", True),
        ("POINT EMPTY", "POLYGON EMPTY", True),
        (None, "POINT EMPTY", False),
        (None, None, True),
        ("POINT (1 2)", SQUARE, False),
        ("nonsense", "nonsense", True),
        ("nonsense", SQUARE, False),
    ],
)
def test_topological_equality(a, b, equal):
    assert topologically_equal(a, b) is equal
    assert topologically_equal(b, a) is equal


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (SQUARE, []),
        ("POINT (1 1)", []),
        ("POINT EMPTY", ["empty_geometry"]),
        ("POLYGON ((0 0,2 2,0 2,2 0,0 0))", ["invalid_geometry", "self_intersection"]),
        ("LINESTRING (0 0,2 2,0 2,2 0)", ["self_intersection"]),
        ("MULTILINESTRING ((0 0,2 2),(0 2,2 0))", ["self_intersection"]),
        ("POLYGON ((0 0,4 0,4 4,0 4,0 0),(5 5,6 5,6 6,5 6,5 5))", ["invalid_geometry", "ring_error"]),
        ("POLYGON ((0 0,0 2,1 1,2 2,2 0,1 1,0 0))", ["invalid_geometry", "ring_error", "self_intersection", "duplicate_vertex"]),
        ("LINESTRING (0 0,1 1,1 1,2 2)", ["duplicate_vertex"]),
        ("LINESTRING (0 0,0 0)", ["invalid_geometry", "duplicate_vertex"]),
        ("LINESTRING (0 0,NaN 1,2 2)", ["invalid_geometry"]),
        ("MULTIPOINT ((0 0),(1 1),(0 0))", ["duplicate_vertex"]),
        ("MULTILINESTRING ((0 0,1 1),(1 1,2 0))", []),
        ("MULTIPOLYGON (((0 0,4 0,4 4,0 4,0 0)),((1 1,2 1,2 2,1 2,1 1)))", ["invalid_geometry", "ring_error"]),
        ("POLYGON ((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1),(1.5 1.5,2 1.5,2 2,1.5 2,1.5 1.5))", ["invalid_geometry", "ring_error"]),
    ],
)
def test_issue_types_in_order(text, expected):
    assert kinds(text) == expected


def test_holes_that_touch():
    once = "POLYGON ((0 0,4 0,4 4,0 4,0 0),(0 2,2 1,3 2,2 3,0 2))"
    twice = "POLYGON ((0 0,4 0,4 4,0 4,0 0),(0 2,2 1,4 2,2 3,0 2))"
    assert invalid_reason(wkt.parse(once)) is None
    assert invalid_reason(wkt.parse(twice)).startswith("Interior is disconnected")


def test_duplicate_places_are_named_and_bounded():
    message = dict(issues(wkt.parse("GEOMETRYCOLLECTION (POINT (0 0), MULTIPOLYGON (((0 0,2 0,2 2,2 0,0 0))))")))["duplicate_vertex"]
    assert "geometry.geoms[1].geoms[0].exterior" in message
    many = "GEOMETRYCOLLECTION (" + ", ".join(["LINESTRING (0 0,1 1,1 1,2 2)"] * 21) + ")"
    message = dict(issues(wkt.parse(many)))["duplicate_vertex"]
    assert message.count("geometry.geoms[") == 20 and "additional locations" in message
    assert issues(None)[0][0] == "empty_geometry"


def test_similarities_of_boxes_and_lines():
    assert similarities(shape(SQUARE), shape(SQUARE)) == (1.0, 1.0, 1.0)
    iou, h, s = similarities(shape("POLYGON ((0 0,1 0,1 1,0 1,0 0))"), shape("POLYGON ((1 0,2 0,2 1,1 1,1 0))"))
    assert (iou, s) == (0.5, 1.0) and abs(h - (1 - 1 / math.sqrt(5))) < 1e-12  # a common edge counts by its length
    assert similarities(shape("LINESTRING (0 0,1 0)"), shape("LINESTRING (1 0,0 0)"))[0] == 1
    assert similarities(shape("POINT (1 1)"), shape("POINT (2 1)"))[0] == 0


def test_distance_and_holes():
    ring = shape("POLYGON ((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))")
    assert not intersects(ring, shape("POINT (1.5 1.5)")) and intersects(ring, shape("POINT (0.5 0.5)"))
    assert distance(ring, shape("POINT (1.5 1.5)")) == 0.5
    assert ring.area == 15


def star(rng, n, cx, cy):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + rng.uniform(0.5, 2) * math.cos(t), cy + rng.uniform(0.5, 2) * math.sin(t)) for t in turns]
    return overlay.make_valid([[[*ring, ring[0]]]])


def test_overlay_laws_on_random_polygons():
    rng = random.Random(5)
    for _ in range(40):
        a, b = (star(rng, rng.randint(3, 10), rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(2))
        if not a or not b:
            continue
        both, whole, rest, either = overlay.intersection(a, b), overlay.union([a, b]), overlay.difference(a, b), overlay.symmetric_difference(a, b)
        area = overlay.area_of
        assert abs(area(both) + area(whole) - area(a) - area(b)) < 1e-9
        assert abs(area(rest) + area(both) - area(a)) < 1e-9
        assert abs(area(either) + 2 * area(both) - area(a) - area(b)) < 1e-9
        assert abs(overlay_areas(Shape(overlay.region(a)), Shape(overlay.region(b)))[2] - area(both)) < 1e-9
        for result in (both, whole, rest):
            assert not result or invalid_reason(overlay.region(result)) is None


box = st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4), st.integers(1, 4)).map(lambda t: [[[(t[0], t[1]), (t[0] + t[2], t[1]), (t[0] + t[2], t[1] + t[3]), (t[0], t[1] + t[3]), (t[0], t[1])]]])


@settings(max_examples=60, deadline=None)
@given(st.lists(box, min_size=1, max_size=5))
def test_union_of_boxes_is_the_number_of_cells(boxes):
    cells = {(x, y) for b in boxes for x in range(b[0][0][0][0], b[0][0][1][0]) for y in range(b[0][0][0][1], b[0][0][2][1])}
    union = overlay.union(boxes)
    assert overlay.area_of(union) == len(cells)
    assert invalid_reason(overlay.region(union)) is None


def test_repair_of_single_geometries():
    fixed, actions = repair(wkt.parse("POLYGON ((0 0,2 2,0 2,2 0,0 0))"), RepairConfig())
    assert invalid_reason(fixed) is None and [a[0] for a in actions] == ["self_intersection"]
    fixed, actions = repair(wkt.parse("POLYGON ((0 0,0 0,1 0,1 1,0 1,0 0))"), RepairConfig())
    assert wkt.dump(fixed) == "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))" and actions[0][0] == "duplicate_vertex"
    two = "MULTIPOLYGON (((0 0,1 0,1 1,0 1,0 0)),((2 0,2.0005 0,2.0005 1,2 1,2 0)))"
    fixed, actions = repair(wkt.parse(two), RepairConfig(sliver_thinness_threshold=0.05))
    assert Shape(fixed).area == 1 and actions[0][0] == "sliver_polygon"
    with pytest.raises(ValueError):
        RepairConfig(gap_area_threshold=-1.0)


def test_snapping_moves_vertices():
    moved = snapped(wkt.parse("POLYGON ((1.005 0,2.005 0,2.005 1,1.005 1,1.005 0))"), [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]], 0.01)
    assert wkt.dump(moved) == "POLYGON ((1 0, 2.005 0, 2.005 1, 1 1, 1 0))"


def test_hausdorff_is_symmetric():
    a, b = shape("LINESTRING (0 0,4 0)"), shape("LINESTRING (0 1,2 3,4 1)")
    assert hausdorff(a, b) == hausdorff(b, a) == 3
    assert np.isfinite(hausdorff(a, shape("POINT (0 0)")))


def batch_texts():
    rng, out = random.Random(8), []
    for k in range(60):
        x, y, size = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(1, 8)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 60 if k % 9 == 0 else 11)))
        ring = [(x + size * rng.uniform(0.5, 1) * math.cos(t), y + size * rng.uniform(0.5, 1) * math.sin(t)) for t in turns]
        out.append("POLYGON ((" + ", ".join(f"{a!r} {b!r}" for a, b in [*ring, ring[0]]) + "))")
    for k in range(12):
        x, y, w, h = rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 4), rng.randint(1, 4)
        out.append(f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))")
        out.append(f"LINESTRING ({x} {y}, {x + w} {y}, {x + w} {y + h})")
    return [
        *out, "LINESTRING (0 0, 10 0)", "LINESTRING (0 0, 10 0, 0 0)", "MULTILINESTRING ((0 0, 4 0), (2 0, 10 0))", "LINESTRING (5 5, 5 5)", "POINT (5 5)", "MULTIPOINT ((5 5), (6 6))", "POINT (5 5)",
        "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 2 6, 6 6, 6 2, 2 2))", "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0)), ((5 5, 8 5, 8 8, 5 5)))", "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "POLYGON ((1 1, 1 1, 5 1, 5 5, 5 5, 1 1))",
        "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 3 3))", "POLYGON ((3 3, 3 3, 3 3, 3 3))",
    ]


def test_scores_of_a_batch_are_those_of_single_pairs():
    shapes = [wkt.parse(t) for t in batch_texts()]
    single = [Shape(g) for g in shapes]
    flat = batch.Flat.load([wkb.dump(g) for g in shapes])
    assert np.allclose(flat.area, [s.area for s in single]) and np.allclose(flat.length, [s.length for s in single]) and np.array_equal(flat.bounds, [s.bounds for s in single])
    l, r = (x.ravel() for x in np.meshgrid(np.arange(len(shapes)), np.arange(len(shapes)), indexing="ij"))
    meet = (flat.bounds[l, :2] <= flat.bounds[r, 2:]).all(1) & (flat.bounds[r, :2] <= flat.bounds[l, 2:]).all(1)
    l, r = l[meet], r[meet]
    weights = (0.45, 0.35, 0.20)
    expected = np.array([similarities(single[i], single[j]) for i, j in zip(l, r)])
    assert np.abs(batch.similarities_of(flat, l, r, weights, 0.0) - expected).max() < 1e-12
    bounded = batch.similarities_of(flat, l, r, weights, 0.8) @ weights
    assert np.array_equal(bounded >= 0.8 - 1e-12, expected @ weights >= 0.8 - 1e-12)


def test_plain_texts_are_read_as_the_parser_does():
    texts = [*batch_texts(), "polygon((0 0,1 0,1 1,0 0))", " LineString ( 1e1 -2.5 , 3 4 ) ", "POLYGON ((0 0, 1 0, 1 1))", "LINESTRING (0 0)", "LINESTRING (0 0 1, 1 1 1)", "POLYGON (0 0, 1 0, 1 1, 0 0)", "LINESTRING ((0 0, 1 1))", "POLYGON EMPTY", "LINESTRING (nan 0, 1 1)", "LINESTRING (a b, 1 1)", None, b"x"]
    rows, polygon, n, xy = batch.read_plain(texts)
    for row, is_polygon, path in zip(rows, polygon, np.split(xy, np.cumsum(n)[:-1])):
        g = wkt.parse(texts[row])
        assert np.array_equal(path, (g.polygons[0][0] if is_polygon else g.lines[0])) and len(list(g.paths())) == 1
        assert batch.as_wkb(path, np.array([len(path)]), np.array([is_polygon])) == [wkb.dump(g)]
    left_out = set(range(len(texts))) - set(rows.tolist())
    assert all(not isinstance(texts[k], str) or texts[k].startswith(("POINT", "MULTI", "GEOM")) or k >= len(batch_texts()) or "), (" in texts[k] for k in left_out)
    assert len(batch.read_plain([])[0]) == 0
