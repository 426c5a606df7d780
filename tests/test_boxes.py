"""Boxes are repaired, compared and measured by the batch, with the results of the general way."""

import random
from itertools import pairwise

import pandas as pd
import pytest

from geolith.geometry import overlay, validity, wkb, wkt
from geolith.geometry.measure import Shape, distance, shared_length
from geolith.geometry.repair import RepairConfig
from geolith.operators import repair as repairs
from geolith.operators import compare, gaps, small_polygons, snap


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


def text(x, y, w, h):
    return wkt.dump(wkt.Geom("POLYGON", polygons=[box(x, y, w, h)]))


def data(x, y, w, h):
    return wkb.dump(wkt.Geom("POLYGON", polygons=[box(x, y, w, h)]))


def test_upright_edges_bound_as_all_edges_do():
    pick = random.Random(5)
    for _ in range(300):
        regions = [[box(pick.randint(0, 6), pick.randint(0, 6), pick.randint(1, 5), pick.randint(1, 4)) for _ in range(pick.randint(1, 3))] for _ in range(pick.randint(1, 5))]
        edges = [(p, q, i) for i, polygons in enumerate(regions) for polygon in polygons for ring in polygon for p, q in pairwise(ring)]
        for wanted in (bool, lambda s: s == frozenset({0}), lambda s: len(s) == 2):
            assert list(overlay._upright(edges, wanted)) == list(overlay._bounding(overlay._pieces(edges), wanted))


def test_simple_upright_rings_are_valid_the_general_way_too(monkeypatch):
    pick, rings = random.Random(6), []
    for _ in range(2000):
        x, y = pick.randint(0, 4), pick.randint(0, 4)
        ring = [(x, y)]
        for _ in range(pick.randint(2, 5)):
            ring += [(x := pick.randint(0, 4), y), (x, y := pick.randint(0, 4))]
        ring = validity._flat([*ring, (ring[0][0], y), ring[0]])
        if len(ring) >= 5 and validity._simple_upright(ring):
            rings.append(ring)
    monkeypatch.setattr(validity, "_simple_upright", lambda ring: False)
    assert len(rings) > 100 and all(validity._polygons_reason([[ring]]) is None for ring in rings)


def test_sound_boxes_are_repaired_by_the_batch(monkeypatch):
    """repair_safety: neither the first stage nor the last makes an object of a box that needs nothing."""
    monkeypatch.setattr(repairs, "_geometry", lambda value: pytest.fail("a box was read by itself"))
    monkeypatch.setattr(repairs, "invalid_reason", lambda g: pytest.fail("a box was judged by itself"))
    texts = [text(0, 0, 3, 2), text(5, 5, 1, 4)]
    stage = pd.concat(repairs._first_stage(RepairConfig())([pd.DataFrame({"feature_index": [1, 2], "geometry": texts})]))
    assert stage["before"].tolist() == stage["shape"].tolist() == [data(0, 0, 3, 2), data(5, 5, 1, 4)]
    done = pd.concat(repairs._finish(RepairConfig())([stage]))
    assert done[["feature_index", "status", "before", "after", "area_after", "shape_shift"]].values.tolist() == [[1, "unchanged", texts[0], texts[0], 6, 0], [2, "unchanged", texts[1], texts[1], 4, 0]]


def test_boxes_without_common_area_are_not_cut(monkeypatch):
    monkeypatch.setattr(repairs.overlay, "difference", lambda *a: pytest.fail("touching boxes were cut"))
    rows = pd.DataFrame({"feature_index": [2, 2], "own": [data(0, 0, 2, 2)] * 2, "other": [data(2, 0, 2, 2), data(0, -1, 2, 1)]})
    assert sum(map(len, repairs._erase([rows]))) == 0


def test_odd_features_are_repaired_beside_boxes(spark):
    texts = [text(0, 0, 1e-5, 1e-5), text(0, 20, 10, 1e-4), "POLYGON ((0 0, 1 0, 1 0, 0 0, 0 0))", text(0.5, 0.25, 1, 2), text(1, 1, 1, 1), "POLYGON ((30 0, 32 2, 32 0, 30 2, 30 0))", "POLYGON EMPTY", "x", None]
    features = spark.createDataFrame(list(enumerate(texts)), "feature_index long, geometry string")
    found = repairs.repair_coverage(spark, features, RepairConfig(fill_gaps=False, max_relative_area_change=0.4)).orderBy("feature_index").collect()
    assert [r.status for r in found] == ["unchanged", "unchanged", "failed", "unchanged", "failed", "repaired", "unchanged", "failed", "unchanged"]
    assert found[3].after == texts[3] and found[3].area_after == 2


def test_small_boxes_are_measured_by_the_batch(monkeypatch):
    """small_polygon_recommendations: distances and common edges of boxes without an object each."""
    a, others = data(0, 0, 2, 2), [data(2, 1, 3, 3), data(5, 6, 1, 1), data(2, 2, 1, 1), data(0, 0, 2, 1), data(-1, -1, 5, 5)]
    general = [(shared_length(x.segments, y.segments), distance(x, y)) for x, y in ((Shape(wkb.load(a)), Shape(wkb.load(b))) for b in others)]
    monkeypatch.setattr(small_polygons.Cache, "__call__", lambda *x: pytest.fail("a box was read by itself"))
    pairs = pd.DataFrame({"l": 1, "r": range(5), "lw": [a] * 5, "rw": others})
    ranked = pd.concat(small_polygons._rank([pairs]))
    assert ranked[["shared", "d"]].values.tolist() == [pytest.approx(x) for x in general] == [[1, 0], [0, 5], [0, 0], [4, 0], [0, 0]]
    assert len(pd.concat(small_polygons._near(5.0)([pairs]))) == 4


def test_boxes_are_snapped_by_the_batch(monkeypatch):
    """snap_boundaries: distances without an object each, features without a group each, runs over the ends of batches."""
    monkeypatch.setattr(snap.Cache, "__call__", lambda *x: pytest.fail("a box was read by itself"))
    a, b, c = data(0, 0, 3, 3), data(4, 0, 3, 3), data(4, 4, 3, 3)
    pairs = pd.DataFrame({"l": [1, 1, 2, 2], "r": [2, 3, 3, 4], "lw": [a, a, b, b], "rw": [b, c, c, data(6, 1, 1, 1)]})
    near = pd.concat(snap._near(1.0)([pairs]), ignore_index=True)
    assert near[["l", "r"]].values.tolist() == [[1, 2], [2, 3]]
    config = snap.SnapConfig(tolerance=1.0, max_relative_area_change=0.5, max_shape_shift=1.5)
    more = pd.concat((near, pd.DataFrame({"l": [3], "r": [3], "lw": [a], "rw": [c]})), ignore_index=True)
    moved = pd.concat(snap._move(config)([more[:2], more[2:]]))
    assert moved[["feature_index", "anchors", "reason", "shift", "area_after"]].values.tolist() == [[2, [1], "", 1, 12], [3, [2, 3], snap.CHANGED, 2**0.5, 14]]
    assert not len(pd.concat(snap._adds_overlap([pd.DataFrame({"l": [2], "r": [1], "before": [b], "after": [moved["after"].iloc[0]], "rw": [a]})])))


def _areas(left, right):
    a, b = overlay.union(left), overlay.union(right)
    return [overlay.area_of(a), overlay.area_of(b), overlay.area_of(overlay.intersection(a, b)) if a and b else 0]


def test_tiles_of_boxes_are_compared_by_the_batch(monkeypatch):
    """compare_boundaries_connected: no overlay, no object and no group for a tile of boxes; tiles over the ends of batches, cut where they have many places."""
    from geolith.geometry import cells

    pick, rows = random.Random(7), []
    for tx in range(6):
        for _ in range(pick.randint(1, 12)):
            draw = pick.uniform if tx % 2 else pick.randint
            x, y = 8 * tx + draw(-1, 7), draw(-1, 7)
            rows.append((8.0, tx, 0, pick.randint(0, 1), x, y, x + draw(1, 5), y + draw(1, 5), None))
    frame = pd.DataFrame(rows, columns=["cell", "tx", "ty", "side", "x0", "y0", "x1", "y1", "shape"])
    expected = [0, 0, 0]
    for tx in range(6):
        tile, sides = [box(8 * tx, 0, 8, 8)], ([], [])
        for r in frame[frame["tx"] == tx].itertuples():
            sides[r.side].append(overlay.intersection([box(r.x0, r.y0, r.x1 - r.x0, r.y1 - r.y0)], tile))
        expected = [a + b for a, b in zip(expected, _areas(*sides))]
    monkeypatch.setattr(compare, "overlay", None)
    for most in (cells.MOST_PLACES, 30):
        monkeypatch.setattr(cells, "MOST_PLACES", most)
        found = pd.concat(compare._tile_areas([frame[:9], frame[9:]]))
        assert found.sum().tolist() == pytest.approx(expected, rel=1e-12)


def test_odd_boundaries_are_compared_beside_boxes(spark):
    texts = [text(0, 0, 3, 2), "polygon((1e0 1,4. 1 ,4 +3,1.0 3,1 1) )", "POLYGON ((20 0, 24 0, 20 4, 20 0))", "POLYGON EMPTY", None, "x", "POINT (1 1)", text(21, 0, 1, 1)]
    rows = lambda *t: spark.createDataFrame([(i, v) for i, v in enumerate(t)], "feature_index long, geometry string")
    assert tuple(compare.compare_boundaries(spark, rows(*texts), rows(texts[0], texts[7], text(90, 90, 1, 1))).first()) == (round(7 / 19, 6), 12)
    binary = spark.createDataFrame([(1, data(0, 0, 3, 2)), (2, None)], "feature_index long, geometry binary")
    assert tuple(compare.compare_boundaries(spark, binary, rows(text(1, 0, 3, 2))).first()) == (0.5, 4)
    assert tuple(compare.compare_boundaries(spark, rows(None), rows("POLYGON EMPTY")).first()) == (1, 0)


def test_tiles_of_boxes_leave_their_fragments_by_the_batch(monkeypatch):
    """coverage_gap_fill: no overlay for a tile of boxes whose small gaps are of one cell, and the same fragments as the general way."""
    ring = [(0, 0, 2, 1), (2, 0, 3, 2), (1, 2, 3, 3), (0, 1, 1, 3)]
    rows = [(k, *map(float, b), True, 4.0, tx, 0, None) for tx in (0, 5) for k, b in enumerate((4 * tx + a, b, 4 * tx + c, d) for a, b, c, d in ring)]
    frame = pd.DataFrame(rows, columns=["feature_index", "x0", "y0", "x1", "y1", "box", "cell", "tx", "ty", "shape"])
    general = [r for tx in (0, 5) for r in gaps._tile_fragments(frame[frame["tx"] == tx])]
    monkeypatch.setattr(gaps, "_tile_fragments", lambda f: pytest.fail("a tile of boxes was cut by itself"))
    found = pd.concat(gaps._fragments(1.5)([frame[:3], frame[3:]]))
    small = lambda rows: sorted((a, [tuple(map(float, c)) for c in wkb.load(w).polygons[0][0][:-1]]) for t, w, a, s in rows if not t and a < 1.5)
    assert small(found.itertuples(index=False)) == [(a, sorted(c, key=c[0].__eq__, reverse=True)) for a, c in small(general)] == small(general)
    assert sorted(found["area"]) == sorted(r[2] for r in general) == [0, 0, 1, 1, 7, 7]


def test_boxes_take_boxes_by_the_batch(monkeypatch):
    shifts = (0, 20, 40, 60)
    polygons, holes = [data(x, 0, 2, 1) for x in shifts], [data(x + 1, 1, 1, 1) for x in shifts]
    frame = pd.DataFrame({"feature_index": shifts, "l": shifts, "polygon": polygons, "hole": holes})
    expected = [wkb.dump(overlay.region(overlay.union([wkb.load(p).polygons, wkb.load(h).polygons]))) for p, h in zip(polygons, holes)]
    unions, union = [], overlay.union
    monkeypatch.setattr(gaps.overlay, "union", lambda r: unions.append(1) or union(r))
    found = pd.concat(gaps._filled([frame]))
    assert found.values.tolist() == [[x, w, ["Filled 1 of gap."]] for x, w in zip(shifts, expected)]
    assert len(unions) == 2  # one for each order of coordinates in a frame; the last polygon comes in a frame of its own
    alone = pd.concat(gaps._holes(1.5)([pd.DataFrame({"component": shifts, "fragment": shifts, "shape": holes})]))
    assert alone[["feature_index", "area", "x0", "y0", "x1", "y1"]].values.tolist() == [[x, 1, x + 1, 1, x + 2, 2] for x in shifts] and len(unions) == 2
