import pytest
from pyspark.sql import functions as F

from geolith.errors import DuplicateRuleError, InvalidRuleResultError, RuleExecutionError, UnknownRuleError
from geolith.geometry.repair import RepairConfig
from geolith.operators import attributes, compare, conflicts, duplicates, engine, metadata, reports, roads, rules, small_polygons, snap, validate
from geolith.operators import repair as repairs
from geolith.operators.profile import ColumnRule
from geolith.operators.tiles import envelope_pairs, prepared


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def features(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "feature_index long, geometry string")


def test_audit_of_missing_bad_and_sound_geometries(spark):
    out = validate.validate(features(spark, "POINT (0 0)", "POLYGON ((0 0, 2 2, 0 2, 2 0, 0 0))", None, "rubbish")).cache()
    assert tuple(validate.audit(out).first()) == (4, 3, 3, False) and tuple(validate.audit(out, 2).first()) == (4, 3, 2, True)
    assert {r.issue_type: r.features for r in validate.issue_counts(out).collect()} == {"invalid_geometry": 2, "self_intersection": 1, "empty_geometry": 1}
    assert [r.feature_index for r in validate.findings(out, most=2).collect()] == [1, 2]
    assert tuple(validate.audit(out.limit(0)).first()) == (0, 0, 0, False)


def test_overlaps_gaps_and_safety(spark):
    out = {r.feature_index: r for r in repairs.repair_coverage(spark, features(spark, box(0, 0, 2, 2), box(1, 0, 3, 2))).collect()}
    assert (out[0].area_after, out[1].area_after, out[1].actions[0].issue_type) == (4, 2, "overlap")
    out = {r.feature_index: r for r in repairs.repair_coverage(spark, features(spark, box(0, 0, 2, 2), box(1, 0, 3, 2)), RepairConfig(max_relative_area_change=0.1)).collect()}
    assert (out[1].status, out[1].area_after) == ("failed", 4)
    left = "POLYGON ((0 0, 1 0, 1 0.9, 0.8 0.9, 0.8 1.1, 1 1.1, 1 2, 0 2, 0 0))"
    right = "POLYGON ((1 0, 2 0, 2 2, 1 2, 1 1.1, 1.2 1.1, 1.2 0.9, 1 0.9, 1 0))"
    rows = repairs.repair_coverage(spark, features(spark, left, right), RepairConfig(gap_area_threshold=0.1)).collect()
    assert abs(sum(r.area_after for r in rows) - 4) < 1e-9 and sum(a.issue_type == "gap" for r in rows for a in r.actions) == 1


def test_session_applies_and_undoes(spark):
    session = repairs.RepairSession(spark, features(spark, box(0, 0, 2, 2), box(1, 0, 3, 2)))
    assert not session.can_undo and session.preview() is session.preview()
    session.apply()
    assert session.undo_depth == 1
    session.apply()
    assert session.undo_depth == 1  # nothing left to repair
    session.undo()
    with pytest.raises(IndexError):
        session.undo()


def test_snapping(spark):
    pair = features(spark, box(0, 0, 1, 1), box(1.005, 0, 2.005, 1))
    out = {r.feature_index: r for r in snap.snap_boundaries(pair, snap.SnapConfig(0.01, 0.01)).collect()}
    assert (out[0].status, out[1].status, out[1].snapped_to) == ("unchanged", "repaired", [0]) and abs(out[1].area_after - 1.005) < 1e-9
    out = {r.feature_index: r for r in snap.snap_boundaries(pair, snap.SnapConfig(0.01, 0.001)).collect()}
    assert out[1].status == "unchanged" and "area" in out[1].reason
    with pytest.raises(ValueError):
        snap.snap_boundaries(features(spark, "POINT (0 0)"))


def test_roads(spark):
    lines = features(spark, "LINESTRING (0 0, 1 0)", "LINESTRING (1.005 0, 3 0)", "LINESTRING (10 0, 11 0)", "LINESTRING (11 0, 10 0)", "LINESTRING (20 0, 20.1 0, 20.1 0.1, 20 0.1, 20 0)")
    found = roads.road_findings(lines)
    assert {r.issue_type: r.findings for r in roads.road_issue_counts(found).collect()} == {"broken_connection": 2, "dangling_road": 2, "dead_end": 4, "duplicate_segment": 1, "loop_error": 1}


def test_small_polygons(spark):
    out = small_polygons.small_polygons(features(spark, box(0, 0, 10, 10), box(10, 0, 10.05, 2), box(20, 20, 20.2, 20.2), box(30, 30, 30.01, 30.01)), small_polygons.SmallPolygonConfig(sliver_compactness_threshold=0.1))
    assert sorted((r.feature_index, r.issue_type, r.recommendation) for r in out.collect()) == [(1, "sliver_polygon", "merge"), (2, "tiny_island", "delete"), (3, "noise_geometry", "delete")]
    assert {r.recommendation: r.findings for r in small_polygons.recommendation_counts(out).collect()} == {"delete": 2, "ignore": 0, "merge": 1}


def test_duplicates(spark):
    out = duplicates.detect_duplicates(features(spark, box(0, 0, 2, 2), box(0, 0, 2, 2), box(9, 9, 10, 10)), duplicates.DuplicateConfig(0.9)).collect()
    assert [(r.left_index, r.right_index, r.similarity_percent, r.exact) for r in out] == [(0, 1, 100.0, True)]
    with pytest.raises(ValueError):
        duplicates.detect_duplicates(features(spark, None))
    with pytest.raises(ValueError):
        duplicates.DuplicateConfig(weight_iou=0.9)


def test_comparison(spark):
    a = features(spark, box(0, 0, 1, 1)).withColumn("attributes", F.create_map(F.lit("name"), F.lit("x")))
    b = features(spark, box(0, 0, 1.1, 1), box(50, 0, 51, 1)).withColumn("attributes", F.create_map(F.lit("name"), F.lit("y"), F.lit("code"), F.lit("1")))
    out = sorted(compare.compare_features(spark, a, b).collect(), key=lambda r: r.kind)
    assert [(r.kind, r.left_index, r.right_index, r.changed_attributes) for r in out] == [("added", None, 1, []), ("modified", 0, 0, ["code", "name"])]
    assert compare.compare_schemas({"a": "int", "b": "int"}, {"b": "long", "c": "int"}) == {"schema_added": ["c"], "schema_removed": ["a"], "schema_changed": ["b"]}
    assert compare.compare_boundaries(spark, a, b).first().boundary_iou == round(1 / 2.1, 6)


def test_conflicts_by_role_and_agency(spark):
    rows = [(0, "r", "road", None, 0, "LINESTRING (-1 0, 1 0)"), (1, "w", "River", None, 0, box(-0.2, -1, 0.2, 1)), (2, "b", "building", "x", 0, box(-0.1, -0.1, 0.1, 0.1)), (3, "p", "parcel", "y", 0, box(0.1, 0, 5, 5)), (3, "p", "parcel", "y", 1, box(0, 0, 5, 5))]
    out = conflicts.analyze_conflicts(spark.createDataFrame(rows, "layer_seq int, layer_name string, layer_role string, agency string, feature_index long, geometry string"))
    got = {(r.conflict_type, r.left_layer, r.right_layer, r.right_index): (r.severity_score, r.magnitude) for r in out.collect()}
    assert got[("road_river_crossing", "r", "w", 0)] == (55.0, 0.5) and got[("building_in_river", "w", "b", 0)] == (100.0, 1.0)
    assert ("inter_agency_overlap", "b", "p", 0) in got and len(got) == 4


def test_tiles_keep_every_pair_once(spark):
    import random

    rng = random.Random(7)
    boxes = []
    for i in range(150):
        w, h = 2 ** rng.uniform(-4, 6), 2 ** rng.uniform(-4, 6)
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        boxes.append((i, x, y, x + w, y + h))
    boxes += [(200, 0.0, 0.0, 0.0, 0.0), (201, 0.0, 0.0, 0.0, 0.0), (202, None, None, None, None)]
    df = spark.createDataFrame(boxes, "feature_index long, x0 double, y0 double, x1 double, y1 double")
    for tolerance in (0.0, 3.0):
        t = tolerance
        expected = sorted((a[0], b[0]) for a in boxes[:-1] for b in boxes[:-1] if a[0] < b[0] and a[1] - t <= b[3] and b[1] <= a[3] + t and a[2] - t <= b[4] and b[2] <= a[4] + t)
        assert sorted((r.l, r.r) for r in envelope_pairs(df, tolerance=tolerance).collect()) == expected
    assert prepared(features(spark, "POINT EMPTY", "bad", None)).where("fault is null").count() == 0


def test_rules(spark):
    frame = spark.range(3)
    registry = rules.RuleRegistry([rules.not_empty()])
    with pytest.raises(DuplicateRuleError):
        registry.register(rules.not_empty())
    with pytest.raises(UnknownRuleError):
        registry.select(["x"])
    registry.register(rules.Rule("odd", "Odd", lambda df: df.select("nothing")))
    registry.register(rules.Rule("shape", "Shape", lambda df: df))
    assert [(r.rule_id, r.status) for r in rules.run_rules(frame, registry, ["odd", "dataset.not_empty"]).orderBy("rule_seq").collect()] == [("odd", "error"), ("dataset.not_empty", "passed")]
    assert rules.run_rules(frame.limit(0), registry, ["dataset.not_empty"]).first().status == "failed"
    with pytest.raises(RuleExecutionError):
        rules.run_rules(frame, registry, ["odd"], raise_errors=True)
    with pytest.raises(InvalidRuleResultError):
        rules.run_rules(frame, registry, ["shape"])


def test_metadata_audits(spark):
    sources = spark.createDataFrame([(0, "a", None, None), (1, "b", "EPSG:4326", None), (2, "c", "EPSG:3857", None), (3, "d", None, "broken"), (4, "e", " ", None)], "seq int, uri string, crs string, read_error string")
    assert [r.status for r in metadata.scan_crs(sources).orderBy("seq").collect()] == ["missing", "consistent", "mismatch", "error", "missing"]
    area = spark.createDataFrame([(1, 106.0, -7.0, 108.0, -5.0)], "audit_id int, west double, south double, east double, north double")
    grid = metadata.datum_grid(area).orderBy("sample_id").collect()
    assert len(grid) == 9 and grid[0][2:] == (106.0, -7.0) and grid[1][2:] == (106.0, -6.0) and grid[8][2:] == (108.0, -5.0)
    for bad in (True, 1, 26):
        with pytest.raises(ValueError):
            metadata.datum_grid(area, bad)
    bounds = spark.createDataFrame([(1, 106.0, -7.0, 108.0, -5.0), (2, -7.0, 106.0, -5.0, 108.0), (3, 10.0, 20.0, 11.0, 21.0), (4, 200.0, 100.0, 210.0, 110.0), (5, float("nan"), 0.0, 1.0, 1.0)], "dataset_id int, min_x double, min_y double, max_x double, max_y double")
    assert [r.status for r in metadata.axis_order(bounds).orderBy("dataset_id").collect()] == ["correct", "likely_swapped", "ambiguous", "invalid", "invalid"]


def test_reports_and_engine(spark, tmp_path):
    issues = spark.createDataFrame([(1, "error"), (1, "warning"), (1, "info"), (2, "critical"), (2, "critical"), (2, "critical"), (2, "critical"), (2, "info")], "report_id int, severity string")
    listed = spark.createDataFrame([(1,), (2,), (3,)], "report_id int")
    assert {r.report_id: (r.quality_score, r.quality_badge) for r in reports.quality_reports(issues, listed).collect()} == {1: (84.0, "Good"), 2: (0.0, "Poor"), 3: (100.0, "Excellent")}
    numbered = reports.numbered(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert all(r.n == 999 - r.id for r in numbered)
    for suffix in ("json", "md", "html"):
        assert "a<b" in reports.write_report(tmp_path / f"r.{suffix}", "T", {"n": 1}, [{"x": "a<b"}]).read_text().replace("&lt;", "<")
    assert engine.worker_count(20, cpus=12, available_memory=350, requested=8, bytes_per_worker=100) == 2
    assert engine.worker_count(0) == 1 and engine.worker_count(5, cpus=4, requested=0) == 3 and engine.remaining_seconds(0, 5, 1.0) is None
    recorder = engine.Recorder()
    assert recorder.measure("x", lambda: 5) == 5 and len(recorder.records) == 1


def test_attribute_scan(spark):
    frame = spark.createDataFrame([(0, 7, None, "a"), (1, 7, "n", "b"), (2, 8, "m", "c"), (3, None, "k", "d")], "row_position long, id long, name string, extra string")
    rules_ = [ColumnRule("id", "integer", False, True), ColumnRule("name", "string", False), ColumnRule("score", "float")]
    out = {(r.issue_type, r.column_name, r.row_position) for r in attributes.scan_attributes(frame, rules_).collect()}
    assert out == {("missing_column", "score", None), ("schema_drift", None, None), ("null_value", "name", 0), ("null_value", "id", 3), ("duplicate_id", "id", 0), ("duplicate_id", "id", 1)}


def test_lines_that_repeat_a_stretch_are_duplicates(spark):
    f = features(spark, "LINESTRING (0 0, 10 0)", "LINESTRING (0 0, 10 0, 0 0)", "MULTILINESTRING ((0 0, 10 0), (0 0, 10 0))")
    assert duplicates.detect_duplicates(f, duplicates.DuplicateConfig(similarity_threshold=0.9)).count() == 3
    assert {r.kind for r in compare.compare_features(spark, f.where("feature_index = 0"), f.where("feature_index = 1"), match_threshold=0.9, attributes=None).collect()} <= {"modified", "unchanged"}


def test_boundaries_of_a_connected_layer_are_compared_tile_by_tile(spark, scratch):
    a = features(spark, *[box(x, y, x + 1, y + 1) for x in range(20) for y in range(20)])
    b = features(spark, *[box(x + 0.5, y, x + 1.5, y + 1) for x in range(20) for y in range(20)], "POLYGON ((-3 -3, 30 -3, -3 30, -3 -3))")
    tiles = compare._in_tiles(prepared(b), scratch)
    assert tiles.groupBy("cell", "tx", "ty").count().agg(F.max("count")).first()[0] <= compare.CROWDED + 1
    row = compare.compare_boundaries(spark, a, b).first()
    assert (row.boundary_iou, row.boundary_difference_area) == (round(400 / 635.625, 6), 235.625)


def test_gaps_by_tiles_are_the_holes_of_the_union(spark, scratch):
    import random

    from geolith.geometry import overlay, wkt
    from geolith.operators.gaps import small_gaps
    from geolith.operators.tiles import prepared

    rng = random.Random(12)
    boxes = []
    for k in range(260):
        x, y, big = rng.uniform(0, 40), rng.uniform(0, 40), 12 if k % 40 == 0 else 3
        w, h = rng.uniform(0.3, big), rng.uniform(0.3, big)
        boxes.append(f"POLYGON (({x} {y}, {x + w} {y}, {x + w + 0.3} {y + h}, {x} {y + h}, {x} {y}))")
    boxes += ["POLYGON ((100 0, 140 0, 140 0.001, 100 0.001, 100 0))", "POLYGON ((100 0.001, 100.001 0.001, 100.001 0.002, 100 0.002, 100 0.001))", "POLYGON ((139.999 0.001, 140 0.001, 140 0.002, 139.999 0.002, 139.999 0.001))", "POLYGON ((100 0.002, 140 0.002, 140 0.003, 100 0.003, 100 0.002))"]
    boxes += [f"POLYGON ((0 {50 + i}, 9 {50 + i}, 9 {50.9 + i}, 0 {50.9 + i}, 0 {50 + i}))" for i in range(3)]
    covered = overlay.union([wkt.parse(b).polygons for b in boxes])
    found = 0
    for threshold in (0.5, 40.0):
        expected = sorted(round(overlay.area_of([[h[::-1]]]), 9) for p in covered for h in p[1:] if 1e-12 < overlay.area_of([[h[::-1]]]) < threshold)
        shapes = prepared(features(spark, *boxes)).select("feature_index", "shape", "x0", "y0", "x1", "y1")
        assert sorted(round(r.area, 9) for r in small_gaps(spark, shapes, threshold, scratch).collect()) == expected
        found += len(expected)
    assert found > 5


def test_audit_preconditions(spark):
    from geolith.errors import EmptyLayerError, MissingCrsError

    some = features(spark, "POINT (0 0)", None)
    with pytest.raises(MissingCrsError):
        validate.audit_dataset(some, crs=" ", require_crs=True)
    with pytest.raises(EmptyLayerError):
        validate.audit_dataset(some.limit(0), require_features=True)
    found = validate.audit_dataset(some, crs="EPSG:4326", require_crs=True, require_features=True)
    assert tuple(found.summary.first()) == (2, 1, 1, False) and [r.feature_index for r in found.findings.collect()] == [1] and found.issue_counts.first().issue_type == "empty_geometry"
    assert tuple(validate.audit_dataset(some.limit(0)).summary.first()) == (0, 0, 0, False)


def test_a_rule_that_fails_in_its_tasks(spark):
    frame = spark.createDataFrame([("1",), ("x",)], "v string")
    registry = rules.RuleRegistry([
        rules.Rule("number", "Number", lambda df: df.where(F.col("v").cast("int") > 0).select(F.lit("n").alias("message"), F.col("v").alias("feature_id"))),
        rules.Rule("text", "Text", lambda df: df.where("v = 'x'").select(F.lit("t").alias("message"), F.col("v").alias("feature_id"))),
    ])
    out = rules.execute_rules(frame, registry)
    assert [(r.rule_id, r.status, r.findings) for r in out.results.orderBy("rule_seq").collect()] == [("number", "error", 0), ("text", "failed", 1)]
    assert [tuple(r) for r in out.findings.collect()] == [(1, "text", "t", "x")]
    with pytest.raises(RuleExecutionError):
        rules.execute_rules(frame, registry, ["number"], raise_errors=True)
    assert out.findings.where("rule_id = 'number'").isEmpty() and rules.execute_rules(frame, registry, []).findings.isEmpty()
    assert rules.merge_findings(out.results, out.findings).count() == 1
