"""Tables of features are never broadcast, however small their files are: a million of them would not fit the driver."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from geolith.geometry.repair import RepairConfig
from geolith.operators import compare, duplicates, roads, small_polygons
from geolith.operators import repair as repairs


@pytest.fixture
def joins(spark):
    """Runs a query and returns how many broadcast joins all its steps had, under a limit that only compressed files keep."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    def run(query):
        before = set(plans())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
        try:
            rows = query().collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return rows, sum(text.split("\n\n")[0].count("BroadcastHashJoin") for k, text in plans().items() if k not in before)

    return run


def grid(spark, n, width=1):
    """n boxes in rows of 50, 2 apart."""
    x, y = 2 * (F.col("id") % 50), 2 * F.floor(F.col("id") / 50)
    text = F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + width, y, x + width, y + 1, x, y + 1, x, y)
    return spark.range(n).select(F.col("id").alias("feature_index"), text.alias("geometry"))


def twice(spark, n):
    one = grid(spark, n)
    return one.union(one.withColumn("feature_index", F.col("feature_index") + n))


def test_duplicates_are_joined_by_sorting(spark, joins):
    rows, broadcast = joins(lambda: duplicates.detect_duplicates(twice(spark, 1500)))
    assert len(rows) == 1500 and broadcast == 0


def test_capped_duplicates_are_joined_by_sorting(spark, joins):
    rows, broadcast = joins(lambda: duplicates.detect_duplicates(twice(spark, 1500), duplicates.DuplicateConfig(maximum_pairs=700)))
    assert len(rows) == 700 and broadcast == 0


def test_road_checks_are_joined_by_sorting(spark, joins):
    x, y = 3 * (F.col("id") % 50), 3 * F.floor(F.col("id") / 50)
    lines = spark.range(3000).select(F.col("id").alias("feature_index"), F.format_string("LINESTRING (%d %d, %d %d)", x, y, x + 2, y).alias("geometry"))
    rows, broadcast = joins(lambda: roads.road_findings(lines, roads.RoadConfig(connection_tolerance=1.0)))
    kinds = [r.issue_type for r in rows]
    assert kinds.count("dead_end") == 6000 and kinds.count("broken_connection") == 5880 and broadcast == 0


def test_road_ends_and_distances_of_all_kinds_of_lines(spark):
    texts = ["LINESTRING (0 0, 2 0)", "MULTILINESTRING ((0 5, 1 5), (4 0, 8 0))", "LINESTRING (-0 20, 1 20, 1 21, 0 20)", "LINESTRING (3 0.5, 3 0.5)"]
    features = spark.createDataFrame(list(enumerate(texts)), "feature_index long, geometry string")
    found = {(r.issue_type, *r.feature_indices): (r.x, r.y, r.metric) for r in roads.road_findings(features, roads.RoadConfig(connection_tolerance=1.2)).collect() if r.issue_type in ("broken_connection", "loop_error")}
    assert found[("broken_connection", 0, 3)] == (2, 0, 1.25**0.5) and found[("broken_connection", 1, 3)] == (4, 0, 1.25**0.5)
    assert ("loop_error", 2) in found


def test_road_lines_are_read_by_many_tasks(spark, tmp_path):
    lines = spark.range(200).select(F.col("id").alias("feature_index"), F.format_string("LINESTRING (%d 0, %d 1)", "id", "id").alias("geometry")).coalesce(1)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("shapes-*/1"))
    roads.road_findings(lines).collect()
    first = min(set(folder.glob("shapes-*/1")) - before, key=lambda p: p.stat().st_ctime)
    assert len(list(first.glob("part-*"))) > 1


def test_compared_features_are_joined_by_sorting(spark, joins):
    one = grid(spark, 1500).withColumn("attributes", F.create_map(F.lit("k"), F.lit("v")))
    for query in (lambda: compare.compare_features(spark, one, one), lambda: compare.compare_features(spark, one, one).groupBy("kind").count()):
        rows, broadcast = joins(query)
        assert {r.kind for r in rows} == {"unchanged"} and broadcast == 0


def test_small_polygons_are_joined_by_sorting(spark, joins):
    rows, broadcast = joins(lambda: small_polygons.small_polygons(grid(spark, 1500), small_polygons.SmallPolygonConfig(tiny_island_area_threshold=2.0, isolation_distance=0.5)))
    assert len(rows) == 1500 and {r.issue_type for r in rows} == {"tiny_island"} and broadcast == 0


def test_coverages_are_joined_by_sorting(spark, joins):
    rows, broadcast = joins(lambda: repairs.repair_coverage(spark, grid(spark, 600, width=3), RepairConfig(fill_gaps=False)))
    assert len(rows) == 600 and broadcast == 0


def test_readers_of_other_road_issues_compare_no_lines(spark):
    lines = spark.range(50).select(F.col("id").alias("feature_index"), F.lit("LINESTRING (0 0, 1 0, 1 1, 0 0)").alias("geometry"))
    loops = roads.road_findings(lines).where("issue_type = 'loop_error'")
    assert "MapInPandas" not in loops._jdf.queryExecution().optimizedPlan().toString() and loops.count() == 50
