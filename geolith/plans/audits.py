"""Queries of the reference's kind of operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry as g
from geolith.functions.crs import canonical_crs, reproject
from geolith.geometry.repair import RepairConfig
from geolith.operators import attributes, batch, compare, conflicts, duplicates, engine, metadata, reports, roads, rules, small_polygons, snap, validate
from geolith.operators import repair as repairs
from geolith.operators.profile import ColumnRule
from geolith.operators.tiles import envelope_pairs, prepared, saved, spread
from geolith.plans.derived import as_cte, derived
from geolith.plans.tables import table
from geolith.sources import geoparquet
from geolith.sources.geoparquet import predicate
from geolith.storage import Scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def boxes(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table of boxes as features."""
    return derived(spark, folder, name).withColumn("geometry", g.box_wkt(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).withColumnRenamed("idx", "feature_index")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's vertices in one array; an order has a handful of lines."""
    v = derived(spark, folder, "line_vertices")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return v.groupBy(F.col("idx").alias("feature_index")).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return paths(spark, folder).withColumn("geometry", g.line_wkt(F.col("path")))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return derived(spark, folder, "roads").select(F.col("idx").alias("feature_index"), g.line_wkt(F.array(p("xa", "ya"), p("xb", "yb"))).alias("geometry"))


# Scan with projection and all predicate operators
@query(
    """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 400000 AND o_orderkey >= 10 AND o_custkey < 1000000 AND o_orderstatus <> 'X'
AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_orderdate IS NOT NULL AND NOT (o_custkey IS NULL) AND o_orderpriority = '1-URGENT'"""
)
def scan_project_filter(spark, folder):
    df = table(spark, folder, "orders")
    for p in (
        ("o_totalprice", ">", 50000), ("o_totalprice", "<=", 400000), ("o_orderkey", ">=", 10), ("o_custkey", "<", 1000000), ("o_orderstatus", "!=", "X"), ("o_orderstatus", "in", ["F", "O"]),
        ("o_orderpriority", "not in", ["5-LOW"]), ("o_orderdate", "is not null"), ("o_custkey", "is not null"), ("o_orderpriority", "==", "1-URGENT"),
    ):
        df = df.where(predicate(*p))
    return df.select("o_orderkey", "o_totalprice")


# Features written as GeoParquet and scanned again, with and without predicates
@query(as_cte("parcels") + " SELECT count(*) AS features, 0 AS first_index, count(*) - 1 AS last_index, count(*) FILTER (x0 > 30) AS kept, count(*) FILTER (x0 > 30) - 1 AS last_kept, sum((x1 - x0) * (y1 - y0)) AS area FROM parcels")
def geoparquet_round_trip(spark, folder):
    path = re.sub(r"^file:(//)?", "", Scratch(spark, "geoparquet").root) + ".parquet"
    features = prepared(boxes(spark, folder, "parcels")).select(F.col("shape").alias("geometry"), "x0", "area")
    geoparquet.write(features, path, crs="EPSG:4326")
    every = geoparquet.scan(spark, path, ["area"], include_geometry=False).agg(F.count(F.lit(1)).alias("features"), F.min("feature_index").alias("first_index"), F.max("feature_index").alias("last_index"), F.sum("area").alias("area"))
    some = geoparquet.scan(spark, path, ["area"], [("x0", ">", 30)], include_geometry=False).agg(F.count(F.lit(1)).alias("kept"), F.max("feature_index").alias("last_kept"))
    return every.crossJoin(some)  # one row each


# Places of rows in an order
@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS feature_index FROM orders")
def row_positions(spark, folder):
    return reports.numbered(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "feature_index").select("o_orderkey", "feature_index")


# Geometry scalars in SQL
@query(
    as_cte("line_vertices")
    + """, v AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_vertices WINDOW w AS (PARTITION BY idx ORDER BY seq))
SELECT idx AS feature_index, count(*) AS vertices, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 6) AS length, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
  round(abs(coalesce(sum(px * y - x * py), 0) / 2), 6) AS area, count(*) FILTER (px IS NULL OR px <> x OR py <> y) AS without_repeats FROM v GROUP BY idx"""
)
def geometry_scalars(spark, folder):
    p, b = F.col("path"), g.bounds(F.col("path"))
    return paths(spark, folder).select(
        "feature_index", F.size(p).cast("bigint").alias("vertices"), F.round(g.length(p), 6).alias("length"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"),
        F.round(g.area(p), 6).alias("area"), F.size(g.without_repeats(p)).cast("bigint").alias("without_repeats"),
    )


# G01, G02, G05-G10 by the kernel: measures of boxes
@query(as_cte("parcels") + " SELECT idx AS feature_index, 'POLYGON' AS kind, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS length, x0, y0, x1, y1 FROM parcels")
def kernel_measures(spark, folder):
    return prepared(boxes(spark, folder, "parcels")).drop("shape", "fault")


# R01e in the JVM: repeated vertices anywhere
@query(
    as_cte("line_vertices")
    + """, c AS (SELECT idx, count(*) AS n, count(DISTINCT (x, y)) AS d, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS ends FROM line_vertices GROUP BY idx)
SELECT idx AS feature_index FROM c WHERE d < n - CASE WHEN ends AND n > 2 THEN 1 ELSE 0 END"""
)
def repeated_vertices(spark, folder):
    return paths(spark, folder).where(g.has_repeated_vertex(F.col("path"))).select("feature_index")


_CROSSING = """, s AS (SELECT idx, row_number() OVER w AS k, px, py, x, y FROM (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM line_vertices WINDOW v AS (PARTITION BY idx ORDER BY seq)) WHERE px IS NOT NULL AND (px <> x OR py <> y) WINDOW w AS (PARTITION BY idx ORDER BY seq)),
p AS (SELECT a.idx, b.k - a.k AS gap, a.k AS ak, b.k AS bk, max(b.k) OVER (PARTITION BY a.idx) AS last, a.px, a.py, a.x, a.y, b.px AS qx, b.py AS qy, b.x AS rx, b.y AS ry,
  sign((a.x - a.px) * (b.py - a.py) - (a.y - a.py) * (b.px - a.px)) AS d1, sign((a.x - a.px) * (b.y - a.py) - (a.y - a.py) * (b.x - a.px)) AS d2,
  sign((b.x - b.px) * (a.py - b.py) - (b.y - b.py) * (a.px - b.px)) AS d3, sign((b.x - b.px) * (a.y - b.py) - (b.y - b.py) * (a.x - b.px)) AS d4
  FROM s a JOIN s b ON a.idx = b.idx AND a.k < b.k),
m AS (SELECT *, d1 * d2 <= 0 AND d3 * d4 <= 0 AND greatest(px, x) >= least(qx, rx) AND greatest(qx, rx) >= least(px, x) AND greatest(py, y) >= least(qy, ry) AND greatest(qy, ry) >= least(py, y) AS meet,
  d1 = 0 AND d2 = 0 AND (least(greatest(px, x), greatest(qx, rx)) > greatest(least(px, x), least(qx, rx)) OR least(greatest(py, y), greatest(qy, ry)) > greatest(least(py, y), least(qy, ry))) AS lap FROM p),
crossing AS (SELECT DISTINCT idx FROM m WHERE meet AND (lap OR NOT (gap = 1 OR (ak = 1 AND bk = last AND rx = px AND ry = py AND (SELECT true)))))"""


# Counts of issues over all lines
@query(
    as_cte("line_vertices")
    + _CROSSING
    + """, c AS (SELECT idx, count(*) AS n, count(DISTINCT (x, y)) AS d, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS ends FROM line_vertices GROUP BY idx)
SELECT 'duplicate_vertex' AS issue_type, count(*) AS features FROM c WHERE n > 1 AND d < n - CASE WHEN ends AND n > 2 THEN 1 ELSE 0 END
UNION ALL SELECT 'invalid_geometry', count(*) FROM c WHERE d = 1
UNION ALL SELECT 'self_intersection', count(*) FROM crossing"""
)
def validate_issue_counts(spark, folder):
    return validate.issue_counts(validate.validate(lines(spark, folder)))


@query(as_cte("line_vertices") + _CROSSING + ' SELECT idx AS feature_index FROM crossing')
def lines_self_intersection(spark, folder):
    found = validate.validate(lines(spark, folder))
    return found.where(F.exists("issues", lambda i: i["issue_type"] == "self_intersection")).select("feature_index")


_LINE_FACTS = """, c AS (SELECT idx, count(*) AS n, count(DISTINCT (x, y)) AS d, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS ends FROM line_vertices GROUP BY idx),
bad AS (SELECT idx, d = 1 AS invalid, idx IN (SELECT idx FROM crossing) AS crossed, n > 1 AND d < n - CASE WHEN ends AND n > 2 THEN 1 ELSE 0 END AS repeated FROM c)"""


# Audit and a bounded list of findings
@query(
    as_cte("line_vertices")
    + _CROSSING
    + _LINE_FACTS
    + " SELECT count(*) AS feature_count, count(*) FILTER (invalid OR crossed OR repeated) AS invalid_feature_count, least(1000, count(*) FILTER (invalid OR crossed OR repeated)) AS findings_listed, count(*) FILTER (invalid OR crossed OR repeated) > 1000 AS findings_truncated FROM bad"
)
def validate_audit(spark, folder):
    return validate.audit_dataset(lines(spark, folder), crs="EPSG:4326", require_crs=True, require_features=True).summary


@query(
    as_cte("line_vertices")
    + _CROSSING
    + _LINE_FACTS
    + """ SELECT idx AS feature_index, concat_ws(',', CASE WHEN invalid THEN 'invalid_geometry' END, CASE WHEN crossed THEN 'self_intersection' END, CASE WHEN repeated THEN 'duplicate_vertex' END) AS issues
FROM bad WHERE invalid OR crossed OR repeated ORDER BY idx LIMIT 1000"""
)
def validate_findings(spark, folder):
    found = validate.audit_dataset(lines(spark, folder)).findings
    return found.select("feature_index", F.array_join(F.transform("issues", lambda i: i["issue_type"]), ",").alias("issues"))


# R01 on the delivered copies: every geometry of a snapshot
@query()
def validate_snapshot(spark, folder):
    return validate.issue_counts(validate.validate(table(spark, folder, "snapshot_left").select("feature_key", F.col("geometry_wkt").alias("geometry"))))


# Repair of lines
@query(
    as_cte("line_vertices")
    + """, v AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_vertices WINDOW w AS (PARTITION BY idx ORDER BY seq))
SELECT idx AS feature_index, CASE WHEN count(*) = 1 THEN 'failed' WHEN count(*) FILTER (px IS NULL OR px <> x OR py <> y) = count(*) THEN 'unchanged' ELSE 'repaired' END AS status,
  CASE WHEN count(*) > 1 THEN count(*) FILTER (px IS NULL OR px <> x OR py <> y) END AS vertex_count_after FROM v GROUP BY idx"""
)
def repair_lines(spark, folder):
    return repairs.repair_geometries_alone(lines(spark, folder)).select("feature_index", "status", "vertex_count_after")


_KEPT = """, v AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_vertices WINDOW w AS (PARTITION BY idx ORDER BY seq)),
l AS (SELECT idx, count(*) AS n, count(DISTINCT (x, y)) AS d, greatest(2, count(*) FILTER (px IS NULL OR px <> x OR py <> y)) AS kept FROM v GROUP BY idx)"""


@query(
    as_cte("line_vertices")
    + _KEPT
    + """ SELECT count(*) AS total_count, count(*) FILTER (n > 1 AND (kept < n OR d = 1)) AS repaired_count, count(*) FILTER (n > 1 AND kept = n AND d > 1) AS unchanged_count, count(*) FILTER (n = 1) AS failed_count, 0.0::double AS total_area_delta, 0.0::double AS max_shape_shift FROM l"""
)
def repair_report(spark, folder):
    return repairs.repair_report(repairs.repair_geometries_alone(lines(spark, folder)))


@query(
    as_cte("line_vertices")
    + _KEPT
    + " SELECT 'duplicate_vertex' AS issue_type, count(*) AS actions FROM l WHERE n > 1 AND kept < n UNION ALL SELECT 'self_intersection', count(*) FROM l WHERE n > 1 AND d = 1"
)
def repair_action_counts(spark, folder):
    return repairs.action_counts(repairs.repair_geometries_alone(lines(spark, folder)))


_CELLS = """, cells AS (SELECT idx, cx, cy FROM (SELECT idx, y0, y1, unnest(range(x0::bigint, x1::bigint)) AS cx FROM parcels) t, unnest(range(y0::bigint, y1::bigint)) AS u(cy)),
owned AS (SELECT idx, count(*) AS cells FROM (SELECT cx, cy, min(idx) AS idx FROM cells GROUP BY cx, cy) GROUP BY idx)"""


# The later box loses what an earlier one covers
@query(
    as_cte("parcels")
    + _CELLS
    + """ SELECT p.idx AS feature_index, CASE WHEN cells IS NULL THEN 'failed' WHEN cells < (x1 - x0) * (y1 - y0) THEN 'repaired' ELSE 'unchanged' END AS status,
  round(coalesce(cells, (x1 - x0) * (y1 - y0)), 6) AS area_after FROM parcels p LEFT JOIN owned o ON o.idx = p.idx"""
)
def coverage_overlap_erase(spark, folder):
    out = repairs.repair_coverage(spark, boxes(spark, folder, "parcels"), RepairConfig(fill_gaps=False))
    return out.select("feature_index", "status", F.round("area_after", 6).alias("area_after"))


# Limits of a repair
@query(
    as_cte("parcels")
    + _CELLS
    + """ SELECT CASE WHEN cells IS NULL OR (a - cells) / a > 0.25 THEN 'failed' WHEN cells < a THEN 'repaired' ELSE 'unchanged' END AS status, count(*) AS features
FROM (SELECT idx, (x1 - x0) * (y1 - y0) AS a FROM parcels) p LEFT JOIN owned USING (idx) GROUP BY 1"""
)
def repair_safety(spark, folder):
    out = repairs.repair_coverage(spark, boxes(spark, folder, "parcels"), RepairConfig(fill_gaps=False, max_relative_area_change=0.25))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("features"))


# Rings of boxes around a hole of area 1; the rings touch, so that all features are one component
@query("SELECT count(*) * 4 AS features, count(*) AS filled, count(*) * 9.0 AS area FROM customer")
def coverage_gap_fill(spark, folder):
    k = F.col("c_custkey")
    parts = [(0, 0, 2, 1), (2, 0, 3, 2), (1, 2, 3, 3), (0, 1, 1, 3)]
    x, y = 3 * (k % 100), 3 * F.floor(k / 100)
    ring = table(spark, folder, "customer").select(F.explode(F.array(*[F.struct((k * 4 + i).alias("i"), (x + a).alias("x0"), (y + b).alias("y0"), (x + c).alias("x1"), (y + d).alias("y1")) for i, (a, b, c, d) in enumerate(parts)])).alias("b"))
    features = ring.select(F.col("b.i").alias("feature_index"), g.box_wkt(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1")).alias("geometry"))
    out = repairs.repair_coverage(spark, features, RepairConfig(gap_area_threshold=1.5))
    return out.agg(F.count(F.lit(1)).alias("features"), F.count(F.when(F.exists("actions", lambda a: a["issue_type"] == "gap"), 1)).alias("filled"), F.sum("area_after").alias("area"))


_GAP = "greatest(greatest(a.x0, b.x0) - least(a.x1, b.x1), 0) AS dx, greatest(greatest(a.y0, b.y0) - least(a.y1, b.y1), 0) AS dy"


# Neighbours to snap to
@query(as_cte("blocks") + f" SELECT l, r FROM (SELECT a.idx AS l, b.idx AS r, {_GAP} FROM blocks a JOIN blocks b ON a.idx < b.idx) WHERE sqrt(dx * dx + dy * dy) > 0 AND sqrt(dx * dx + dy * dy) <= 1")
def snap_candidates(spark, folder):
    return snap.snap_pairs(prepared(boxes(spark, folder, "blocks")), 1.0)


@query()
def snap_boundaries(spark, folder):
    out = snap.snap_boundaries(boxes(spark, folder, "blocks"), snap.SnapConfig(tolerance=1.0, max_relative_area_change=0.5, max_shape_shift=1.5))
    return out.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("features"), F.round(F.sum(F.col("area_after") - F.col("area_before")), 6).alias("area_delta"))


_ENDS = ", ends AS (SELECT idx, xa AS x, ya AS y, xa, ya, xb, yb FROM roads UNION ALL SELECT idx, xb, yb, xa, ya, xb, yb FROM roads), dead AS (SELECT * FROM ends WHERE (x, y) IN (SELECT (x, y) FROM ends GROUP BY x, y HAVING count(*) = 1))"


# R07a, R07b, J06
@query(as_cte("roads") + _ENDS + " SELECT idx AS feature_index, x, y FROM dead")
def road_dead_ends(spark, folder):
    found = roads.road_findings(segments(spark, folder)).where("issue_type = 'dead_end'")
    return found.select(F.col("feature_indices")[0].alias("feature_index"), "x", "y")


@query(as_cte("roads") + _ENDS + " SELECT idx AS feature_index, x, y, round(sqrt((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb)), 6) AS metric FROM dead WHERE sqrt((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb)) <= 1.5")
def road_dangling(spark, folder):
    found = roads.road_findings(segments(spark, folder), roads.RoadConfig(dangling_length_threshold=1.5)).where("issue_type = 'dangling_road'")
    return found.select(F.col("feature_indices")[0].alias("feature_index"), "x", "y", F.round("metric", 6).alias("metric"))


_NEAR_ROAD = """, gaps AS (SELECT d.idx, d.x, d.y, r.idx AS other, r.xb - r.xa AS ex, r.yb - r.ya AS ey, d.x - r.xa AS wx, d.y - r.ya AS wy FROM dead d JOIN roads r ON r.idx <> d.idx AND r.xa <= d.x + 0.9 AND r.xb >= d.x - 0.9 AND r.ya <= d.y + 0.9 AND r.yb >= d.y - 0.9),
far AS (SELECT *, greatest(0, least(1, (wx * ex + wy * ey) / (ex * ex + ey * ey))) AS t FROM gaps),
near AS (SELECT idx, x, y, other, sqrt((wx - t * ex) * (wx - t * ex) + (wy - t * ey) * (wy - t * ey)) AS d FROM far)
SELECT idx AS feature_index, x, y, round(min(d), 6) AS metric FROM near WHERE d > 1e-12 AND d <= 0.9 GROUP BY idx, x, y"""


# R07c, J07
@query(as_cte("roads") + _ENDS + _NEAR_ROAD)
def road_broken(spark, folder):
    found = roads.road_findings(segments(spark, folder), roads.RoadConfig(connection_tolerance=0.9)).where("issue_type = 'broken_connection' and metric > 1e-12")
    return found.select(F.col("feature_indices")[0].alias("feature_index"), "x", "y", F.round("metric", 6).alias("metric"))


# R07e, J08: segments digitised twice, from two sides of the same table
@query("SELECT 2 * c_custkey AS l, 2 * c_custkey + 1 AS r FROM customer")
def road_duplicates(spark, folder):
    k = F.col("c_custkey")
    a, b = F.struct((5 * k).cast("double").alias("x"), F.lit(0.0).alias("y")), F.struct((5 * k + 3).cast("double").alias("x"), F.lit(4.0).alias("y"))
    both = F.array(F.struct((2 * k).alias("i"), g.line_wkt(F.array(a, b)).alias("g")), F.struct((2 * k + 1).alias("i"), g.line_wkt(F.array(b, a)).alias("g")))
    features = table(spark, folder, "customer").select(F.explode(both).alias("f")).select(F.col("f.i").alias("feature_index"), F.col("f.g").alias("geometry"))
    found = roads.road_findings(features).where("issue_type = 'duplicate_segment'")
    return found.select(F.col("feature_indices")[0].alias("l"), F.col("feature_indices")[1].alias("r"))


# R07d: closed orders' lines are loops
@query(
    as_cte("line_vertices")
    + _CROSSING
    + """, r AS (SELECT idx, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS closed, count(*) AS n FROM line_vertices GROUP BY idx),
g AS (SELECT idx, sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))) AS length FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_vertices WINDOW w AS (PARTITION BY idx ORDER BY seq)) GROUP BY idx)
SELECT idx AS feature_index, round(length, 6) AS metric FROM r JOIN g USING (idx) WHERE closed AND n > 1 AND length <= 40 AND idx NOT IN (SELECT idx FROM crossing)"""
)
def road_loops(spark, folder):
    features = lines(spark, folder).where(F.size("path") > 1).select("feature_index", "geometry")
    return roads.road_findings(features, roads.RoadConfig(max_loop_length=40.0)).where("issue_type = 'loop_error'").select(F.col("feature_indices")[0].alias("feature_index"), F.round("metric", 6).alias("metric"))


# A05
@query(
    as_cte("roads")
    + _ENDS
    + _NEAR_ROAD.replace("SELECT idx AS feature_index, x, y, round(min(d), 6) AS metric FROM near", ", broken AS (SELECT idx FROM near")
    + """), twice AS (SELECT 1 FROM roads a JOIN roads b ON a.idx < b.idx AND ((a.xa, a.ya, a.xb, a.yb) = (b.xa, b.ya, b.xb, b.yb) OR (a.xa, a.ya, a.xb, a.yb) = (b.xb, b.yb, b.xa, b.ya)))
SELECT 'broken_connection' AS issue_type, (SELECT count(*) FROM broken) AS findings UNION ALL SELECT 'dangling_road', (SELECT count(*) FROM dead WHERE sqrt((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb)) <= 1.5)
UNION ALL SELECT 'dead_end', (SELECT count(*) FROM dead) UNION ALL SELECT 'duplicate_segment', (SELECT count(*) FROM twice) UNION ALL SELECT 'loop_error', 0"""
)
def road_issue_counts(spark, folder):
    found = roads.road_findings(segments(spark, folder), roads.RoadConfig(connection_tolerance=0.9, dangling_length_threshold=1.5))
    return roads.road_issue_counts(found.where("issue_type <> 'broken_connection' or metric > 1e-12"))


SMALL = small_polygons.SmallPolygonConfig(sliver_area_threshold=5.0, sliver_compactness_threshold=0.6, tiny_island_area_threshold=4.0, isolation_distance=1.0, noise_area_threshold=1.0, merge_tolerance=0.1)


# R08, J09
@query(
    as_cte("parcels")
    + f""", sized AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, 4 * pi() * (x1 - x0) * (y1 - y0) / pow(2 * (x1 - x0 + y1 - y0), 2) AS compact FROM parcels),
near AS (SELECT DISTINCT i FROM (SELECT a.idx AS i, {_GAP} FROM (SELECT * FROM sized WHERE area <= 4) a JOIN sized b ON a.idx <> b.idx AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 AND b.y0 <= a.y1 + 1 AND b.y1 >= a.y0 - 1) WHERE sqrt(dx * dx + dy * dy) < 1)
SELECT idx AS feature_index, CASE WHEN area <= 1 THEN 'noise_geometry' WHEN area <= 5 AND compact <= 0.6 THEN 'sliver_polygon' ELSE 'tiny_island' END AS issue_type, area, round(compact, 6) AS compactness
FROM sized WHERE area <= 1 OR (area <= 5 AND compact <= 0.6) OR (area <= 4 AND idx NOT IN (SELECT i FROM near))"""
)
def small_polygon_classes(spark, folder):
    out = small_polygons.classify_small(saved(prepared(spread(boxes(spark, folder, "parcels"), "feature_index"))), SMALL)
    return out.select("feature_index", "issue_type", "area", F.round("compactness", 6).alias("compactness"))


# R08, J10, A06
@query()
def small_polygon_recommendations(spark, folder):
    return small_polygons.recommendation_counts(small_polygons.small_polygons(boxes(spark, folder, "parcels"), SMALL))


_BOX_SCORES = """, near AS (SELECT a.idx AS l, b.idx AS r, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM {left} a JOIN {right} b ON {on} AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
corners AS (SELECT *, unnest([{{'x': ax0, 'y': ay0, 's': 0}}, {{'x': ax1, 'y': ay0, 's': 0}}, {{'x': ax0, 'y': ay1, 's': 0}}, {{'x': ax1, 'y': ay1, 's': 0}}, {{'x': bx0, 'y': by0, 's': 1}}, {{'x': bx1, 'y': by0, 's': 1}}, {{'x': bx0, 'y': by1, 's': 1}}, {{'x': bx1, 'y': by1, 's': 1}}]) AS c FROM near),
other AS (SELECT *, c.x AS px, c.y AS py, CASE c.s WHEN 0 THEN bx0 ELSE ax0 END AS ox0, CASE c.s WHEN 0 THEN by0 ELSE ay0 END AS oy0, CASE c.s WHEN 0 THEN bx1 ELSE ax1 END AS ox1, CASE c.s WHEN 0 THEN by1 ELSE ay1 END AS oy1 FROM corners),
away AS (SELECT *, CASE WHEN px > ox0 AND px < ox1 AND py > oy0 AND py < oy1 THEN least(px - ox0, ox1 - px, py - oy0, oy1 - py)
  ELSE sqrt(pow(greatest(ox0 - px, px - ox1, 0), 2) + pow(greatest(oy0 - py, py - oy1, 0), 2)) END AS d FROM other),
h AS (SELECT l, r, ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, max(d) AS d FROM away GROUP BY ALL),
parts AS (SELECT *, least(ax1, bx1) - greatest(ax0, bx0) AS w, least(ay1, by1) - greatest(ay0, by0) AS hh, (ax1 - ax0) * (ay1 - ay0) AS aa, (bx1 - bx0) * (by1 - by0) AS ba,
  sqrt(pow(greatest(ax1, bx1) - least(ax0, bx0), 2) + pow(greatest(ay1, by1) - least(ay0, by0), 2)) AS diag FROM h),
scored AS (SELECT l, r, least(1, CASE WHEN w > 0 AND hh > 0 THEN w * hh / (aa + ba - w * hh) ELSE greatest(w, hh) / (aa + ba) END) AS iou, greatest(0, 1 - d / diag) AS hs, (least(aa, ba) / greatest(aa, ba) + 1) / 2 AS ss FROM parts)"""


# R09, J01, O04
@query(
    as_cte("parcels")
    + _BOX_SCORES.format(left="parcels", right="parcels", on="a.idx < b.idx")
    + """ SELECT l AS left_index, r AS right_index, round(100 * (0.45 * iou + 0.35 * hs + 0.20 * ss), 4) AS similarity_percent, round(iou, 6) AS iou, round(hs, 6) AS hausdorff_similarity, round(ss, 6) AS shape_similarity, iou = 1 AS exact
FROM scored WHERE 0.45 * iou + 0.35 * hs + 0.20 * ss + 1e-12 >= 0.45"""
)
def duplicate_pairs(spark, folder):
    return duplicates.detect_duplicates(boxes(spark, folder, "parcels"), duplicates.DuplicateConfig(similarity_threshold=0.45))


# A07
@query(
    as_cte("parcels")
    + """, n AS (SELECT count(*) AS feature_count FROM parcels), m AS (SELECT count(*) AS candidate_pairs FROM parcels a JOIN parcels b ON a.idx < b.idx AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT feature_count, feature_count * (feature_count - 1) // 2 AS possible_pairs, candidate_pairs, false AS truncated, round(100 * (1 - candidate_pairs / (feature_count * (feature_count - 1) / 2)), 6) AS candidate_reduction_percent FROM n, m"""
)
def duplicate_statistics(spark, folder):
    return duplicates.duplicate_statistics(boxes(spark, folder, "parcels"))


_NEAR_PARCELS = "near AS (SELECT a.idx AS l, b.idx AS r, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1\n  FROM {left} a JOIN {right} b ON {on} AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"


# A cap that cuts the candidates, in the order of their indices
@query(
    as_cte("parcels")
    + _BOX_SCORES.replace(_NEAR_PARCELS, _NEAR_PARCELS[:-1] + " ORDER BY l, r LIMIT 700)").format(left="parcels", right="parcels", on="a.idx < b.idx")
    + " SELECT l AS left_index, r AS right_index, round(100 * (0.45 * iou + 0.35 * hs + 0.20 * ss), 4) AS similarity_percent FROM scored WHERE 0.45 * iou + 0.35 * hs + 0.20 * ss + 1e-12 >= 0.45"
)
def duplicate_pairs_capped(spark, folder):
    config = duplicates.DuplicateConfig(similarity_threshold=0.45, maximum_pairs=700)
    return duplicates.detect_duplicates(boxes(spark, folder, "parcels"), config).select("left_index", "right_index", "similarity_percent")


@query("SELECT count(*) AS feature_count, 700 AS candidate_pairs, true AS truncated FROM orders")
def duplicate_statistics_capped(spark, folder):
    config = duplicates.DuplicateConfig(maximum_pairs=700)
    return duplicates.duplicate_statistics(boxes(spark, folder, "parcels"), config).select("feature_count", "candidate_pairs", "truncated")


# Envelope pairs by tiles
@query(as_cte("parcels") + " SELECT a.idx AS l, b.idx AS r FROM parcels a JOIN parcels b ON a.idx < b.idx AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1")
def tile_join_pairs(spark, folder):
    b = derived(spark, folder, "parcels").withColumnRenamed("idx", "feature_index")
    return envelope_pairs(b, tolerance=1.0)


def _snapshots(spark, folder):
    side = lambda n: boxes(spark, folder, n).withColumn("attributes", F.create_map(F.lit("brand"), "brand", F.lit("kind"), "kind"))
    return side("lattice_old"), side("lattice_new")


_COMPARED = (
    as_cte("lattice_old", "lattice_new")
    + _BOX_SCORES.format(left="lattice_old", right="lattice_new", on="true")
    + """, matched AS (SELECT *, (iou + hs + ss) / 3 AS score FROM scored WHERE (iou + hs + ss) / 3 >= 0.5)
SELECT CASE WHEN iou = 1 AND o.brand = n.brand AND o.kind = n.kind THEN 'unchanged' ELSE 'modified' END AS kind, l AS left_index, r AS right_index, round(100 * score, 4) AS geometry_similarity_percent, CASE WHEN o.brand <> n.brand THEN 'brand' ELSE '' END AS changed
FROM matched JOIN lattice_old o ON o.idx = l JOIN lattice_new n ON n.idx = r
UNION ALL SELECT 'removed', idx, NULL, 0, '' FROM lattice_old WHERE idx NOT IN (SELECT l FROM matched)
UNION ALL SELECT 'added', NULL, idx, 0, '' FROM lattice_new WHERE idx NOT IN (SELECT r FROM matched)"""
)


# R10, J02, J03, J14
@query(_COMPARED)
def compare_features(spark, folder):
    out = compare.compare_features(spark, *_snapshots(spark, folder))
    return out.select("kind", "left_index", "right_index", "geometry_similarity_percent", F.array_join("changed_attributes", ",").alias("changed"))


# A08
@query(f"SELECT kind, count(*) AS features FROM ({_COMPARED}) GROUP BY kind")
def compare_counts(spark, folder):
    return compare.compare_features(spark, *_snapshots(spark, folder)).groupBy("kind").agg(F.count(F.lit(1)).alias("features"))


# U02, J14
@query("SELECT unnest(['added', 'changed', 'removed']) AS change, unnest(['checked', 'geometry', 'feature_index']) AS field")
def compare_schemas(spark, folder):
    left = {f.name: f.dataType.simpleString() for f in boxes(spark, folder, "lattice_old").schema}
    right = {k: v for k, v in left.items() if k != "feature_index"} | {"checked": "boolean", "geometry": "binary"}
    found = compare.compare_schemas(left, right)
    return spark.createDataFrame([(k.removeprefix("schema_"), f) for k, v in found.items() for f in v], "change string, field string")


# A18
@query(
    as_cte("lattice_old", "lattice_new")
    + """, t AS (SELECT (SELECT sum((x1 - x0) * (y1 - y0)) FROM lattice_old) AS a, (SELECT sum((x1 - x0) * (y1 - y0)) FROM lattice_new) AS b,
  (SELECT sum(greatest(0, least(o.x1, n.x1) - greatest(o.x0, n.x0)) * greatest(0, least(o.y1, n.y1) - greatest(o.y0, n.y0))) FROM lattice_old o JOIN lattice_new n ON o.x0 < n.x1 AND n.x0 < o.x1 AND o.y0 < n.y1 AND n.y0 < o.y1) AS c)
SELECT round(c / (a + b - c), 6) AS boundary_iou, round(a + b - 2 * c, 6) AS boundary_difference_area FROM t"""
)
def compare_boundaries(spark, folder):
    return compare.compare_boundaries(spark, *_snapshots(spark, folder))


# parcels are one component, with and without every fifth
@query(
    as_cte("parcels")
    + """, cells AS (SELECT DISTINCT idx % 5 = 0 AS fifth, cx, cy FROM (SELECT idx, y0, y1, unnest(range(x0::bigint, x1::bigint)) AS cx FROM parcels) t, unnest(range(y0::bigint, y1::bigint)) AS u(cy)),
  t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT cx, cy FROM cells)) AS a, (SELECT count(*) FROM cells WHERE NOT fifth) AS b)
SELECT round(b / a, 6) AS boundary_iou, round((a - b)::double, 6) AS boundary_difference_area FROM t"""
)
def compare_boundaries_connected(spark, folder):
    parcels = boxes(spark, folder, "parcels")
    return compare.compare_boundaries(spark, parcels, parcels.where("feature_index % 5 <> 0"))


def _layers(spark, folder):
    layer = lambda n, seq, role: boxes(spark, folder, n).select(F.lit(seq).alias("layer_seq"), F.lit(n).alias("layer_name"), F.lit(role).alias("layer_role"), F.lit(None).cast("string").alias("agency"), "feature_index", "geometry")
    return layer("parcels", 0, "Building").unionByName(layer("rivers", 1, "river"))


_CONFLICTS = """, met AS (SELECT a.idx AS l, b.idx AS r, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS least
  FROM parcels a JOIN rivers b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
found AS (SELECT l, r, least(1, CASE WHEN w > 0 AND h > 0 THEN w * h ELSE greatest(w, h) END / least) AS m FROM met)"""


# R11, J04, O06
@query(as_cte("parcels", "rivers") + _CONFLICTS + " SELECT 'building_in_river' AS conflict_type, 'parcels' AS left_layer, 'rivers' AS right_layer, l AS left_index, r AS right_index, round(least(100, 80 + 20 * m), 2) AS severity_score, round(m, 6) AS magnitude FROM found")
def layer_conflicts(spark, folder):
    return conflicts.analyze_conflicts(_layers(spark, folder))


# A09
@query(as_cte("parcels", "rivers") + _CONFLICTS + " SELECT 'building_in_river' AS conflict_type, count(*) AS conflicts, max(round(least(100, 80 + 20 * m), 2)) AS maximum_severity FROM found")
def conflict_summary(spark, folder):
    return conflicts.conflict_summary(conflicts.analyze_conflicts(_layers(spark, folder)))


_THREE = (("parcels", "Boundary", "a"), ("lattice_old", "boundary", "b"), ("blocks", "zone", "c"))


# Boundaries against boundaries, and layers of other agencies
@query(
    as_cte("parcels", "lattice_old", "blocks")
    + ", met AS ("
    + " UNION ALL ".join(
        f"""SELECT '{kind}' AS conflict_type, '{a}' AS left_layer, '{b}' AS right_layer, {base} AS base, a.idx AS l, b.idx AS r, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS least FROM {a} a JOIN {b} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"""
        for a, b, kind, base in (("parcels", "lattice_old", "boundary_conflict", 55), ("parcels", "blocks", "inter_agency_overlap", 60), ("lattice_old", "blocks", "inter_agency_overlap", 60))
    )
    + """), found AS (SELECT *, least(1, CASE WHEN w > 0 AND h > 0 THEN w * h ELSE greatest(w, h) END / least) AS m FROM met)
SELECT conflict_type, left_layer, right_layer, l AS left_index, r AS right_index, round(least(100, base + 20 * m), 2) AS severity_score, round(m, 6) AS magnitude FROM found"""
)
def layer_conflict_rules(spark, folder):
    layers = [boxes(spark, folder, n).select(F.lit(i).alias("layer_seq"), F.lit(n).alias("layer_name"), F.lit(role).alias("layer_role"), F.lit(agency).alias("agency"), "feature_index", "geometry") for i, (n, role, agency) in enumerate(_THREE)]
    return conflicts.analyze_conflicts(layers[0].unionByName(layers[1]).unionByName(layers[2]))


# R11 on the delivered layers
@query()
def spatial_layer_conflicts(spark, folder):
    t = table(spark, folder, "spatial_layers")
    names = t.select("layer_name").distinct()
    seq = reports.numbered(names, [F.asc("layer_name")], "layer_seq")
    return conflicts.analyze_conflicts(t.join(seq, "layer_name").withColumnRenamed("geometry_wkt", "geometry").withColumn("feature_index", F.col("region_id")))


# R12, A11, W01
@query(
    as_cte("repair_candidates")
    + """, s AS (SELECT issue_id, issue_type, round(0.40 * severity + 0.30 * impact + 0.15 * (100 * area / max(area) OVER ()) + 0.15 * (100 * feature_count / max(feature_count) OVER ()), 2) AS priority_score FROM repair_candidates)
SELECT row_number() OVER (ORDER BY priority_score DESC, issue_id) AS rank, issue_id, priority_score,
  CASE issue_type WHEN 'building_in_river' THEN 'confirm_river' WHEN 'road_river_crossing' THEN 'model_crossing' WHEN 'inter_agency_overlap' THEN 'settle_owner' WHEN 'boundary_conflict' THEN 'settle_boundary' ELSE 'review' END AS action FROM s"""
)
def prioritize_repairs(spark, folder):
    return reports.prioritize(derived(spark, folder, "repair_candidates")).select("rank", "issue_id", "priority_score", "action")


# R13, J15, W03
@query(
    as_cte("crs_sources")
    + """ SELECT seq, uri, crs, (SELECT arg_min(crs, seq) FROM crs_sources WHERE crs IS NOT NULL AND read_error IS NULL) AS baseline,
  CASE WHEN read_error IS NOT NULL THEN 'error' WHEN crs IS NULL THEN 'missing' WHEN crs = (SELECT arg_min(crs, seq) FROM crs_sources WHERE crs IS NOT NULL AND read_error IS NULL) THEN 'consistent' ELSE 'mismatch' END AS status FROM crs_sources"""
)
def crs_scan(spark, folder):
    return metadata.scan_crs(derived(spark, folder, "crs_sources"))


# One CRS in many writings
@query(
    """SELECT n_nationkey AS seq, CASE n_nationkey % 9 WHEN 7 THEN 'missing' WHEN 8 THEN 'error' WHEN 6 THEN 'mismatch' ELSE 'consistent' END AS status,
  CASE n_nationkey % 9 WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 6 THEN 'EPSG:32633' ELSE 'EPSG:4326' END AS canonical FROM nation"""
)
def crs_writings(spark, folder):
    texts = (
        "EPSG:4326", " epsg:4326 ", "urn:ogc:def:crs:EPSG::4326", "http://www.opengis.net/def/crs/EPSG/0/4326", 'GEOGCRS["WGS 84",DATUM["World",ELLIPSOID["WGS 84",6378137,298.257223563]],ID["EPSG",4326]]',
        '{"type": "GeographicCRS", "id": {"authority": "EPSG", "code": 4326}}', 'PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84"]]', "  ", "no system",
    )
    written = F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 9 + 1).cast("int"))
    sources = table(spark, folder, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("uri"), written.alias("crs"), F.lit(None).cast("string").alias("read_error"))
    return metadata.scan_crs(sources).select("seq", "status", canonical_crs(F.col("crs")).alias("canonical"))


# Longitudes and latitudes as metres and back
@query(
    """WITH p AS (SELECT DISTINCT point_id, longitude, latitude FROM survey_points WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -85 AND 85)
SELECT point_id, round(6378137.0 * radians(longitude), 2) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(latitude) / 2)), 2) AS y, true AS back FROM p"""
)
def reproject_points(spark, folder):
    p = table(spark, folder, "survey_points").where("longitude between -180 and 180 and latitude between -85 and 85").select("point_id", "longitude", "latitude").distinct()
    x, y = reproject(F.col("longitude"), F.col("latitude"), "EPSG:4326", "EPSG:3857")
    p = p.select("*", x.alias("x"), y.alias("y"))
    lon, lat = reproject(F.col("x"), F.col("y"), "EPSG:3857", "EPSG:4326")
    back = (F.abs(lon - F.col("longitude")) < 1e-9) & (F.abs(lat - F.col("latitude")) < 1e-9)
    return p.select("point_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), back.alias("back"))


# A21
@query("SELECT 25 AS datasets, (SELECT count(*) FROM nation WHERE n_nationkey % 13 <> 12 AND n_nationkey % 6 <> 0 AND (n_regionkey = 2) <> (SELECT arg_min(n_regionkey, n_nationkey) = 2 FROM nation WHERE n_nationkey % 13 <> 12 AND n_nationkey % 6 <> 0)) AS mismatched, false AS is_consistent")
def crs_consistent(spark, folder):
    return metadata.crs_consistent(metadata.scan_crs(derived(spark, folder, "crs_sources")))


# R14, F01
@query(
    """SELECT n_nationkey AS audit_id, (i * 4 + j)::int AS sample_id, round(n_nationkey - 5 + i * 10.0 / 3, 6) AS longitude, round(n_regionkey - 2 + j * 4.0 / 3, 6) AS latitude FROM nation, range(4) a(i), range(4) b(j)"""
)
def datum_grid(spark, folder):
    areas = table(spark, folder, "nation").select(F.col("n_nationkey").alias("audit_id"), (F.col("n_nationkey") - 5.0).alias("west"), (F.col("n_regionkey") - 2.0).alias("south"), (F.col("n_nationkey") + 5.0).alias("east"), (F.col("n_regionkey") + 2.0).alias("north"))
    return metadata.datum_grid(areas, 4).select("audit_id", "sample_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


# R14, A10
@query(as_cte("datum_samples") + " SELECT audit_id, count(*) AS samples, round(max(displacement_m), 6) AS maximum_shift_m, round(avg(displacement_m), 6) AS mean_shift_m, count(*) FILTER (displacement_m > 5) AS abnormal_samples, CASE WHEN max(displacement_m) > 5 THEN 'abnormal' ELSE 'normal' END AS status FROM datum_samples GROUP BY audit_id")
def datum_status(spark, folder):
    out = metadata.datum_shifts(derived(spark, folder, "datum_samples"))
    return out.withColumns({c: F.round(c, 6) for c in ("maximum_shift_m", "mean_shift_m")})


# R14 quality
@query(
    """SELECT s_suppkey AS audit_id, CASE WHEN s_suppkey % 4 = 1 AND s_nationkey % 5 <> 0 AND abs(s_acctbal) / 1000 <= 5 THEN 'reliable' ELSE 'warning' END AS quality FROM supplier"""
)
def datum_quality(spark, folder):
    s = table(spark, folder, "supplier")
    e = s.select(F.col("s_suppkey").alias("audit_id"), (F.col("s_suppkey") % 4 == 1).alias("best_available"), F.lit(False).alias("ballpark"), F.when(F.col("s_nationkey") % 5 == 0, F.array(F.lit("grid"))).otherwise(F.array().cast("array<string>")).alias("missing_grids"), (F.abs("s_acctbal") / 1000).alias("accuracy_m"))
    return metadata.transformation_quality(e).select("audit_id", "quality")


# Geodesic lengths along the equator and meridians
@query("SELECT c_custkey, round(6378137.0 * radians(c_custkey % 90), 3) AS meters FROM customer")
def geodesic_equator(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.round(metadata.geodesic_distance(F.lit(10.0), F.lit(0.0), F.lit(10.0) + F.col("c_custkey") % 90, F.lit(0.0)), 3).alias("meters"))


_AXIS = as_cte("axis_bounds") + ", v AS (SELECT *, min_x >= -180 AND max_x <= 180 AND min_y >= -90 AND max_y <= 90 AND min_x < max_x AND min_y < max_y AS a, min_y >= -180 AND max_y <= 180 AND min_x >= -90 AND max_x <= 90 AND min_x < max_x AND min_y < max_y AS b FROM axis_bounds)"


# R15
@query(_AXIS + " SELECT dataset_id, CASE WHEN a AND NOT b THEN 'correct' WHEN b AND NOT a THEN 'likely_swapped' WHEN a AND b THEN 'ambiguous' ELSE 'invalid' END AS status FROM v")
def axis_order(spark, folder):
    return metadata.axis_order(derived(spark, folder, "axis_bounds")).select("dataset_id", "status")


# With an expected area
@query(
    _AXIS
    + """, m AS (SELECT dataset_id, a AND greatest(min_x, 20) < least(max_x, 60) AND greatest(min_y, 0) < least(max_y, 30) AS a, b AND greatest(min_y, 20) < least(max_y, 60) AND greatest(min_x, 0) < least(max_x, 30) AS b FROM v)
SELECT dataset_id, CASE WHEN a AND NOT b THEN 'correct' WHEN b AND NOT a THEN 'likely_swapped' WHEN a AND b THEN 'ambiguous' ELSE 'invalid' END AS status FROM m"""
)
def axis_order_expected(spark, folder):
    b = derived(spark, folder, "axis_bounds").withColumns({f"expected_{k}": F.lit(float(v)) for k, v in (("west", 20), ("south", 0), ("east", 60), ("north", 30))})
    return metadata.axis_order(b).select("dataset_id", "status")


ATTRIBUTE_RULES = (ColumnRule("id", "integer", False, True), ColumnRule("status", "string", False), ColumnRule("price", "integer"), ColumnRule("created_at", "integer"), ColumnRule("owner", "string"))
_RAW = "WITH raw AS (SELECT o_orderkey AS row_position, o_custkey AS id, nullif(o_orderstatus, 'P') AS status, o_totalprice AS price, o_orderdate AS created_at FROM orders)"


# Typed columns
@query(
    _RAW
    + """ SELECT 'missing_column' AS issue_type, 'owner' AS column_name, NULL AS row_position UNION ALL SELECT 'schema_drift', NULL, NULL
UNION ALL SELECT 'null_value', 'status', row_position FROM raw WHERE status IS NULL UNION ALL SELECT 'invalid_data_type', 'price', row_position FROM raw UNION ALL SELECT 'invalid_data_type', 'created_at', row_position FROM raw
UNION ALL SELECT 'duplicate_id', 'id', row_position FROM (SELECT row_position, count(*) OVER (PARTITION BY id) AS n FROM raw) WHERE n > 1"""
)
def attribute_scan(spark, folder):
    o = table(spark, folder, "orders")
    raw = o.select(F.col("o_orderkey").alias("row_position"), F.col("o_custkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"))
    return attributes.scan_attributes(raw, ATTRIBUTE_RULES).select("issue_type", "column_name", "row_position")


# Values of mixed kinds
@query("SELECT event_id AS row_position FROM events WHERE event_id % 3 <> 0")
def attribute_mixed_types(spark, folder):
    e = table(spark, folder, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))).otherwise(F.lit("true"))
    mixed = e.select(F.col("event_id").alias("row_position"), F.parse_json(text).alias("v"))
    return attributes.scan_attributes(mixed, (ColumnRule("v", "integer"),)).select("row_position")


# R17, R18
@query("SELECT 0 AS rule_seq, 'dataset.not_empty' AS rule_id, 'passed' AS status, 0 AS findings, NULL AS error UNION ALL SELECT 1, 'price.low', CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END, count(*), NULL FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 2, 'broken', 'error', 0, 'no such check'")
def rule_results(spark, folder):
    def low(df):
        return df.where("o_totalprice < 2000").select(F.lit("low price").alias("message"), F.col("o_orderkey").cast("string").alias("feature_id"))

    def broken(df):
        raise ValueError("no such check")

    registry = rules.RuleRegistry([rules.not_empty(), rules.Rule("price.low", "Low prices", low), rules.Rule("broken", "Broken", broken)])
    return rules.run_rules(table(spark, folder, "orders"), registry)


# The findings of rules; one fails in its tasks and leaves the others alone
@query("SELECT 0 AS rule_seq, 'price.low' AS rule_id, 'low price' AS message, o_orderkey::varchar AS feature_id FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 2, 'price.high', 'high price', o_orderkey::varchar FROM orders WHERE o_totalprice > 400000")
def rule_findings(spark, folder):
    def found(condition, message):
        return lambda df: df.where(condition).select(F.lit(message).alias("message"), F.col("o_orderkey").cast("string").alias("feature_id"))

    def fails(df):
        return df.select(F.raise_error(F.lit("fails in a task")).cast("string").alias("message"), F.col("o_orderkey").cast("string").alias("feature_id"))

    registry = rules.RuleRegistry([rules.Rule("price.low", "Low prices", found("o_totalprice < 2000", "low price")), rules.Rule("fails", "Fails", fails), rules.Rule("price.high", "High prices", found("o_totalprice > 400000", "high price"))])
    return rules.execute_rules(table(spark, folder, "orders"), registry).findings


# Results of chunks merged
@query(
    """WITH p AS (SELECT user_id, event_type AS rule_id, count(*) AS n FROM events GROUP BY ALL)
SELECT 0 AS rule_seq, rule_id, CASE WHEN rule_id = 'error' THEN 'error' ELSE 'failed' END AS status, CASE WHEN rule_id = 'error' THEN 0 ELSE sum(n) END AS findings, CASE WHEN rule_id = 'error' THEN string_agg('part ' || user_id, '; ' ORDER BY user_id) END AS error FROM p GROUP BY rule_id"""
)
def rule_merge(spark, folder):
    p = table(spark, folder, "events").groupBy(F.col("user_id").alias("part"), F.col("event_type").alias("rule_id")).agg(F.count(F.lit(1)).alias("findings"))
    bad = F.col("rule_id") == "error"
    return rules.merge_results(p.select(F.lit(0).alias("rule_seq"), "part", "rule_id", F.when(bad, "error").otherwise("failed").alias("status"), F.when(bad, 0).otherwise(F.col("findings")).alias("findings"), F.when(bad, F.concat(F.lit("part "), F.col("part").cast("string"))).alias("error")))


# R19, R20
@query(
    as_cte("profiles")
    + """, d AS (SELECT seq, list_filter([CASE WHEN estimated_memory_bytes > coalesce(least(536870912, floor(available_memory_bytes * 0.35)), 536870912) THEN 'memory' END, CASE WHEN feature_count > 100000 THEN 'feature_count' END,
  CASE WHEN size_bytes > 67108864 THEN 'file_size' END, CASE WHEN average_vertices >= 1000 AND floor(average_vertices * feature_count) >= 20000000 THEN 'complexity' END], lambda x: x IS NOT NULL) AS r FROM profiles)
SELECT seq, CASE WHEN len(r) > 0 THEN 'streaming' ELSE 'in_memory' END AS engine, array_to_string(r, ',') AS reasons FROM d"""
)
def engine_decision(spark, folder):
    return engine.engine_decision(derived(spark, folder, "profiles")).select("seq", "engine", F.array_join("reasons", ",").alias("reasons"))


# R20, F07
@query(
    """SELECT n_nationkey AS seq, greatest(floor(size * CASE n_nationkey % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 6.0 ELSE 4.0 END)::bigint, n_nationkey::bigint * 1000000 * 512) AS estimated FROM (SELECT n_nationkey, 1000003 * n_nationkey AS size FROM nation)"""
)
def memory_estimates(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"))
    k = F.col("seq") % 3
    driver = F.when(k == 0, "GeoJSON").when(k == 1, "GeoParquet").otherwise("other")
    return n.select("seq", engine.estimated_memory(1000003 * F.col("seq"), driver, F.col("seq") * 1000000, F.lit(100)).cast("bigint").alias("estimated"))


# A bounded sample of vertices
@query(as_cte("line_vertices") + ", n AS (SELECT idx, count(*) AS n FROM line_vertices GROUP BY idx HAVING count(*) > 1 ORDER BY idx LIMIT 256) SELECT count(*) AS sampled_features, round(avg(n), 6) AS average_vertices, max(n) AS maximum_vertices FROM n")
def vertex_sample(spark, folder):
    return engine.vertex_sample(lines(spark, folder).where(F.size("path") > 1)).withColumn("average_vertices", F.round("average_vertices", 6))


# Several files, one without geometry and one that is not there
@query(
    """SELECT 0 AS seq, 'succeeded' AS status, (SELECT count(*) FROM snapshot_left) AS features UNION ALL SELECT 1, 'failed', NULL UNION ALL SELECT 2, 'succeeded', (SELECT count(*) FROM feature_geometries)
UNION ALL SELECT 3, 'failed', NULL UNION ALL SELECT 4, 'succeeded', (SELECT count(*) FROM spatial_layers)"""
)
def batch_audit(spark, folder):
    names = ("snapshot_left", "region", "feature_geometries", "not_there", "spatial_layers")
    items = batch.process_files(spark, [f"{folder}/{n}.parquet" for n in names])
    return items.select("seq", "status", F.get_json_object("value", "$.feature_count").cast("bigint").alias("features"))


# A processor of chunks with a collector
@query("SELECT count(*) AS features, sum(len(geometry_wkt)) AS characters FROM snapshot_left")
def chunk_pipeline(spark, folder):
    def process(chunk):
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.utf8_length(chunk.column("geometry_wkt"))
        return pa.RecordBatch.from_arrays([pa.array([chunk.num_rows], pa.int64()), pa.array([pc.sum(sizes).as_py() or 0], pa.int64())], ["n", "c"])

    run = batch.ChunkPipeline(process, "n bigint, c bigint", lambda df: df.agg(F.sum("n").alias("features"), F.sum("c").alias("characters")), chunk_rows=1024)
    return run.run(table(spark, folder, "snapshot_left").select("geometry_wkt"))


# R22, A15
@query(as_cte("audit_runs") + " SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed') = 0 AS is_successful FROM audit_runs")
def batch_totals(spark, folder):
    return reports.batch_totals(derived(spark, folder, "audit_runs"))


# R23, A16
@query(as_cte("audit_runs") + " SELECT count(*) AS audit_count, round(sum(runtime_seconds), 6) AS runtime_seconds, sum(feature_count)::double AS feature_count, round(max(peak_memory_bytes), 6) AS peak_memory_bytes FROM audit_runs")
def benchmark_summary(spark, folder):
    return reports.benchmark_summary(derived(spark, folder, "audit_runs"))


# R24, A12, A13
@query(
    as_cte("quality_issues")
    + """, q AS (SELECT report_id, count(*) AS issue_count, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'critical') AS critical FROM quality_issues GROUP BY 1),
s AS (SELECT *, greatest(0, 100 - info - 5 * warning - 10 * error - 25 * critical)::double AS quality_score FROM q)
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good' WHEN quality_score >= 50 THEN 'Fair' ELSE 'Poor' END AS quality_badge FROM s"""
)
def quality_reports(spark, folder):
    return reports.quality_reports(derived(spark, folder, "quality_issues"))


# A14
@query(as_cte("quality_issues") + ", f AS (SELECT report_id, recommendation, min(pos) AS p FROM quality_issues GROUP BY ALL) SELECT report_id, recommendation, row_number() OVER (PARTITION BY report_id ORDER BY p, recommendation) - 1 AS place FROM f")
def quality_recommendations(spark, folder):
    return reports.recommendations(derived(spark, folder, "quality_issues"))


# A20
@query(as_cte("parcels") + " SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM parcels")
def union_extent(spark, folder):
    return metadata.extent(derived(spark, folder, "parcels"))
