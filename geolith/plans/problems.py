"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators.differences import compare_copies, difference_summary
from geolith.operators.drift import SchemaHistory, unified_cells, unified_fields
from geolith.operators.nearby import neighbourhood, points_near_points
from geolith.operators.profile import ColumnRule, ValueCounts, attribute_issues, column_rules, counted_value, delivered_once, profile_metrics, repeated_deliveries, timely_and_late, value_deltas
from geolith.plans.tables import table
from geolith.storage import Scratch


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return compare_copies(table(spark, folder, "snapshot_left"), table(spark, folder, "snapshot_right"))


def p1_summary(spark: SparkSession, folder: str) -> DataFrame:
    return difference_summary(p1_found(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rules = column_rules(table(spark, folder, "attribute_columns"))
    return attribute_issues(table(spark, folder, "attribute_rows"), rules, table(spark, folder, "attribute_loads"), Scratch(spark, "p2"), received="received_at", started="started_at")


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every column of every load, from counts maintained by three signed deltas.

    What arrived within a day of its load's start is counted as it was delivered, then what came later is added, then the
    rows delivered more than once are withdrawn as often as they came and added once.
    """
    rules = [ColumnRule(r.column_name) for r in column_rules(table(spark, folder, "attribute_columns"))]
    rows, loads = table(spark, folder, "attribute_rows"), table(spark, folder, "attribute_loads")
    begun = loads.groupBy(F.col("load_id").alias("of_load")).agg(F.min("started_at").alias("begun"))  # metadata: one row a load
    timed = rows.join(begun, rows["load_id"] == begun["of_load"], "left")
    late = F.coalesce(F.col("received_at") > F.col("begun") + F.expr("interval 24 hours"), F.lit(False))
    values = lambda df: {r.column_name: counted_value(df[r.column_name], r) for r in rules}
    counted = lambda df, sign=1: value_deltas(df, values(df), sign)
    scratch = Scratch(spark, "p2")
    arrived = scratch.save(timely_and_late(timed, values(timed), late))
    kept = ValueCounts(spark, f"{scratch.root}/counts")
    kept.apply(arrived.where("n > 0"), summed=True)
    kept.apply(arrived.where("late_n > 0").select("load_id", "column_name", "value", F.col("late_n").alias("n")))
    again = repeated_deliveries(rows)
    return profile_metrics(kept.apply(counted(again, -1), counted(delivered_once(again, rules))))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbourhood(table(spark, folder, "survey_points"), table(spark, folder, "spatial_layers"))


def p4_near(spark: SparkSession, folder: str) -> DataFrame:
    return points_near_points(table(spark, folder, "survey_points"), 50.0)


def _history(spark: SparkSession, folder: str) -> tuple[SchemaHistory, Scratch]:
    scratch = Scratch(spark, "p5")
    return SchemaHistory(spark, f"{scratch.root}/history").take(table(spark, folder, "schema_files"), table(spark, folder, "file_records"), scratch), scratch


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder)[0].steps.select("file_id", "issue_type", "field_name", "previous_name")


def p5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder)[0].versions.select("series_name", "file_seq", "file_id", "version", "fields", "fingerprint")


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    history, scratch = _history(spark, folder)
    names = scratch.save(unified_fields(history.versions, history.table("types"), history.steps))
    return unified_cells(history.table("records"), names)


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p2_found, p2_profile, p4_found, p4_near, p5_found, p5_fingerprints, p5_unified)}

_ONCE = """
WITH once AS (
  SELECT DISTINCT load_id, row_position, id, name, state, score, price, active, created_at FROM attribute_rows
), cells AS (
  SELECT load_id, row_position, unnest([{'c': 'id', 'v': id}, {'c': 'name', 'v': name}, {'c': 'state', 'v': state}, {'c': 'score', 'v': score},
    {'c': 'price', 'v': price}, {'c': 'active', 'v': active}, {'c': 'created_at', 'v': created_at}]) AS cell FROM once
)"""
_FAULTS = r"""
, ruled AS (
  SELECT load_id, row_position, cell.v AS v, r.*,
    CASE data_type WHEN 'integer' THEN regexp_full_match(cell.v, '[+-]?[0-9]+') WHEN 'float' THEN regexp_full_match(cell.v, '[+-]?[0-9]+(\.[0-9]+)?')
      WHEN 'boolean' THEN cell.v IN ('true', 'false')
      WHEN 'datetime' THEN regexp_full_match(cell.v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z') AND try_cast(substr(cell.v, 1, 10) AS date) IS NOT NULL
      ELSE true END AS good
  FROM cells JOIN attribute_columns r ON r.column_name = cell.c
), sized AS (
  SELECT *, CASE WHEN good AND data_type IN ('integer', 'float') THEN try_cast(v AS double) END AS num FROM ruled
), counted AS (
  SELECT load_id, column_name, CASE WHEN v IS NULL THEN 'null' WHEN bin_width IS NULL THEN 'v' || v WHEN good THEN 'b' || floor(num / bin_width)::varchar ELSE 'x' END AS k, count(*) AS n
  FROM sized WHERE compare_loads GROUP BY ALL
), shares AS (
  SELECT load_id, column_name, k, n / sum(n) OVER (PARTITION BY load_id, column_name) AS s FROM counted
), base AS (
  SELECT DISTINCT load_id, baseline_load_id FROM attribute_loads WHERE baseline_load_id IS NOT NULL
), moved AS (
  SELECT b.load_id, baseline_load_id, column_name, k, s FROM base b JOIN shares USING (load_id)
  UNION ALL SELECT b.load_id, baseline_load_id, column_name, k, -s FROM base b JOIN shares s ON s.load_id = b.baseline_load_id
), changed AS (
  SELECT load_id, column_name FROM (SELECT load_id, baseline_load_id, column_name, k, abs(sum(s)) AS d FROM moved GROUP BY ALL)
  WHERE (load_id IN (SELECT load_id FROM once)) AND baseline_load_id IN (SELECT load_id FROM once)
  GROUP BY load_id, baseline_load_id, column_name HAVING sum(d) / 2 >= 0.25 - 1e-12
), found AS (
  SELECT load_id, column_name, 'null_value' AS issue_type, row_position FROM sized WHERE NOT nullable AND v IS NULL
  UNION ALL SELECT load_id, column_name, 'invalid_data_type', row_position FROM sized WHERE v IS NOT NULL AND NOT good
  UNION ALL SELECT load_id, column_name, 'pattern_violation', row_position FROM sized WHERE v IS NOT NULL AND value_pattern IS NOT NULL AND NOT regexp_matches(v, value_pattern)
  UNION ALL SELECT load_id, column_name, 'out_of_range', row_position FROM sized WHERE v IS NOT NULL AND good AND CASE WHEN data_type IN ('integer', 'float')
    THEN num < min_value::double OR num > max_value::double ELSE v < min_value OR v > max_value END
  UNION ALL SELECT load_id, column_name, 'duplicate_id', row_position FROM (
    SELECT *, count(*) OVER (PARTITION BY load_id, column_name, CAST(v AS hugeint)) AS same FROM sized WHERE is_id AND regexp_full_match(v, '[+-]?[0-9]{1,37}')) WHERE same > 1
  UNION ALL SELECT load_id, column_name, 'distribution_change', -1 FROM changed
)"""
_PROFILE = """
, counts AS (SELECT load_id, cell.c AS column_name, cell.v AS v, count(*) AS n FROM cells GROUP BY ALL), sums AS (
  SELECT load_id, column_name, sum(n)::bigint AS "rows", coalesce(sum(n) FILTER (v IS NULL), 0)::bigint AS nulls, count(*) FILTER (v IS NOT NULL) AS distinct_values,
    count(*) FILTER (v IS NOT NULL AND n > 1) AS repeated_values, max(n) AS most_frequent, sum(n * log2(n)) AS nlogn, min(v) AS least_text, max(v) AS greatest_text
  FROM counts GROUP BY ALL)
SELECT load_id, column_name, "rows", nulls, round(nulls / "rows", 6) AS null_rate, distinct_values, repeated_values, most_frequent,
  round(abs(log2("rows") - nlogn / "rows"), 6) AS entropy_bits, least_text, greatest_text FROM sums"""
_NEAR = """
WITH p AS (SELECT DISTINCT point_id AS id, longitude AS lon, latitude AS lat FROM survey_points WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90), near AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM p a JOIN p b ON b.lat >= a.lat - 0.001 AND b.lat <= a.lat + 0.001 AND a.id < b.id
WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) <= 50)"""
_INSIDE = r"""
, g AS (SELECT DISTINCT region_id, geometry_wkt FROM spatial_layers WHERE region_id IS NOT NULL AND regexp_matches(upper(geometry_wkt), '^\s*(MULTI)?POLYGON')
), r AS (SELECT region_id, unnest(regexp_extract_all(geometry_wkt, '\(([^()]+)\)', 1)) AS ring FROM g
), v AS (SELECT region_id, list_transform(string_split(ring, ','), lambda c: list_transform(regexp_extract_all(c, '[-+0-9.eE]+'), lambda x: x::double)) AS c FROM r
), e AS (SELECT region_id, c[i][1] AS x1, c[i][2] AS y1, c[i + 1][1] AS x2, c[i + 1][2] AS y2 FROM (SELECT region_id, c, unnest(range(1, len(c))) AS i FROM v)
), hits AS (SELECT id AS point_id, lon, lat, region_id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS crossed,
    count(*) FILTER ((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS touched
  FROM p JOIN e ON greatest(y1, y2) >= lat AND least(y1, y2) <= lat GROUP BY ALL
), inside AS (SELECT DISTINCT point_id, region_id FROM hits WHERE crossed % 2 = 1 AND touched = 0)"""
_TYPES = """
WITH once AS (SELECT file_id, record_no, max(payload) AS p FROM file_records GROUP BY ALL), cells AS (
  SELECT file_id, k AS field, json_type(p, '$."' || k || '"') AS t, json_extract_string(p, '$."' || k || '"') AS v FROM (SELECT file_id, p, unnest(json_keys(p)) AS k FROM once WHERE json_valid(p) AND json_type(p) = 'OBJECT')
), kinds AS (
  SELECT file_id, field, CASE WHEN t = 'NULL' THEN NULL WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'float'
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z') AND try_cast(substr(v, 1, 10) AS date) IS NOT NULL THEN 'datetime' ELSE 'string' END AS kind FROM cells
), types AS (
  SELECT file_id, field, CASE WHEN count(kind) = 0 THEN '' WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN count(*) FILTER (kind NOT IN ('integer', 'float')) = 0 THEN 'float' ELSE 'string' END AS type FROM kinds GROUP BY ALL
"""
_CHANGES = """), valued AS (
  SELECT c.file_id, o.record_no, c.field, CASE WHEN c.t = 'NULL' THEN NULL WHEN c.t = 'VARCHAR' THEN 's' || c.v WHEN c.t = 'BOOLEAN' THEN 'b' || c.v WHEN c.t IN ('OBJECT', 'ARRAY') THEN 'j' || c.v ELSE 'n' || (c.v::double)::varchar END AS cv
  FROM (SELECT file_id, record_no, k AS field, json_type(p, '$."' || k || '"') AS t, json_extract_string(p, '$."' || k || '"') AS v FROM (SELECT file_id, record_no, p, unnest(json_keys(p)) AS k FROM once WHERE json_valid(p) AND json_type(p) = 'OBJECT')) c
  JOIN once o ON o.file_id = c.file_id AND o.record_no = c.record_no
), pairs AS (
  SELECT file_id, previous_id FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY series_name ORDER BY file_seq, file_id) AS previous_id
    FROM (SELECT DISTINCT file_id, series_name, file_seq FROM schema_files WHERE file_id IS NOT NULL AND series_name IS NOT NULL AND file_seq IS NOT NULL)) WHERE previous_id IS NOT NULL
), sides AS (
  SELECT file_id, field, max(old) AS old, max(new) AS new FROM (SELECT p.file_id, field, NULL AS old, type AS new FROM pairs p JOIN types t ON t.file_id = p.file_id
    UNION ALL SELECT p.file_id, field, type, NULL FROM pairs p JOIN types t ON t.file_id = p.previous_id) GROUP BY ALL
), ids AS (SELECT file_id, cv AS id, min(record_no) AS record_no FROM valued WHERE field = 'id' AND cv IS NOT NULL GROUP BY ALL
), both_have AS (SELECT p.file_id, p.previous_id, a.record_no AS ra, b.record_no AS rb FROM pairs p JOIN ids a ON a.file_id = p.file_id JOIN ids b ON b.file_id = p.previous_id AND b.id = a.id
), compared AS (
  SELECT h.file_id, o.field AS old_name, n.field AS new_name, x.cv AS before_value, y.cv AS now_value FROM both_have h
  JOIN sides o ON o.file_id = h.file_id AND o.new IS NULL JOIN sides n ON n.file_id = h.file_id AND n.old IS NULL
  LEFT JOIN valued x ON x.file_id = h.previous_id AND x.record_no = h.rb AND x.field = o.field LEFT JOIN valued y ON y.file_id = h.file_id AND y.record_no = h.ra AND y.field = n.field
), renamed AS (
  SELECT file_id, old_name, new_name FROM compared WHERE before_value IS NOT NULL OR now_value IS NOT NULL GROUP BY ALL HAVING 10 * count(*) FILTER (before_value = now_value) >= 9 * count(*)
)
SELECT file_id, 'renamed' AS issue_type, new_name AS field_name, old_name AS previous_name FROM renamed
UNION ALL SELECT file_id, 'removed', field, '' FROM sides s WHERE new IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = s.file_id AND r.old_name = s.field)
UNION ALL SELECT file_id, 'added', field, '' FROM sides s WHERE old IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = s.file_id AND r.new_name = s.field)
UNION ALL SELECT file_id, 'type_changed', field, '' FROM sides WHERE old <> '' AND new <> '' AND old <> new
UNION SELECT r.file_id, 'type_changed', new_name, '' FROM renamed r JOIN sides o ON o.file_id = r.file_id AND o.field = old_name JOIN sides n ON n.file_id = r.file_id AND n.field = new_name WHERE o.old <> '' AND n.new <> '' AND o.old <> n.new"""
ORACLES = {
    "p2_found": _ONCE + _FAULTS + " SELECT load_id, column_name, issue_type, row_position FROM found",
    "p2_profile": _ONCE + _PROFILE,
    "p5_fingerprints": _TYPES
    + """), prints AS (
  SELECT file_id, count(*)::int AS fields, sha256('[' || string_agg('{"field":' || to_json(field) || ',"type":"' || type || '"}', ',' ORDER BY field) || ']') AS fingerprint FROM types GROUP BY 1
), named AS (
  SELECT series_name, file_seq, f.file_id, coalesce(fields, 0) AS fields, coalesce(fingerprint, '') AS fingerprint FROM (SELECT DISTINCT file_id, series_name, file_seq FROM schema_files WHERE file_id IS NOT NULL AND series_name IS NOT NULL AND file_seq IS NOT NULL) f LEFT JOIN prints p ON p.file_id = f.file_id
), steps AS (
  SELECT *, CASE WHEN lag(fingerprint) OVER w = fingerprint THEN 0 ELSE 1 END AS new FROM named WINDOW w AS (PARTITION BY series_name ORDER BY file_seq, file_id)
)
SELECT series_name, file_seq, file_id, sum(new) OVER (PARTITION BY series_name ORDER BY file_seq, file_id)::bigint AS version, fields, fingerprint FROM steps""",
    "p4_near": _NEAR + " SELECT left_id, right_id FROM near",
    "p4_found": _NEAR + _INSIDE + " SELECT 'near' AS relation, left_id, right_id FROM near UNION ALL SELECT 'inside', point_id, region_id FROM inside",
    "p5_found": _TYPES + _CHANGES,
}
