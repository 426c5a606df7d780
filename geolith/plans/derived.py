"""Feature tables derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Tables stand in braces. Coordinates are whole numbers stored as doubles and the density of features does not
depend on the scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from geolith.plans.tables import table

DERIVED = {
    # overlapping boxes, up to 5 x 4, on a lattice of pitch 3
    "parcels": """
select o_orderkey as idx, cast(3 * (o_orderkey % 200) as double) as x0, cast(3 * floor(o_orderkey / 200) as double) as y0,
  cast(3 * (o_orderkey % 200) + 1 + o_custkey % 5 as double) as x1, cast(3 * floor(o_orderkey / 200) + 1 + (o_orderkey + o_custkey) % 4 as double) as y1
from {orders}""",
    # boxes of pitch 4 and width 3: neighbours lie 1 apart
    "blocks": """
select p_partkey as idx, cast(4 * (p_partkey % 100) as double) as x0, cast(4 * floor(p_partkey / 100) as double) as y0,
  cast(4 * (p_partkey % 100) + 3 as double) as x1, cast(4 * floor(p_partkey / 100) + 3 as double) as y1
from {part}""",
    "lattice_old": """
select p_partkey as idx, p_brand as brand, p_type as kind, cast(10 * (p_partkey % 100) as double) as x0, cast(10 * floor(p_partkey / 100) as double) as y0,
  cast(10 * (p_partkey % 100) + 1 + p_size % 5 as double) as x1, cast(10 * floor(p_partkey / 100) + 1 + p_partkey % 4 as double) as y1
from {part}""",
    # the same boxes later: every 11th moved away, every 7th wider, every 5th of another brand
    "lattice_new": """
select p_partkey * 7 + 3 as idx, case when p_partkey % 5 = 0 then 'changed' else p_brand end as brand, p_type as kind,
  cast(10 * (p_partkey % 100) as double) as x0, cast(10 * floor(p_partkey / 100) + case when p_partkey % 11 = 0 then 5 else 0 end as double) as y0,
  cast(10 * (p_partkey % 100) + 1 + p_size % 5 + case when p_partkey % 7 = 0 then 1 else 0 end as double) as x1,
  cast(10 * floor(p_partkey / 100) + 1 + p_partkey % 4 + case when p_partkey % 11 = 0 then 5 else 0 end as double) as y1
from {part}""",
    "line_vertices": """
select l_orderkey as idx, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as seq,
  cast(l_partkey % 10 as double) as x, cast(l_suppkey % 10 as double) as y
from {lineitem}""",
    "roads": """
select o_orderkey as idx, cast(2 * (o_orderkey % 300) as double) as xa, cast(2 * floor(o_orderkey / 300) as double) as ya,
  cast(2 * (o_orderkey % 300) + 1 + o_custkey % 2 as double) as xb, cast(2 * floor(o_orderkey / 300) + 2 * (o_custkey % 3) as double) as yb
from {orders}""",
    "rivers": """
select n_nationkey as idx, cast(15 * n_nationkey as double) as x0, cast(0 as double) as y0, cast(15 * n_nationkey + 2 as double) as x1, cast(4100 as double) as y1
from {nation}""",
    "crs_sources": """
select n_nationkey as seq, n_name as uri, case when n_nationkey % 13 = 12 then 'unreadable' end as read_error,
  case when n_nationkey % 13 = 12 or n_nationkey % 6 = 0 then null when n_regionkey = 2 then 'EPSG:3857' else 'EPSG:4326' end as crs
from {nation}""",
    "datum_samples": "select s_nationkey as audit_id, s_suppkey as sample_id, abs(s_acctbal) / 1000 as displacement_m from {supplier}",
    "axis_bounds": """
select k as dataset_id, min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y from (
  select c_nationkey as k, cast(c_custkey % 50 + case when c_nationkey % 4 in (1, 2) then 100 else 0 end as double) as x,
    cast(c_custkey % 40 + case when c_nationkey % 4 in (0, 2) then 95 else 0 end as double) as y
  from {customer}) s
group by k""",
    "repair_candidates": """
select s_name as issue_id, case s_nationkey % 5 when 0 then 'building_in_river' when 1 then 'road_river_crossing' when 2 then 'inter_agency_overlap' when 3 then 'boundary_conflict' else 'other' end as issue_type,
  abs(s_acctbal) / 100 as severity, cast(s_suppkey % 101 as double) as impact, t.area, t.feature_count
from {supplier} join (select l_suppkey, sum(l_quantity) as area, count(*) as feature_count from {lineitem} group by l_suppkey) t on l_suppkey = s_suppkey""",
    "quality_issues": """
select user_id as report_id, event_id as pos, case event_type when 'error' then 'critical' when 'purchase' then 'error' when 'signup' then 'warning' else 'info' end as severity, event_type as recommendation
from {events}""",
    "audit_runs": """
select user_id as seq, count(*) as feature_count, sum(value) as runtime_seconds, max(value) as peak_memory_bytes, case when user_id % 9 = 4 then 'failed' else 'succeeded' end as status
from {events} group by user_id""",
    "profiles": """
select n_nationkey as seq, cast(20 * 1048576 + 4000000 * n_nationkey as bigint) as size_bytes, count(*) * 700 as feature_count, cast(1048576 as bigint) * 50 * (n_nationkey % 15) as estimated_memory_bytes,
  case when n_nationkey % 7 = 0 then null else cast(1048576 as bigint) * 1000 * (n_nationkey % 4 + 1) end as available_memory_bytes, cast(n_nationkey * 100 as double) as average_vertices
from {nation} join {customer} on c_nationkey = n_nationkey group by n_nationkey""",
}


def tables_of(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in tables_of(sql)})


def as_cte(*names: str) -> str:
    """WITH clause of derived tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', DERIVED[n])})" for n in names)
