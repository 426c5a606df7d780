"""Rankings and summaries of findings, runs and checks."""

from __future__ import annotations

import html
import json
import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.geometry.wkt import BadGeometry
from geolith.operators.tiles import read_geometry
from geolith.sources.vector import to_mapping
from geolith.storage import Scratch

# What is done about an issue, as a code; texts for people belong to the caller.
ACTIONS = {"building_in_river": "confirm_river", "road_river_crossing": "model_crossing", "inter_agency_overlap": "settle_owner", "boundary_conflict": "settle_boundary", "duplicate": "drop_copy"}
OTHER_ACTION = "review"
# Penalties by severity, lower edges of the badges.
PENALTIES = {"info": 1, "warning": 5, "error": 10, "critical": 25}
BADGES = ((90, "Excellent"), (75, "Good"), (50, "Fair"))


@dataclass(frozen=True)
class PriorityWeights:
    severity: float = 0.40
    impact: float = 0.30
    area: float = 0.15
    feature_count: float = 0.15

    def __post_init__(self):
        if min(self.__dict__.values()) < 0 or abs(sum(self.__dict__.values()) - 1) > 1e-9:
            raise ValueError("weights must not be negative and sum to 1")


def prioritize(candidates: DataFrame, weights: PriorityWeights = PriorityWeights(), actions: Mapping[str, str] = ACTIONS, other_action: str = OTHER_ACTION) -> DataFrame:
    """rank, issue_id, priority_score, action, rationale of (issue_id, issue_type, severity, impact, area, feature_count).

    The score weighs severity, impact, and area and feature count as shares of their maxima (0 where a maximum is 0),
    rounded to two digits before ranking; ties go by issue_id. actions: what to do by issue type, as codes or texts. The maxima are one broadcast row, ranks are given by
    range-partitioned position, so no task sees all candidates.
    """
    top = candidates.agg(F.max("area").alias("top_area"), F.max("feature_count").alias("top_count"))
    share = lambda c, t: F.when(F.col(t) > 0, 100 * F.col(c) / F.col(t)).otherwise(0.0)
    scored = candidates.crossJoin(F.broadcast(top)).withColumns({"area_score": share("area", "top_area"), "count_score": share("feature_count", "top_count")})  # top: one row
    score = weights.severity * F.col("severity") + weights.impact * F.col("impact") + weights.area * F.col("area_score") + weights.feature_count * F.col("count_score")
    action = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k in actions.items() for v in k]), F.col("issue_type")), F.lit(other_action))
    parts = {"severity": F.col("severity"), "impact": F.col("impact"), "area": F.col("area_score"), "features": F.col("count_score")}
    rationale = F.concat_ws(" ", *[F.concat(F.lit(name + "="), F.round(value.cast("double"), 1).cast("string")) for name, value in parts.items()])
    out = scored.select("issue_id", F.round(score, 2).alias("priority_score"), action.alias("action"), rationale.alias("rationale"))
    return numbered(out, [F.desc("priority_score"), F.asc("issue_id")], "rank", 1)


def numbered(df: DataFrame, order, name: str, start: int = 0) -> DataFrame:
    """The rows with their position in a total order, without a single-task window: positions within range partitions plus the rows before them."""
    parted = df.orderBy(*order).withColumn("_p", F.spark_partition_id())
    # Written, so that both readers below see the same partitions.
    parted = Scratch(df.sparkSession, "numbered").save(parted.withColumn("_m", F.monotonically_increasing_id()))
    ahead = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    ahead = ahead.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row for each partition
    return parted.join(F.broadcast(ahead), "_p").withColumn(name, (F.col("_before") + F.col("_m") - F.col("_first") + start).cast("bigint")).drop("_p", "_m", "_first", "_before")


def quality_reports(issues: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """report_id, issue_count, counts by severity, quality_score, quality_badge of (report_id, severity).

    The score is 100 less the penalties of all issues, not below 0. reports: (report_id) lists reports that may have
    no issue, which score 100. Severities not known cost nothing.
    """
    penalty = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k in PENALTIES.items() for v in k]), F.col("severity")), F.lit(0))
    out = issues.groupBy("report_id").agg(F.count(F.lit(1)).alias("issue_count"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in PENALTIES], F.sum(penalty).alias("_penalty"))
    if reports is not None:
        out = reports.select("report_id").distinct().join(out, "report_id", "left").na.fill(0)
    out = out.withColumn("quality_score", F.greatest(F.lit(0), 100 - F.col("_penalty")).cast("double"))
    badge = F.lit("Poor")
    for least, name in reversed(BADGES):
        badge = F.when(F.col("quality_score") >= least, name).otherwise(badge)
    return out.withColumn("quality_badge", badge).drop("_penalty")


def recommendations(issues: DataFrame) -> DataFrame:
    """Each report's recommendations once, with their place by first occurrence: report_id, place, recommendation, from (report_id, pos, recommendation)."""
    first = issues.groupBy("report_id", "recommendation").agg(F.min("pos").alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("report_id").orderBy("_first", "recommendation")) - 1).drop("_first")


def batch_totals(items: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, is_successful of (status)."""
    n, bad = F.count(F.lit(1)), F.count(F.when(F.col("status") == "failed", 1))
    return items.agg(n.alias("total"), F.count(F.when(F.col("status") == "succeeded", 1)).alias("succeeded"), bad.alias("failed"), (bad == 0).alias("is_successful"))


def benchmark_summary(records: DataFrame) -> DataFrame:
    """One row: audit_count, summed runtime and features, mean CPU share, greatest peak memory; zeros without records."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    have = set(records.columns)
    out = [F.count(F.lit(1)).alias("audit_count")]
    out += [F.round(zero(F.sum(F.col(c).cast("double"))), 6).alias(c) for c in ("runtime_seconds", "cpu_time_seconds", "memory_usage_bytes", "feature_count", "geometry_count", "rule_count") if c in have]
    out += [F.round(zero(F.avg("cpu_usage_percent")), 6).alias("average_cpu_usage_percent")] if "cpu_usage_percent" in have else []
    out += [F.round(zero(F.max(F.col("peak_memory_bytes").cast("double"))), 6).alias("peak_memory_bytes")] if "peak_memory_bytes" in have else []
    return records.agg(*out)


# A map's colours by severity, dark to light as they matter less.
COLOURS = {"critical": "#7f1d1d", "error": "#dc2626", "warning": "#d97706", "info": "#2563eb"}


def map_features(findings: DataFrame, geometry: str = "geometry", severity: str = "severity", label: str | None = None) -> DataFrame:
    """Findings as GeoJSON features for a map, one JSON text a row: geometry (WKB or WKT) and the other columns as properties, with colour, weight and label.

    Findings whose geometry is null or unreadable have a null geometry and stay. Severities not known are grey.
    """

    def as_json(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            try:
                g = read_geometry(value)
            except BadGeometry:
                g = None
            out.append(None if g is None else json.dumps(to_mapping(g)))
        return pd.Series(out, dtype=object)

    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k in COLOURS.items() for v in k]), F.col(severity)), F.lit("#6b7280"))
    weight = F.when(F.col(severity).isin("critical", "error"), 3).otherwise(1)
    rest = [c for c in findings.columns if c != geometry]
    properties = F.to_json(F.struct(*rest, colour.alias("colour"), weight.alias("weight"), (F.col(label) if label else F.col(severity)).cast("string").alias("label")), {"ignoreNullFields": "false"})
    shape = F.coalesce(F.pandas_udf(as_json, "string")(F.col(geometry)), F.lit("null"))
    return findings.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_quality_report(path: str | Path, title: str, dataset_name: str, total_checks: int, passed_checks: int, issues: DataFrame, summary: str | None = None, most: int = 1000) -> Path:
    """A dataset's quality report as a file, by its suffix: score, badge, counts by severity, the recommendations once each, and the first issues by pos.

    issues: report_id, pos, severity, recommendation of one report. Blank names and counts out of order raise ValueError.
    """
    if not title.strip() or not dataset_name.strip() or not 0 <= passed_checks <= total_checks:
        raise ValueError("a report needs a title, a dataset and 0 <= passed <= total checks")
    found = quality_reports(issues).drop("report_id").first()
    facts = {"dataset": dataset_name, "total_checks": total_checks, "passed_checks": passed_checks, "failed_checks": total_checks - passed_checks}
    facts |= found.asDict() if found else {"issue_count": 0, **{s: 0 for s in PENALTIES}, "quality_score": 100.0, "quality_badge": BADGES[0][1]}
    facts["summary"] = summary or f"{passed_checks} of {total_checks} checks passed."
    facts["recommendations"] = "; ".join(r["recommendation"] for r in recommendations(issues.where("recommendation is not null")).orderBy("place").limit(most).collect())
    return write_report(path, title, facts, [r.asDict() for r in issues.drop("report_id").orderBy("pos").limit(most).collect()])


def write_report(path: str | Path, title: str, summary: dict, rows: list[dict]) -> Path:
    """Write a small report as JSON, Markdown or HTML, by the suffix, replacing the file in one step."""
    path = Path(path)
    if path.suffix == ".json":
        text = json.dumps({"schema_version": "1.0", "title": title, "summary": summary, "records": rows}, indent=2, default=str, sort_keys=True)
    elif path.suffix in (".md", ".markdown"):
        names = list(rows[0]) if rows else []
        lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in summary.items()], ""]
        if names:
            lines += ["| " + " | ".join(names) + " |", "|" + " - |" * len(names), *["| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows]]
        text = "\n".join(lines) + "\n"
    elif path.suffix in (".html", ".htm"):
        e = lambda v: html.escape(str(v))
        names = list(rows[0]) if rows else []
        head = "".join(f"<th>{e(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{e(r[n])}</td>" for n in names) + "</tr>" for r in rows)
        facts = "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in summary.items())
        text = f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1><dl>{facts}</dl><table><tr>{head}</tr>{body}</table></body></html>\n"
    else:
        raise ValueError(f"no report format for {path.suffix!r}")
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        part.write_text(text, encoding="utf-8")
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)
    return path
