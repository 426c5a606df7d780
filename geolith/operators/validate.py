"""Validation of every geometry and the audit of a dataset."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.errors import EmptyLayerError, MissingCrsError
from geolith.geometry import wkt
from geolith.geometry.validity import issues
from geolith.operators.tiles import read_geometry
from geolith.storage import Scratch

MOST_FINDINGS = 1000
FINDING = "geometry_type string, issues array<struct<issue_type:string,message:string>>"


def check(values: pd.Series) -> pd.DataFrame:
    rows = []
    for value in values:
        try:
            g = read_geometry(value)
        except wkt.BadGeometry as error:
            rows.append((None, [{"issue_type": "invalid_geometry", "message": f"Not readable: {error}."}]))
            continue
        rows.append((g.kind.title() if g else None, [{"issue_type": i, "message": m} for i, m in issues(g)]))
    return pd.DataFrame(rows, columns=["geometry_type", "issues"])


def validate(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The features' columns with geometry_type, issues and is_valid (no issues).

    A null geometry is an empty_geometry issue; bytes or text that are no geometry are an invalid_geometry issue, so
    one bad row never fails the dataset.
    """
    found = features.withColumn("_found", F.pandas_udf(check, FINDING)(features[geometry]))
    return found.select(*features.columns, F.col("_found.geometry_type").alias("geometry_type"), F.col("_found.issues").alias("issues"), (F.size("_found.issues") == 0).alias("is_valid"))


def issue_counts(validated: DataFrame) -> DataFrame:
    """Features with each issue type, sorted by type."""
    return validated.select(F.explode(F.array_distinct(F.transform("issues", lambda i: i["issue_type"]))).alias("issue_type")).groupBy("issue_type").agg(F.count(F.lit(1)).alias("features"))


def audit(validated: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """One row: feature_count, invalid_feature_count, findings_listed, findings_truncated (whether more features are invalid than are listed); zeros for an empty dataset."""
    counts = validated.agg(F.count(F.lit(1)).alias("feature_count"), F.count(F.when(~F.col("is_valid"), 1)).alias("invalid_feature_count"))
    return counts.select("*", F.least("invalid_feature_count", F.lit(most).cast("bigint")).alias("findings_listed"), (F.col("invalid_feature_count") > most).alias("findings_truncated"))


def findings(validated: DataFrame, index: str = "feature_index", most: int = MOST_FINDINGS) -> DataFrame:
    """The first invalid features by index; a report of bounded length. Whether it is cut is told by audit."""
    return validated.where(~F.col("is_valid")).orderBy(index).limit(most)


@dataclass(frozen=True)
class AuditResult:
    """summary: one row as of audit. issue_counts: features by issue type. findings: the first invalid features."""

    summary: DataFrame
    issue_counts: DataFrame
    findings: DataFrame


def audit_dataset(features: DataFrame, geometry: str = "geometry", index: str = "feature_index", *, crs: str | None = None, require_crs: bool = False, require_features: bool = False, most: int = MOST_FINDINGS) -> AuditResult:
    """The audit of a dataset: every feature is validated once and the verdicts are written.

    With require_crs, a dataset whose crs is null or blank raises MissingCrsError; with require_features, one without
    features raises EmptyLayerError. Else an empty dataset gives zeros.
    """
    if require_crs and not (crs or "").strip():
        raise MissingCrsError("the dataset has no coordinate reference system")
    kept = Scratch(features.sparkSession, "audit").save(validate(features, geometry).select(index, "geometry_type", "issues", "is_valid"))
    if require_features and kept.isEmpty():
        raise EmptyLayerError("the dataset has no features")
    return AuditResult(audit(kept, most), issue_counts(kept), findings(kept, index, most))
