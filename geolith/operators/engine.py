"""Profiles of datasets and the advice drawn from them; Spark is the only engine."""

from __future__ import annotations

import os
import time
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.errors import GeolithError
from geolith.geometry.wkt import BadGeometry
from geolith.operators.tiles import read_geometry
from geolith.sources import vector

MIB = 1024 * 1024
# How much larger a format is in memory than on disk.
EXPANSION = {"GeoJSON": 2.5, "GeoParquet": 6.0, "GPKG": 4.0, "ESRI Shapefile": 3.0}
OTHER_EXPANSION = 4.0


@dataclass(frozen=True)
class EngineLimits:
    maximum_file_bytes: int = 64 * MIB
    maximum_features: int = 100_000
    maximum_memory_bytes: int = 512 * MIB
    available_memory_fraction: float = 0.35
    complex_average_vertices: float = 1000.0
    complex_projected_vertices: int = 20_000_000


def human_bytes(value: Column) -> Column:
    """Bytes in steps of 1024 with one digit: 1.5 MiB."""
    out = F.format_string("%.1f TiB", value / 1024.0**4)
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(value < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", value / 1024.0**k)).otherwise(out)
    return out


def estimated_memory(size: Column, driver: Column, features: Column, sampled_bytes_per_feature: Column) -> Column:
    """Expected bytes in memory: disk size by the format's expansion, or features by at least 512 bytes each, whichever is more."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k in EXPANSION.items() for v in k]), driver), F.lit(OTHER_EXPANSION))
    disk = F.floor(size * factor)
    return F.when(features.isNull(), disk).otherwise(F.greatest(disk, features * F.greatest(F.lit(512), F.floor(sampled_bytes_per_feature) * 3)))


def vertex_sample(features: DataFrame, geometry: str = "geometry", index: str = "feature_index", most: int = 256) -> DataFrame:
    """One row: sampled_features, average_vertices and maximum_vertices of the first features by index; a sample of bounded size, as a profile asks for. Geometries that are null or unreadable have none."""

    def count(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            try:
                g = read_geometry(value)
                out.append(0 if g is None else sum(1 for _ in g.coords()))
            except BadGeometry:
                out.append(0)
        return pd.Series(out, dtype="int64")

    sample = features.orderBy(index).limit(most).select(F.pandas_udf(count, "bigint")(F.col(geometry)).alias("n"))
    return sample.agg(F.count(F.lit(1)).alias("sampled_features"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_vertices"), F.coalesce(F.max("n"), F.lit(0)).alias("maximum_vertices"))


def dataset_profile(spark: SparkSession, path: str, layer: str | None = None, available_memory_bytes: int | None = None) -> DataFrame:
    """One row for engine_decision: size_bytes (of a Shapefile with its siblings, of a folder all its files), feature_count, average_vertices and maximum_vertices of the sample, estimated_memory_bytes, available_memory_bytes."""
    at = Path(path)
    if at.is_dir():
        size = sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    elif at.suffix.lower() == ".shp":
        size = sum(p.stat().st_size for p in at.parent.glob(f"{at.stem}.*"))
    else:
        size = at.stat().st_size
    try:
        meta = vector.inspect(path, layer)
    except GeolithError:  # a table without the footer of the format
        meta = {"driver": "other", "feature_count": None}
    features = vector.read(spark, path, layer)
    name = next((c for c in ("geometry", "geometry_wkt") if c in features.columns), None)
    if name is None:
        raise ValueError("the dataset has no geometry column")
    sample = vertex_sample(features.select("feature_index", name), name)
    count = F.lit(meta["feature_count"]).cast("bigint")
    estimate = estimated_memory(F.lit(size), F.lit(meta["driver"]), count, 16 * F.col("average_vertices"))
    return sample.select(F.lit(size).cast("bigint").alias("size_bytes"), count.alias("feature_count"), "average_vertices", "maximum_vertices", estimate.cast("bigint").alias("estimated_memory_bytes"), F.lit(available_memory_bytes).cast("bigint").alias("available_memory_bytes"))


def engine_decision(profiles: DataFrame, limits: EngineLimits = EngineLimits(), rules: Mapping[str, Column] | None = None) -> DataFrame:
    """The profiles (size_bytes, feature_count, estimated_memory_bytes, available_memory_bytes, average_vertices) with engine and reasons.

    `streaming` (bounded memory) if any rule fires, else `in_memory`. Null counts and null available memory fire nothing.
    rules: further conditions by the reason they give.
    """
    budget = F.coalesce(F.least(F.lit(limits.maximum_memory_bytes), F.floor(F.col("available_memory_bytes") * limits.available_memory_fraction)), F.lit(limits.maximum_memory_bytes))
    projected = F.floor(F.col("average_vertices") * F.coalesce("feature_count", F.lit(0)))
    reasons = F.array(
        F.when(F.col("estimated_memory_bytes") > budget, "memory"), F.when(F.col("feature_count") > limits.maximum_features, "feature_count"),
        F.when(F.col("size_bytes") > limits.maximum_file_bytes, "file_size"), F.when((F.col("average_vertices") >= limits.complex_average_vertices) & (projected >= limits.complex_projected_vertices), "complexity"),
        *[F.when(condition, F.lit(reason)) for reason, condition in (rules or {}).items()],
    )
    out = profiles.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return out.withColumn("engine", F.when(F.size("reasons") > 0, "streaming").otherwise("in_memory"))


def worker_count(tasks: int, *, cpus: int | None = None, available_memory: int | None = None, requested: int | None = None, safe: bool = True, maximum: int = 8, reserve: int = 1, bytes_per_worker: int = 512 * MIB, utilization: float = 0.75) -> int:
    """How many workers a batch of datasets needs: the least of tasks, request, maximum, CPUs less the reserve, and what memory allows; at least 1. A request of 0 means the maximum."""
    if tasks < 1 or not safe:
        return 1
    requested = requested or maximum
    if requested < 1:
        raise ValueError("requested must be positive")
    by_memory = tasks if available_memory is None else max(1, int(available_memory * utilization) // bytes_per_worker)
    return max(1, min(tasks, requested, maximum, max(1, (cpus or os.cpu_count() or 1) - reserve), by_memory))


def remaining_seconds(completed: int, total: int, elapsed: float) -> float | None:
    """Expected rest of a run; None before anything is done."""
    return None if completed <= 0 else elapsed / completed * (total - completed)


def _resident() -> int:
    """Resident bytes of the driver's Python; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError, IndexError):
        return 0


def _peak() -> int:
    try:
        import resource
    except ImportError:
        return _resident()
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


class Recorder:
    """Times operations and keeps one record each; with enabled=False it only calls them."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.records = enabled, []

    def measure(self, name: str, operation, **context):
        if not self.enabled:
            return operation()
        wall, cpu, before = time.perf_counter(), time.process_time(), _resident()
        result = operation()
        wall, cpu = time.perf_counter() - wall, time.process_time() - cpu
        self.records.append({"audit": name, "runtime_seconds": wall, "cpu_time_seconds": cpu, "cpu_usage_percent": 100 * cpu / wall if wall else 0.0, "memory_usage_bytes": max(0, _resident() - before), "peak_memory_bytes": _peak(), **context})
        return result
