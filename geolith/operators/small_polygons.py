"""Small polygons: noise, slivers and tiny islands, and what to do with them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.geometry import overlay, wkb, wkt
from geolith.geometry.boxes import box_distances, box_shared_lengths, paired, polygons_of
from geolith.geometry.measure import distance, shared_length
from geolith.geometry.validity import invalid_reason
from geolith.operators.tiles import Cache, envelope_pairs, prepared, require, saved, sorted_side, spread, with_shapes

POLYGONS = ("POLYGON", "MULTIPOLYGON")
RECOMMENDATIONS = ("delete", "ignore", "merge")


@dataclass(frozen=True)
class SmallPolygonConfig:
    sliver_area_threshold: float = 1.0
    sliver_compactness_threshold: float = 0.05
    tiny_island_area_threshold: float = 0.25
    isolation_distance: float = 1.0
    noise_area_threshold: float = 0.01
    merge_tolerance: float = 0.1
    max_target_area_change: float = 0.25

    def __post_init__(self):
        if min(self.__dict__.values()) < 0:
            raise ValueError("limits must not be negative")


def _near(limit: float):
    def run(batches):
        shape = Cache()
        for batch in batches:
            left, right = batch["lw"].tolist(), batch["rw"].tolist()
            both, a, b = paired(left, right)
            d = np.full(len(batch), np.nan)
            d[both] = box_distances(a, b)
            for k in np.flatnonzero(np.isnan(d)):
                d[k] = distance(shape(left[k]), shape(right[k]))
            yield pd.DataFrame({"feature_index": batch.loc[d < limit, "l"]})

    return run


def _rank(batches):
    shape = Cache()
    for batch in batches:
        left, right = batch["lw"].tolist(), batch["rw"].tolist()
        both, a, b = paired(left, right)
        shared, d = np.full(len(batch), np.nan), np.full(len(batch), np.nan)
        shared[both], d[both] = box_shared_lengths(a, b), box_distances(a, b)
        for k in np.flatnonzero(np.isnan(d)):
            x, y = shape(left[k]), shape(right[k])
            shared[k], d[k] = shared_length(x.segments, y.segments), distance(x, y)
        yield batch[["l", "r"]].assign(shared=shared, d=d)


def _merge(limit: float):
    def run(batches):
        for batch in batches:
            rows = []
            for l, r, lw, rw in zip(batch["l"], batch["r"], batch["lw"], batch["rw"]):
                base = polygons_of(rw)
                merged = overlay.union([base, polygons_of(lw)])
                size = overlay.area_of(base)
                whole = overlay.region(merged)
                safe = abs(overlay.area_of(merged) - size) / max(size, 1e-15) <= limit and invalid_reason(whole) is None
                rows.append((l, r, wkt.dump(wkb.load(rw)), wkt.dump(whole) if safe else None))
            yield pd.DataFrame(rows, columns=["feature_index", "target_index", "target_before", "preview"])

    return run


def classify_small(shapes: DataFrame, config: SmallPolygonConfig) -> DataFrame:
    """The small polygons of prepared shapes with issue_type and compactness: noise before sliver before tiny island.

    Only features small enough for an island are tested for neighbours within the isolation distance.
    """
    compact = F.when(F.col("length") > 0, 4 * math.pi * F.col("area") / (F.col("length") * F.col("length"))).otherwise(0.0)
    sized = shapes.withColumn("compactness", compact)
    kind = F.when(F.col("area") <= config.noise_area_threshold, "noise_geometry").when((F.col("area") <= config.sliver_area_threshold) & (F.col("compactness") <= config.sliver_compactness_threshold), "sliver_polygon")
    sized = sized.withColumn("issue_type", kind).where(F.col("issue_type").isNotNull() | (F.col("area") <= config.tiny_island_area_threshold))
    islands = sized.where("issue_type is null")
    met = with_shapes(envelope_pairs(islands, shapes, config.isolation_distance).where("l <> r"), islands, shapes)
    near = met.mapInPandas(_near(config.isolation_distance), "feature_index bigint").distinct().withColumn("near", F.lit(True))
    joined = sized.join(sorted_side(near), "feature_index", "left")
    return joined.where("issue_type is not null or near is null").withColumn("issue_type", F.coalesce("issue_type", F.lit("tiny_island"))).drop("near")


def small_polygons(features: DataFrame, config: SmallPolygonConfig = SmallPolygonConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """feature_index, issue_type, recommendation, area, compactness, target_index, target_before, preview.

    The target is, of the features whose envelope meets the one grown by merge_tolerance, the one with the longest
    common edge, then the nearest, then the lowest index; merge is recommended if the union is valid and changes the
    target's area by no more than the limit, else delete for noise and islands and ignore for slivers. preview is the
    union where merge is recommended. Other geometries than polygons, missing or empty ones raise ValueError.
    """
    shapes = saved(prepared(spread(features, index), index, geometry))
    require(shapes, POLYGONS)
    small = saved(classify_small(shapes, config))
    ranked = with_shapes(envelope_pairs(small, shapes, config.merge_tolerance).where("l <> r"), small, shapes).mapInPandas(_rank, "l bigint, r bigint, shared double, d double")
    best = ranked.groupBy("l").agg(F.max(F.struct("shared", (-F.col("d")).alias("d"), (-F.col("r")).alias("r"))).alias("m")).select("l", (-F.col("m.r")).alias("r"))
    merged = with_shapes(best, small, shapes).mapInPandas(_merge(config.max_target_area_change), "feature_index bigint, target_index bigint, target_before string, preview string")
    advice = F.when(F.col("preview").isNotNull(), "merge").when(F.col("issue_type") == "sliver_polygon", "ignore").otherwise("delete")
    return small.join(sorted_side(merged), "feature_index", "left").select("feature_index", "issue_type", advice.alias("recommendation"), "area", "compactness", "target_index", "target_before", "preview")


def recommendation_counts(findings: DataFrame) -> DataFrame:
    """Number of findings of every recommendation, zeros included."""
    kinds = findings.sparkSession.createDataFrame([(k,) for k in RECOMMENDATIONS], "recommendation string")
    counted = findings.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, "recommendation", "left").select("recommendation", F.coalesce("n", F.lit(0)).alias("findings"))
