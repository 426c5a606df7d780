"""Snapping nearby polygon boundaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.geometry import wkb, wkt
from geolith.geometry.batch import Flat, hausdorff_distances
from geolith.geometry.boxes import box_distances, paired, polygons_of
from geolith.geometry.measure import boundary_distance, intersects, overlay_areas
from geolith.geometry.repair import snapped
from geolith.geometry.validity import invalid_reason
from geolith.operators.tiles import Cache, envelope_pairs, prepared, require, runs, saved, sorted_side, spread, with_shapes

POLYGONS = ("POLYGON", "MULTIPOLYGON")
OVERLAP_EPSILON = 1e-12
UNTOUCHED, BAD, FAR, CHANGED, OVERLAP = "no vertex within tolerance", "candidate is no valid polygon", "shape shift over limit", "area change over limit", "candidate adds overlap"


@dataclass(frozen=True)
class SnapConfig:
    tolerance: float = 0.01
    max_relative_area_change: float = 0.01
    max_shape_shift: float | None = None

    def __post_init__(self):
        if self.tolerance <= 0 or self.max_relative_area_change < 0 or (self.max_shape_shift or 0) < 0:
            raise ValueError("tolerance must be positive and limits not negative")


def _near(tolerance: float):
    def run(batches):
        shape = Cache()
        for batch in batches:
            left, right = batch["lw"].tolist(), batch["rw"].tolist()
            both, a, b = paired(left, right)
            d = np.full(len(batch), np.nan)
            d[both] = box_distances(a, b)
            for k in np.flatnonzero(np.isnan(d)):
                a, b = shape(left[k]), shape(right[k])
                d[k] = 0.0 if intersects(a, b) else boundary_distance(a, b)
            yield batch.loc[(d > 0) & (d <= tolerance), ["l", "r", "lw", "rw"]]

    return run


def _near_shapes(shapes: DataFrame, tolerance: float) -> DataFrame:
    return with_shapes(envelope_pairs(shapes, tolerance=tolerance), shapes).select("l", "r", "lw", "rw").mapInPandas(_near(tolerance), "l bigint, r bigint, lw binary, rw binary")


def snap_pairs(shapes: DataFrame, tolerance: float) -> DataFrame:
    """(l, r), l < r: boundaries apart, but at most the tolerance."""
    return _near_shapes(shapes, tolerance).select("l", "r")


MOVED = "feature_index bigint, before binary, after binary, anchors array<bigint>, shift double, reason string, area_before double, area_after double, x0 double, y0 double, x1 double, y1 double"


def _candidate(before: wkt.Geom, anchors: list[bytes], tolerance: float) -> wkt.Geom:
    after = before
    for data in anchors:
        after = snapped(after, list(wkt.Geom("MULTIPOLYGON", polygons=polygons_of(data)).paths()), tolerance)
    return after


def _move(config: SnapConfig):
    limit = config.tolerance if config.max_shape_shift is None else config.max_shape_shift

    def run(batches):
        """Rows sorted by feature and anchor, originals all: each feature's candidate and why it is refused, overlaps aside."""
        for frame, starts in runs(batches, "r"):
            at = starts[:-1]
            ids, old = frame["r"].to_numpy()[at], [bytes(d) for d in frame["rw"].to_numpy()[at]]
            anchors, data = frame["l"].tolist(), frame["lw"].tolist()
            geoms = [_candidate(wkt.Geom(wkb.load(b).kind, polygons=polygons_of(b)), data[i:j], config.tolerance) for b, i, j in zip(old, at, starts[1:])]
            new = list(map(wkb.dump, geoms))
            n = len(at)
            flat = Flat.load(old + new)
            far = hausdorff_distances(flat, np.arange(n), np.arange(n, 2 * n))
            a, b = flat.area[:n], flat.area[n:]
            reasons = []
            for k, after in enumerate(geoms):
                reason = ""
                if new[k] == old[k]:
                    reason = UNTOUCHED
                elif invalid_reason(after):
                    reason = BAD
                elif far[k] > limit:
                    reason = FAR
                elif abs(b[k] - a[k]) / max(a[k], 1e-15) > config.max_relative_area_change:
                    reason = CHANGED
                reasons.append(reason)
            yield pd.DataFrame(dict(zip([c.split()[0] for c in MOVED.split(", ")], (ids, old, new, [anchors[i:j] for i, j in zip(at, starts[1:])], far, reasons, a, b, *flat.bounds[n:].T))))

    return run


def _adds_overlap(batches):
    shape = Cache()
    for batch in batches:
        after, other = batch["after"].tolist(), batch["rw"].tolist()
        n = len(batch)
        bounds = Flat.load(after + other).bounds
        # Where the envelopes have no area in common the candidate has none with the other feature either.
        some = np.flatnonzero((np.maximum(bounds[:n, :2], bounds[n:, :2]) < np.minimum(bounds[:n, 2:], bounds[n:, 2:])).all(1))
        worse = [k for k in some if overlay_areas(shape(after[k]), shape(other[k]))[2] - overlay_areas(shape(batch["before"].iloc[k]), shape(other[k]))[2] > OVERLAP_EPSILON]
        yield pd.DataFrame({"feature_index": batch["l"].to_numpy()[worse]})


def snap_boundaries(features: DataFrame, config: SnapConfig = SnapConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """One row for each polygon: feature_index, status (repaired or unchanged), before, after, area_before, area_after, shape_shift, snapped_to, reason.

    Of two polygons that lie apart by at most the tolerance the later moves its vertices onto the earlier, original
    one. A candidate is refused, in this order, if nothing moved, if it is invalid, moved too far, changed its area
    too much, or adds overlap with any other feature; only features whose envelope meets the candidate can. Other
    geometries than polygons, missing or empty ones raise ValueError.
    """
    shapes = saved(prepared(spread(features, index), index, geometry))
    require(shapes, POLYGONS)
    moved = saved(spread(_near_shapes(shapes, config.tolerance), "r").sortWithinPartitions("r", "l").mapInPandas(_move(config), MOVED))
    # A feature has few anchors: those within the tolerance of its boundary.
    open_ = moved.where("reason = ''")
    met = envelope_pairs(open_, shapes).where("l <> r")
    checked = met.join(sorted_side(open_.select(F.col("feature_index").alias("l"), "before", "after")), "l").join(sorted_side(shapes.select(F.col("feature_index").alias("r"), F.col("shape").alias("rw"))), "r")
    worse = checked.mapInPandas(_adds_overlap, "feature_index bigint").distinct().withColumn("worse", F.lit(True))
    judged = moved.join(sorted_side(worse), "feature_index", "left").withColumn("reason", F.when((F.col("reason") == "") & F.col("worse"), OVERLAP).otherwise(F.col("reason")))
    text = F.pandas_udf(lambda s: s.map(lambda b: wkt.dump(wkb.load(b))), "string")
    out = shapes.select("feature_index", "shape", "area").join(sorted_side(judged.select("feature_index", "after", "anchors", "shift", "reason", "area_after")), "feature_index", "left")
    good = F.coalesce(F.col("reason") == "", F.lit(False))
    return out.select(
        "feature_index", F.when(good, "repaired").otherwise("unchanged").alias("status"), text("shape").alias("before"), text(F.when(good, F.col("after")).otherwise(F.col("shape"))).alias("after"),
        F.col("area").alias("area_before"), F.when(good, F.col("area_after")).otherwise(F.col("area")).alias("area_after"), F.when(good, F.col("shift")).otherwise(0.0).alias("shape_shift"),
        F.when(good, F.col("anchors")).otherwise(F.array().cast("array<bigint>")).alias("snapped_to"), F.coalesce("reason", F.lit(UNTOUCHED)).alias("reason"),
    )
