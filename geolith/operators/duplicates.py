"""Near-duplicate features by envelope candidates and three similarities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.geometry import wkb, wkt
from geolith.geometry.batch import of_pairs, similarities_of
from geolith.geometry.exact import topologically_equal
from geolith.operators.tiles import envelope_pairs, likely_pairs, prepared, require, saved, spread, with_shapes

PAIR = "left_index bigint, right_index bigint, similarity double, iou double, hausdorff_similarity double, shape_similarity double, exact boolean"
TIE = 1e-12


@dataclass(frozen=True)
class DuplicateConfig:
    similarity_threshold: float = 0.85
    search_tolerance: float = 0.0
    maximum_pairs: int | None = None
    weight_iou: float = 0.45
    weight_hausdorff: float = 0.35
    weight_shape: float = 0.20

    def __post_init__(self):
        if not 0 <= self.similarity_threshold <= 1 or self.search_tolerance < 0:
            raise ValueError("threshold must be within 0 and 1 and the tolerance not negative")
        if abs(sum(self.weights) - 1) > 1e-9 or min(self.weights) < 0:
            raise ValueError("weights must not be negative and sum to 1")
        if self.maximum_pairs is not None and self.maximum_pairs < 1:
            raise ValueError("maximum_pairs must be positive")

    @property
    def weights(self):
        return self.weight_iou, self.weight_hausdorff, self.weight_shape


def scores(config: DuplicateConfig):
    def run(batches):
        for batch in batches:
            flat, l, r = of_pairs(batch["l"], batch["r"], batch["lw"], batch["rw"], True)
            parts = similarities_of(flat, l, r, config.weights, config.similarity_threshold)
            value = parts @ np.array(config.weights)
            keep = value + TIE >= config.similarity_threshold
            kept, value, parts = batch[keep], value[keep], parts[keep]
            equal = [lw == rw or (v > 1 - 1e-6 and topologically_equal(wkt.dump(wkb.load(lw)), wkt.dump(wkb.load(rw)))) for lw, rw, v in zip(kept["lw"], kept["rw"], value)]
            yield pd.DataFrame(dict(zip([c.split()[0] for c in PAIR.split(", ")], (kept["l"].to_numpy(), kept["r"].to_numpy(), value, *parts.T, np.array(equal, dtype=bool)))))

    return run


def detect_duplicates(features: DataFrame, config: DuplicateConfig = DuplicateConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """Pairs left_index < right_index that reach the similarity, with similarity_percent and its three parts.

    Candidates are pairs whose envelopes meet (touching counts), the lower index's grown by search_tolerance. Where
    maximum_pairs is set, only the first candidates by (left, right) are scored, as a report asks for; by default all
    are. Missing or empty geometries raise ValueError. Order the result by similarity_percent descending and indices.
    """
    shapes = saved(prepared(spread(features, index), index, geometry))
    require(shapes)
    if config.maximum_pairs is None:
        pairs = likely_pairs(shapes, None, config.search_tolerance, config.weights, config.similarity_threshold)
    else:
        pairs = envelope_pairs(shapes, tolerance=config.search_tolerance).orderBy("l", "r").limit(config.maximum_pairs)
    found = with_shapes(pairs, shapes).mapInPandas(scores(config), PAIR)
    return found.select(
        "left_index", "right_index", F.round(F.col("similarity") * 100, 4).alias("similarity_percent"),
        *[F.round(c, 6).alias(c) for c in ("iou", "hausdorff_similarity", "shape_similarity")], "exact",
    )


def duplicate_statistics(features: DataFrame, config: DuplicateConfig = DuplicateConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """One row: feature_count, possible_pairs, candidate_pairs, candidate_reduction_percent (100 where no pair is possible), truncated."""
    shapes = saved(prepared(features, index, geometry).drop("shape"))
    n = shapes.agg(F.count(F.lit(1)).alias("feature_count"))
    c = envelope_pairs(shapes, tolerance=config.search_tolerance).agg(F.count(F.lit(1)).alias("met"))
    most = F.lit(config.maximum_pairs) if config.maximum_pairs is not None else F.col("met")
    possible = (F.col("feature_count") * (F.col("feature_count") - 1) / 2).cast("bigint")
    out = n.crossJoin(c).select("feature_count", possible.alias("possible_pairs"), F.least("met", most).alias("candidate_pairs"), (F.lit(config.maximum_pairs is not None) & (F.col("met") >= most)).alias("truncated"))  # one row each
    share = F.when(F.col("possible_pairs") > 0, 100 * (1 - F.col("candidate_pairs") / F.col("possible_pairs"))).otherwise(100.0)
    return out.withColumn("candidate_reduction_percent", F.round(share, 6))
