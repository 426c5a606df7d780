"""Conflicts between layers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.geometry.batch import common_areas, common_lengths, of_pairs
from geolith.geometry.measure import TOUCH, intersects, length_inside, overlay_areas, shared_length
from geolith.operators.tiles import envelope_pairs, prepared, saved, with_shapes


@dataclass(frozen=True)
class ConflictPolicy:
    road_river_base: float = 45.0
    building_river_base: float = 80.0
    overlap_base: float = 60.0
    boundary_base: float = 55.0
    magnitude_weight: float = 20.0

    def __post_init__(self):
        if not all(0 <= v <= 100 for v in self.__dict__.values()):
            raise ValueError("bases and weight must be within 0 and 100")


def conflict_rule(left_role: Column, right_role: Column, left_agency: Column, right_agency: Column) -> Column:
    """The conflict type of two layers, null if none; roles go before agencies, in any order and case."""
    a, b = F.lower(left_role), F.lower(right_role)
    roles = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    told = (F.coalesce(left_agency, F.lit("")) != "") & (F.coalesce(right_agency, F.lit("")) != "")
    return (
        F.when(roles("road", "river"), "road_river_crossing")
        .when(roles("building", "river"), "building_in_river")
        .when((a == "boundary") & (b == "boundary"), "boundary_conflict")
        .when(told & (left_agency != right_agency), "inter_agency_overlap")
    )


def common_measure(a, b) -> float | None:
    """Area, or length, of the intersection; 0 for a common point, None without common point."""
    if not intersects(a, b):
        return None
    if a.area > 0 and b.area > 0:
        both = overlay_areas(a, b)[2]
        return both if both > 1e-12 * min(a.area, b.area) else shared_length(a.segments, b.segments)
    if a.area > 0 or b.area > 0:
        region, line = (a, b) if a.area > 0 else (b, a)
        return length_inside(line.segments, region)
    return shared_length(a.segments, b.segments)


def _magnitudes(batches):
    """l, r, conflict_type, lw, rw -> the pairs that share a point with the common measure's share. Polygons are overlaid by batch, the rest one by one."""
    for batch in batches:
        f, l, r = of_pairs(batch["l"], batch["r"], batch["lw"], batch["rw"], True)
        common, known = np.zeros(len(l)), np.zeros(len(l), dtype=bool)
        areal = np.flatnonzero((f.area[l] > 0) & (f.area[r] > 0) & (np.maximum(f.edges_n[l], f.edges_n[r]) <= 512))
        if len(areal):
            both = common_areas(f, l[areal], r[areal])[:, 2]
            over = both > TOUCH * np.minimum(f.area[l[areal]], f.area[r[areal]])
            common[areal[over]], known[areal[over]] = both[over], True
            beside = areal[~over]
            if len(beside):
                length, sure = common_lengths(f, l[beside], r[beside])
                sure &= length > 0
                common[beside[sure]], known[beside[sure]] = length[sure], True
        keep = known.copy()
        for k in np.flatnonzero(~known):
            found = common_measure(f.shape(int(l[k])), f.shape(int(r[k])))
            if found is not None:
                common[k], keep[k] = found, True
        least = np.minimum(f.measure[l], f.measure[r])
        share = np.where(least > 0, np.minimum(1.0, common / np.where(least > 0, least, 1)), 1.0)
        yield batch.loc[keep, ["l", "r", "conflict_type"]].assign(magnitude=share[keep])


def analyze_conflicts(features: DataFrame, policy: ConflictPolicy = ConflictPolicy(), geometry: str = "geometry") -> DataFrame:
    """Features of two layers that have a rule and share a point: conflict_type, left_layer, right_layer, left_index, right_index, severity_score, magnitude.

    features: layer_seq (order of layers), layer_name, layer_role, agency, feature_index and the geometry; several
    layers may use the same indices. The layer of lower layer_seq is left. magnitude is the measure of the common
    part over the lesser measure, at most 1, and 1 where that is 0. Null, empty and unreadable geometries are in no
    conflict. Only layers (of one role and agency each) that have a rule are joined, pair by pair: a feature has one row
    for each its own has a rule with, and features of one layer never meet.
    """
    keyed = features.select("layer_seq", "layer_name", "layer_role", "agency", F.col("feature_index").cast("bigint").alias("own_index"), F.col(geometry).alias("geometry"))
    layers = saved(keyed.select("layer_seq", F.col("layer_role").alias("role"), "agency").distinct())  # metadata
    side = lambda s: layers.select(*[F.col(c).alias(f"{s}_{c}") for c in layers.columns])
    ruled = side("l").join(side("r"), F.col("l_layer_seq") < F.col("r_layer_seq")).withColumn("conflict_type", conflict_rule(*[F.col(c) for c in ("l_role", "r_role", "l_agency", "r_agency")]))
    ruled = saved(ruled.where("conflict_type is not null").withColumn("pair", F.monotonically_increasing_id()))
    numbered = saved(keyed.withColumn("id", F.monotonically_increasing_id()))  # written, so that a feature keeps its number
    info = numbered.select("id", "layer_seq", "layer_name", F.col("layer_role").alias("role"), "agency", "own_index")
    shapes = saved(prepared(numbered, "id").where("fault is null"))
    placed = shapes.select("feature_index", "x0", "y0", "x1", "y1").join(info.select(F.col("id").alias("feature_index"), "layer_seq", "role", "agency"), "feature_index")

    def of_pairs(s):
        ends = ruled.select(*[F.col(f"{s}_{c}").alias(f"of_{c}") for c in ("layer_seq", "role", "agency")], "pair", "conflict_type")
        same = F.lit(True)
        for c in ("layer_seq", "role", "agency"):
            same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
        return placed.join(ends, same).drop("of_layer_seq", "of_role", "of_agency")

    met = envelope_pairs(of_pairs("l"), of_pairs("r"), by=("pair", "conflict_type"))
    found = with_shapes(met.select("l", "r", "conflict_type"), shapes.select("feature_index", "shape")).mapInPandas(_magnitudes, "l bigint, r bigint, conflict_type string, magnitude double")
    named = lambda s: info.select(F.col("id").alias(s), F.struct("layer_name", "own_index").alias(s + "i"))
    out = found.join(named("l"), "l").join(named("r"), "r")
    first, second = F.col("li"), F.col("ri")
    base = F.create_map(*[F.lit(v) for k in (("road_river_crossing", policy.road_river_base), ("building_in_river", policy.building_river_base), ("inter_agency_overlap", policy.overlap_base), ("boundary_conflict", policy.boundary_base)) for v in k])
    severity = F.round(F.least(F.lit(100.0), F.element_at(base, F.col("conflict_type")) + policy.magnitude_weight * F.col("magnitude")), 2)
    return out.select(
        "conflict_type", first["layer_name"].alias("left_layer"), second["layer_name"].alias("right_layer"), first["own_index"].alias("left_index"), second["own_index"].alias("right_index"),
        severity.alias("severity_score"), F.round("magnitude", 6).alias("magnitude"),
    )


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    """Conflicts and greatest severity by type."""
    return conflicts.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("conflicts"), F.max("severity_score").alias("maximum_severity"))
