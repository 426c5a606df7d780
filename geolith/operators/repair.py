"""Repair of geometries and coverages.

Repair of one geometry is a map.  Overlaps need no sequence: what a feature loses is its part in the union of all
earlier ones, so one tile join and one group for each feature do.  Gaps are found tile by tile (geolith.operators.gaps).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.geometry import overlay, wkb, wkt
from geolith.geometry.batch import Flat, as_wkb, hausdorff_distances
from geolith.geometry.boxes import boxes_of, column_boxes, paired, polygons_of, sides_of, texts_of
from geolith.geometry.repair import AREA_EPSILON, RepairConfig, area, polygonal, repair, shift, unsafe, vertex_count
from geolith.geometry.validity import invalid_reason
from geolith.operators.gaps import fill_gaps
from geolith.operators.tiles import envelope_pairs, prepared, read_geometry, sorted_side, spread
from geolith.storage import Scratch

ACTIONS = "array<struct<issue_type:string,strategy:string,detail:string>>"
RESULT = f"feature_index bigint, geometry_type string, status string, before string, after string, actions {ACTIONS}, area_before double, area_after double, vertex_count_before bigint, vertex_count_after bigint, shape_shift double, failure_reason string"
NAMES = [c.strip().split()[0] for c in RESULT.replace(ACTIONS, "x").split(",")]


def _named(actions):
    return [dict(zip(("issue_type", "strategy", "detail"), a)) if not isinstance(a, dict) else a for a in actions]


def result_row(index, before: wkt.Geom, after: wkt.Geom, actions, failure: str | None, known: tuple[float, float, float] | None = None):
    """known: areas before and after, and shift, of a candidate that unsafe has judged."""
    if failure:
        status, after, actions, known = "failed", before, [], known and (known[0], known[0], 0.0)
    elif not actions:
        status, after, known = "unchanged", before, known and (known[0], known[0], 0.0)
    else:
        status = "failed" if known is None and invalid_reason(after) else "repaired"
    sizes = known or (area(before), area(after), shift(before, after))
    return (index, before.kind.title(), status, wkt.dump(before), wkt.dump(after), _named(actions), *sizes[:2], vertex_count(before), vertex_count(after), sizes[2], failure)


def _geometry(value) -> wkt.Geom:
    return wkt.Geom("GEOMETRYCOLLECTION") if value is None else read_geometry(value)


def repair_geometries_alone(features: DataFrame, config: RepairConfig = RepairConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """Each geometry repaired by itself. A null geometry is an empty collection; one that cannot be read has failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, value in zip(batch["feature_index"], batch["geometry"]):
                try:
                    g = _geometry(value)
                except wkt.BadGeometry as error:
                    rows.append((i, None, "failed", None, None, [], None, None, None, None, None, str(error)))
                    continue
                after, actions = repair(g, config)
                rows.append(result_row(i, g, after, actions, None))
            yield pd.DataFrame(rows, columns=NAMES)

    return features.select(features[index].cast("bigint").alias("feature_index"), features[geometry].alias("geometry")).mapInPandas(run, RESULT)


STAGE = f"feature_index bigint, before binary, shape binary, actions {ACTIONS}, failure string"
STAGE_NAMES = ["feature_index", "before", "shape", "actions", "failure"]


def _sound(corners: np.ndarray, config: RepairConfig) -> np.ndarray:
    """Which boxes are sure to need no repair: valid, no sliver by more than rounding, no side within the tolerance of vertices."""
    w, h = sides_of(corners)
    with np.errstate(over="ignore", invalid="ignore"):
        size, around = w * h, 2 * (w + h)
        thick = (size > config.sliver_area_threshold * (1 + 1e-9)) & (4 * np.pi * size > config.sliver_thinness_threshold * around**2 * (1 + 1e-9)) & np.isfinite(around**2)
    return (np.minimum(w, h) > config.duplicate_vertex_tolerance) & thick & (size > 0)


def _first_stage(config: RepairConfig):
    def run(batches):
        for batch in batches:
            values = batch["geometry"].tolist()
            at, corners = column_boxes(values)
            sound = _sound(corners, config)
            at, corners = at[sound], corners[sound]
            if len(at):
                same = as_wkb(corners.reshape(-1, 2), np.full(len(at), 5), np.ones(len(at), dtype=bool))
                yield pd.DataFrame({"feature_index": batch["feature_index"].to_numpy()[at], "before": same, "shape": same, "actions": [[] for _ in same], "failure": None})
            batch = batch.drop(batch.index[at])
            rows = []
            for i, value in zip(batch["feature_index"], batch["geometry"]):
                try:
                    g = _geometry(value)
                except wkt.BadGeometry as error:
                    rows.append((i, None, None, [], str(error)))
                    continue
                after, actions = repair(g, config)
                failure = unsafe(g, after, config)
                rows.append((i, wkb.dump(g), wkb.dump(g if failure else after), _named(actions), failure))
            yield pd.DataFrame(rows, columns=STAGE_NAMES)

    return run


def _erased(index: int, own: bytes, others: list[bytes]):
    """One feature without the earlier ones it meets; None where they have no area in common."""
    polygons = polygons_of(own)
    rest = overlay.difference(polygons, *[polygons_of(w) for w in others])
    common = overlay.area_of(polygons) - overlay.area_of(rest)
    return None if common <= AREA_EPSILON else (index, wkb.dump(overlay.region(rest)), f"Erased {common:.6g} of overlap.")


def _may_overlap(own: list[bytes], other: list[bytes]) -> list[bool]:
    """False for pairs of boxes without area in common, which are exact in their comparisons; True for all other pairs."""
    out = np.ones(len(own), dtype=bool)
    both, a, b = paired(own, other)
    out[both] = (np.maximum(a[:, :2], b[:, :2]) < np.minimum(a[:, 2:], b[:, 2:])).all(1)
    return out.tolist()


def _erase(batches):
    """Rows sorted by feature: one feature's rows follow one another, so only they are held, and small groups cost no more than their rows. Where no row has area in common by its boxes, nothing is cut."""
    index, own, others, cut = None, None, [], False
    for batch in batches:
        out = []
        for i, mine, other, common in zip(batch["feature_index"].tolist(), batch["own"], batch["other"], _may_overlap(batch["own"].tolist(), batch["other"].tolist())):
            if i != index:
                if cut and (found := _erased(index, own, others)):
                    out.append(found)
                index, own, others, cut = i, mine, [], False
            others.append(other)
            cut = cut or common
        yield pd.DataFrame(out, columns=["feature_index", "erased", "detail"])
    if cut and (found := _erased(index, own, others)):
        yield pd.DataFrame([found], columns=["feature_index", "erased", "detail"])


def _untouched(batch: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame | None]:
    """The rows of boxes that nothing was done to, and their results."""
    same = np.array([b is not None and b == s and f is None and not len(a) for b, s, a, f in zip(batch["before"], batch["shape"], batch["actions"], batch["failure"])], dtype=bool)
    rows = np.flatnonzero(same)
    at, corners = boxes_of(batch["before"].to_numpy()[rows].tolist())
    texts = texts_of(corners)
    if texts is None or not len(at):
        return rows[:0], None
    w, h = sides_of(corners)
    index = batch["feature_index"].to_numpy()[rows[at]]
    return rows[at], pd.DataFrame(dict(zip(NAMES, (index, "Polygon", "unchanged", texts, texts, [[] for _ in texts], w * h, w * h, 5, 5, 0.0, None))), columns=NAMES)


def _finish(config: RepairConfig):
    def run(batches):
        for batch in batches:
            gone, done = _untouched(batch)
            if done is not None:
                yield done
                batch = batch.drop(batch.index[gone])
            rows = []
            unread = batch["before"].isna().to_numpy(dtype=bool)
            judged = batch[~unread]
            for r in batch[unread].itertuples():
                rows.append((r.feature_index, None, "failed", None, None, [], None, None, None, None, None, r.failure))
            n = len(judged)
            flat = Flat.load(judged["before"].tolist() + judged["shape"].tolist())
            l, r = np.arange(n), np.arange(n, 2 * n)
            far = np.zeros(n)
            some = (flat.vertices_n[l] > 0) & (flat.vertices_n[r] > 0)
            far[some] = hausdorff_distances(flat, l[some], r[some])
            for i, b, a, actions, failure, *known in zip(judged["feature_index"], judged["before"], judged["shape"], judged["actions"], judged["failure"], flat.area[:n].tolist(), flat.area[n:].tolist(), far.tolist()):
                before, after = wkb.load(b), wkb.load(a)
                rows.append(result_row(i, before, after, list(actions), failure or unsafe(before, after, config, known), known))
            yield pd.DataFrame(rows, columns=NAMES)

    return run


def repair_coverage(spark: SparkSession, features: DataFrame, config: RepairConfig = RepairConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """A set of geometries repaired as one coverage, the lower index having priority where two overlap.

    Per feature: the repair of repair_geometries_alone under the safety rules; then what overlaps an earlier feature
    is erased from the later one, and small gaps are filled into the neighbour with the longest common edge (ties:
    lowest index). Last, whoever breaks a safety rule gets its original back and has failed; nothing is run again.
    Null geometries are empty collections. An empty table gives no rows.
    """
    scratch = Scratch(spark, "coverage")
    base = features.select(features[index].cast("bigint").alias("feature_index"), features[geometry].alias("geometry"))
    stage = scratch.save(spread(base, "feature_index").mapInPandas(_first_stage(config), STAGE))
    action = lambda kind, strategy, detail: F.struct(F.lit(kind).alias("issue_type"), F.lit(strategy).alias("strategy"), detail.alias("detail"))
    if config.resolve_overlaps:
        shapes = scratch.save(prepared(stage.where("shape is not null"), geometry="shape").where("kind in ('POLYGON', 'MULTIPOLYGON') and fault is null").select("feature_index", "shape", "x0", "y0", "x1", "y1"))
        # What meets others in points and borders alone loses nothing.
        cut = scratch.save(envelope_pairs(shapes, area=True).select("r").distinct())
    whole = config.resolve_overlaps and cut.isEmpty()
    if config.resolve_overlaps and not whole:
        pairs = envelope_pairs(shapes).join(sorted_side(cut), "r", "left_semi")
        own = shapes.select(F.col("feature_index").alias("r"), F.col("shape").alias("own"))
        other = shapes.select(F.col("feature_index").alias("l"), F.col("shape").alias("other"))
        groups = pairs.join(sorted_side(own), "r").join(sorted_side(other), "l").select(F.col("r").alias("feature_index"), "own", F.col("l").alias("other_index"), "other")
        erased = spread(groups, "feature_index").sortWithinPartitions("feature_index", "other_index").mapInPandas(_erase, "feature_index bigint, erased binary, detail string")
        stage = scratch.save(
            stage.join(sorted_side(erased), "feature_index", "left").select(
                "feature_index", "before", F.coalesce("erased", "shape").alias("shape"),
                F.when(F.col("erased").isNotNull(), F.concat("actions", F.array(action("overlap", "erase_overlap", F.col("detail"))))).otherwise(F.col("actions")).alias("actions"), "failure",
            )
        )
    if config.fill_gaps:
        if not whole:
            shapes = scratch.save(prepared(stage.where("shape is not null"), geometry="shape").where("kind in ('POLYGON', 'MULTIPOLYGON') and fault is null").select("feature_index", "shape", "x0", "y0", "x1", "y1"))
        filled = fill_gaps(spark, shapes, config.gap_area_threshold, scratch)
        stage = stage.join(sorted_side(filled), "feature_index", "left").select(
            "feature_index", "before", F.coalesce("filled", "shape").alias("shape"),
            F.when(F.col("filled").isNotNull(), F.concat("actions", F.transform("details", lambda d: action("gap", "fill_gap", d)))).otherwise(F.col("actions")).alias("actions"), "failure",
        )
    return spread(stage, "feature_index").mapInPandas(_finish(config), RESULT)


def repair_report(results: DataFrame) -> DataFrame:
    """One row: total, repaired, unchanged and failed features, total area delta, greatest shape shift (0 without features)."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    return results.agg(
        F.count(F.lit(1)).alias("total_count"), is_("repaired").alias("repaired_count"), is_("unchanged").alias("unchanged_count"), is_("failed").alias("failed_count"),
        F.coalesce(F.round(F.sum(F.col("area_after") - F.col("area_before")), 6), F.lit(0.0)).alias("total_area_delta"), F.coalesce(F.round(F.max("shape_shift"), 6), F.lit(0.0)).alias("max_shape_shift"),
    )


def action_counts(results: DataFrame) -> DataFrame:
    """Number of actions by issue type."""
    return results.select(F.explode("actions").alias("a")).groupBy(F.col("a.issue_type").alias("issue_type")).agg(F.count(F.lit(1)).alias("actions"))


class RepairSession:
    """A working set of geometries with preview, apply and undo. Versions are written tables, undo moves back to one."""

    def __init__(self, spark: SparkSession, features: DataFrame, config: RepairConfig = RepairConfig(), geometry: str = "geometry"):
        self.spark, self.config, self.scratch = spark, config, Scratch(spark, "session")
        self._versions = [self.scratch.save(features.select("feature_index", F.col(geometry).alias("geometry")))]
        self._candidate: DataFrame | None = None

    @property
    def geometries(self) -> DataFrame:
        return self._versions[-1]

    @property
    def undo_depth(self) -> int:
        return len(self._versions) - 1

    @property
    def can_undo(self) -> bool:
        return self.undo_depth > 0

    def preview(self) -> DataFrame:
        """The repair of the current set; computed once for a version."""
        if self._candidate is None:
            self._candidate = self.scratch.save(repair_coverage(self.spark, self.geometries, self.config))
        return self._candidate

    def apply(self) -> DataFrame:
        """Commit the preview; a version is pushed only if a geometry changed."""
        results = self.preview()
        if not results.where("status = 'repaired' and before <> after").isEmpty():
            self._versions.append(self.scratch.save(results.select("feature_index", F.col("after").alias("geometry"))))
            self._candidate = None
        return results

    def undo(self) -> DataFrame:
        if not self.can_undo:
            raise IndexError("there is nothing to undo")
        self._versions.pop()
        self._candidate = None
        return self.geometries


def config_json(config: RepairConfig) -> str:
    return json.dumps(asdict(config), sort_keys=True)
