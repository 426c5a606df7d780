"""Checks of a road network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.geometry import wkb, wkt
from geolith.geometry.batch import LINE_HEAD, Flat, point_distances
from geolith.geometry.measure import Shape, hausdorff, point_segment_distances
from geolith.geometry.validity import lines_simple
from geolith.operators.tiles import Cache, envelope_pairs, prepared, require, saved, sorted_side, spread, with_shapes

LINES = ("LINESTRING", "MULTILINESTRING")
ISSUE_TYPES = ("broken_connection", "dangling_road", "dead_end", "duplicate_segment", "loop_error")
FINDING = "feature_indices array<bigint>, x double, y double, metric double"


@dataclass(frozen=True)
class RoadConfig:
    connection_tolerance: float = 0.01
    dangling_length_threshold: float = 1.0
    duplicate_tolerance: float = 1e-8
    duplicate_overlap_ratio: float = 0.98
    max_loop_length: float = 10.0

    def __post_init__(self):
        if min(self.connection_tolerance, self.dangling_length_threshold, self.duplicate_tolerance, self.max_loop_length) < 0 or not 0 <= self.duplicate_overlap_ratio <= 1:
            raise ValueError("limits must not be negative and the ratio within 0 and 1")


def _longest(batches):
    """The longest part of each line, with its ends. A plain line that is not closed is its own and no ring, so its measures hold and nothing else is asked of it."""
    for batch in batches:
        plain = np.array([d.startswith(LINE_HEAD) and d[9:25] != d[-16:] for d in batch["shape"]], dtype=bool)
        some = batch[plain]
        ends = np.frombuffer(b"".join(d[9:25] + d[-16:] for d in some["shape"]), dtype="<f8").reshape(-1, 4)
        unequal = (ends[:, :2] != ends[:, 2:]).any(1)  # bytes that differ may still be one place, as 0 and -0 are
        plain[np.flatnonzero(plain)[~unequal]] = False
        some, ends = some[unequal], ends[unequal]
        yield some[["feature_index", "shape", "length", "x0", "y0", "x1", "y1"]].assign(**dict(zip(("ax", "ay", "bx", "by"), ends.T)), ring=False, mx=np.nan, my=np.nan)
        rows = []
        for i, data in zip(batch["feature_index"][~plain], batch["shape"][~plain]):
            lines = [np.asarray(x)[:, :2] for x in wkb.load(data).lines]
            line = max(lines, key=lambda x: np.hypot(*np.diff(x, axis=0).T).sum())
            s = Shape(wkt.Geom("LINESTRING", lines=[line]))
            ring = bool((line[0] == line[-1]).all()) and lines_simple([line])
            rows.append((i, wkb.dump(wkt.Geom("LINESTRING", lines=[line])), s.length, *map(float, s.bounds), *map(float, line[0]), *map(float, line[-1]), ring, *s.centroid()))
        yield pd.DataFrame(rows, columns=["feature_index", "shape", "length", "x0", "y0", "x1", "y1", "ax", "ay", "bx", "by", "ring", "mx", "my"])


LONGEST = "feature_index bigint, shape binary, length double, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double, ring boolean, mx double, my double"


def _gap(batches):
    for batch in batches:
        _, first, row = np.unique(batch["r"], return_index=True, return_inverse=True)
        f = Flat.load(batch["rw"].to_numpy()[first].tolist())
        d = point_distances(f, batch[["px", "py"]].to_numpy(), row)
        yield batch[["of", "end", "px", "py", "r"]].assign(d=d)


def _same(config: RoadConfig):
    reach = max(config.duplicate_tolerance, 1e-12)

    def run(batches):
        shape = Cache()
        for batch in batches:
            rows = []
            for l, r, lw, rw in zip(batch["l"], batch["r"], batch["lw"], batch["rw"]):
                a, b = shape(lw), shape(rw)
                if hausdorff(a, b) > config.duplicate_tolerance:
                    continue
                d = point_segment_distances((b.segments[:, :2] + b.segments[:, 2:]) / 2, a.segments).min(1)
                n = np.hypot(b.segments[:, 2] - b.segments[:, 0], b.segments[:, 3] - b.segments[:, 1])
                share = float(n[d <= reach].sum()) / max(min(a.length, b.length), 1e-15)
                if share >= config.duplicate_overlap_ratio:
                    rows.append(([l, r], *a.centroid(), share))
            yield pd.DataFrame(rows, columns=["feature_indices", "x", "y", "metric"])

    return run


def road_findings(features: DataFrame, config: RoadConfig = RoadConfig(), geometry: str = "geometry", index: str = "feature_index") -> DataFrame:
    """Findings (issue_type, feature_indices, x, y, metric) of five checks; a MultiLineString counts as its longest part.

    dead_end: an end that no other end is within duplicate_tolerance of (0 means exactly there).  dangling_road: a
    dead end of a line no longer than the threshold; metric is the length.  broken_connection: a dead end whose
    nearest other line is 0 < d <= connection_tolerance away (ties: lowest index); metric is d.  loop_error: a closed
    simple line no longer than max_loop_length.  duplicate_segment: two lines within duplicate_tolerance whose
    overlap share reaches the ratio.  Other geometries than lines, missing or empty ones raise ValueError.
    """
    shapes = saved(prepared(spread(features, index), index, geometry).drop("area"))
    require(shapes, LINES)
    lines = saved(shapes.drop("kind", "fault").mapInPandas(_longest, LONGEST))
    ends = lines.select("feature_index", "length", F.posexplode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("end", "p"))
    ends = ends.select(F.col("feature_index").alias("of"), "length", "end", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    tolerance = config.duplicate_tolerance
    if tolerance == 0:
        degree = ends.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), F.min("of").alias("of"), F.min("end").alias("end")).where("n = 1")
        dead = ends.join(sorted_side(degree.select("of", "end")), ["of", "end"])
    else:
        # Exact places are counted first, so a junction of many ends is one row; then places within the tolerance.
        spots = ends.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        cell = lambda c: F.floor(F.col(c) / tolerance)
        around = lambda c: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: cell(c) + k)
        places = ends.select("px", "py").distinct()
        near = places.select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.explode(around("px")).alias("cx"), "py").withColumn("cy", F.explode(around("py"))).drop("py")
        own = spots.withColumns({"cx": cell("px"), "cy": cell("py")})
        company = own.join(sorted_side(near), ["cx", "cy"]).where(((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy"))) & (F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")) <= tolerance)).select("px", "py").distinct()
        alone = spots.select("px", "py").join(sorted_side(company), ["px", "py"], "left_anti")
        dead = saved(ends.join(sorted_side(alone), ["px", "py"]))
    point = [F.col("px").alias("x"), F.col("py").alias("y")]
    one = F.array("of").alias("feature_indices")
    found = dead.select(F.lit("dead_end").alias("issue_type"), one, *point, F.lit(None).cast("double").alias("metric"))
    found = found.unionByName(dead.where(F.col("length") <= config.dangling_length_threshold).select(F.lit("dangling_road").alias("issue_type"), one, *point, F.col("length").alias("metric")))
    # Ends are named by a written number: any arithmetic on indices would overflow for hashed ones.
    spots = saved(dead.select(F.monotonically_increasing_id().alias("feature_index"), F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"), "of", "end", "px", "py"))
    met = envelope_pairs(spots, lines, config.connection_tolerance).join(sorted_side(spots.select(F.col("feature_index").alias("l"), "of", "end", "px", "py")), "l").where("r <> of")
    gaps = met.join(sorted_side(lines.select(F.col("feature_index").alias("r"), F.col("shape").alias("rw"))), "r").mapInPandas(_gap, "of bigint, end int, px double, py double, r bigint, d double")
    nearest = gaps.where((F.col("d") > 0) & (F.col("d") <= config.connection_tolerance)).groupBy("of", "end", "px", "py").agg(F.min(F.struct("d", "r")).alias("m"))
    found = found.unionByName(nearest.select(F.lit("broken_connection").alias("issue_type"), F.array("of", "m.r").alias("feature_indices"), *point, F.col("m.d").alias("metric")))
    loops = lines.where(F.col("ring") & (F.col("length") <= config.max_loop_length))
    found = found.unionByName(loops.select(F.lit("loop_error").alias("issue_type"), F.array("feature_index").alias("feature_indices"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("length").alias("metric")))
    # Lines as near as that have their envelopes' corners as near: corners are joined, not envelopes that merely meet.
    corners = lines.select("feature_index", F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    corners = corners.withColumns({"x0": F.col("u0"), "y0": F.col("v0"), "x1": F.col("u0"), "y1": F.col("v0")})
    alike = envelope_pairs(corners, tolerance=tolerance, keep=("u1", "v1"))
    alike = alike.where(F.greatest(*[F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) for c in ("u1", "v1")]) <= tolerance).select("l", "r")
    # The issue's name stands outside of Python, so that a reader of other issues does not compare lines at all.
    found = found.unionByName(with_shapes(alike, lines).mapInPandas(_same(config), FINDING).withColumn("issue_type", F.lit("duplicate_segment")))
    # Findings of one kind, place and features are one; should their metrics differ, the greatest counts.
    return found.groupBy("issue_type", "feature_indices", "x", "y").agg(F.max("metric").alias("metric"))


def road_issue_counts(findings: DataFrame) -> DataFrame:
    """Number of findings of every issue type, zeros included."""
    kinds = findings.sparkSession.createDataFrame([(k,) for k in ISSUE_TYPES], "issue_type string")
    counted = findings.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, "issue_type", "left").select("issue_type", F.coalesce("n", F.lit(0)).alias("findings"))
