"""Candidate pairs of geometries whose envelopes meet, as an equi-join on tiles.

A geometry's level is the binary order of its envelope's longer side (grown by the tolerance), so it covers at
most 3 x 3 tiles of its level, whatever the mixture of sizes.  A pair meets at the level of the larger one: each
geometry is registered in the tiles it covers at its own level and, as a guest, at the coarser levels that occur.
A pair is kept only in the tile that holds the lower left corner of the envelopes' common part, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.geometry import wkb, wkt
from geolith.geometry.batch import Flat, as_wkb, read_plain
from geolith.geometry.boxes import boxes_of
from geolith.geometry.measure import Shape
from geolith.storage import Scratch

SHAPES = "feature_index bigint, shape binary, kind string, area double, length double, x0 double, y0 double, x1 double, y1 double, fault string"
LOWEST_LEVEL = -20


def read_geometry(value) -> wkt.Geom | None:
    """WKT text or WKB bytes; None for null."""
    if value is None:
        return None
    return wkt.parse(value) if isinstance(value, str) else wkb.load(value)


SHAPE_NAMES = [c.split()[0] for c in SHAPES.split(", ")]


def _prepare_others(indices, values):
    """Rows of SHAPES, one by one."""
    rows = []
    for index, value in zip(indices, values):
        try:
            g = read_geometry(value)
        except wkt.BadGeometry as error:
            rows.append((index, None, None, None, None, None, None, None, None, str(error)))
            continue
        if g is None or g.empty:
            rows.append((index, None if g is None else wkb.dump(g), None if g is None else g.kind, 0.0, 0.0, None, None, None, None, "null" if g is None else "empty"))
            continue
        s = Shape(g)
        rows.append((index, wkb.dump(g), g.kind, s.area, s.length, *map(float, s.bounds), None))
    return pd.DataFrame(rows, columns=SHAPE_NAMES)


def _prepare(batches):
    for batch in batches:
        values = batch["geometry"].tolist()
        at, polygon, n, xy = read_plain(values)
        binary = [i for i, v in enumerate(values) if not isinstance(v, str)]
        boxes, corners = boxes_of([values[i] for i in binary])
        if len(boxes):
            at, polygon, n, xy = (np.concatenate(x) for x in ((at, np.array(binary)[boxes]), (polygon, np.ones(len(boxes), dtype=bool)), (n, np.full(len(boxes), 5)), (xy, corners.reshape(-1, 2))))
        if len(at):
            flat = Flat(xy, n, polygon.astype(np.int64), np.arange(len(at)), len(at))
            kinds = np.where(polygon, "POLYGON", "LINESTRING").astype(object)
            yield pd.DataFrame(dict(zip(SHAPE_NAMES, (batch["feature_index"].to_numpy()[at], as_wkb(xy, n, polygon), kinds, flat.area, flat.length, *flat.bounds.T, None))))
        if len(at) < len(values):
            rest = np.ones(len(values), dtype=bool)
            rest[at] = False
            yield _prepare_others(batch["feature_index"][rest], batch["geometry"][rest])


def prepared(features: DataFrame, index: str = "feature_index", geometry: str = "geometry") -> DataFrame:
    """One row for each feature with its shape as WKB, measures and envelope; fault tells null, empty and unreadable geometries."""
    kept = features.select(features[index].cast("bigint").alias("feature_index"), features[geometry].alias("geometry"))
    return kept.mapInPandas(_prepare, SHAPES)


def saved(df: DataFrame) -> DataFrame:
    """The table written once, where several steps read what Python made."""
    return Scratch(df.sparkSession, "shapes").save(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys over as many tasks as the session shuffles with, for work in Python: partitions of few bytes are else put together, however much there is to compute."""
    spark = df.sparkSession
    # One more than a shuffle has: a repartition to what the rows already have is optimised away, and its tasks are put together.
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) + 1, *keys)


def runs(batches: Iterable[pd.DataFrame], *keys: str):
    """(frame, starts): the batches again, each of whole runs of rows with equal keys, and where the runs start and the last one ends. For rows that are sorted by keys, as a group of its own costs far more than its rows."""
    left = None
    for batch in batches:
        batch = batch if left is None else pd.concat((left, batch), ignore_index=True)
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            left = batch
            continue
        left = batch.iloc[starts[-1] :]
        yield batch.iloc[: starts[-1]], [0, *starts.tolist()]
    if left is not None and len(left):
        batch = left.reset_index(drop=True)
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        yield batch, [0, *np.flatnonzero(new).tolist(), len(batch)]


def sorted_side(df: DataFrame) -> DataFrame:
    """A table that grows with the features, as a side of a join: joined by sorting, never broadcast.

    Catalyst takes a table's size from the bytes of its files, and shapes are compressed there to a small part of what
    they take in memory: under its limit a table of a million shapes would be built in the driver.
    """
    return df.hint("merge")


def broadcast_limit(spark: SparkSession) -> int:
    """The session's limit for broadcasts in bytes, negative where there are none."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def require(shapes: DataFrame, kinds: Iterable[str] | None = None) -> None:
    """Raise ValueError if a geometry is missing, empty, unreadable or of another kind than wanted."""
    bad = F.col("fault").isNotNull()
    if kinds is not None:
        bad = bad | ~F.col("kind").isin(*kinds)
    first = shapes.where(bad).select("feature_index", "kind", "fault").limit(1).collect()
    if first:
        raise ValueError(f"feature {first[0]['feature_index']}: {first[0]['fault'] or first[0]['kind']} is not accepted")


def _side(tolerance: float) -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * tolerance


def envelope_pairs(left: DataFrame, right: DataFrame | None = None, tolerance: float = 0.0, keep: tuple[str, ...] = (), by: tuple[str, ...] = (), area: bool = False) -> DataFrame:
    """(l, r) of features whose envelopes, the left grown by the tolerance, meet; with right None l < r within left.

    keep: further columns of both sides, returned with the prefix l_ or r_. by: columns that must be equal on both sides,
    part of the join's key and returned. area: only envelopes with area in common, so that borders reach into no tile.
    Features without envelope have no pairs.
    """
    one = right is None
    right = left if one else right

    def levelled(df, grow):
        side = _side(grow)
        level = F.when(side > 0, F.greatest(F.ceil(F.log2(side)), F.lit(LOWEST_LEVEL))).otherwise(LOWEST_LEVEL).cast("int")
        return df.where("x0 is not null").select(
            F.col("feature_index").alias("id"), *keep, *by,
            (F.col("x0") - grow).alias("a0"), (F.col("y0") - grow).alias("b0"), (F.col("x1") + grow).alias("a1"), (F.col("y1") + grow).alias("b1"), level.alias("own"),
        )

    a, b = levelled(left, tolerance), levelled(right, 0.0)
    # The levels that occur, with their features on each side: at most one for each binary order of magnitude.
    side_of = lambda df, s: df.select("own", F.lit(s).alias("side"))
    counted = side_of(a, "l").union(side_of(b, "r")).groupBy("own", "side").count().collect()
    levels = sorted({r["own"] for r in counted})
    if not levels:
        levels = [0]
    home_of = {s: {r["own"] for r in counted if r["side"] == s} for s in "lr"}
    # Where a lane can have pairs at all: natives of the left with what is no larger, its guests with natives of the right.
    lane_levels = [k for k in levels if k in home_of["l"] and min(home_of["r"], default=k + 1) <= k], [k for k in levels if k in home_of["r"] and min(home_of["l"], default=k) < k]

    def tiled(df, s):
        at = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("own"))
        out = df.withColumn("level", F.explode(at)).withColumn("cell", F.pow(F.lit(2.0), F.col("level")))
        for c, lo, hi in (("gx", "a0", "a1"), ("gy", "b0", "b1")):
            low, high = F.floor(F.col(lo) / F.col("cell")), F.floor(F.col(hi) / F.col("cell"))
            if area:
                high = F.greatest(low, F.ceil(F.col(hi) / F.col("cell")) - 1)
            out = out.withColumn(c, F.explode(F.sequence(low, high)))
        home = F.col("own") == F.col("level")
        # Lane 0: natives of the left with all of the right; lane 1: guests of the left with natives of the right. Guests never meet guests.
        lanes = F.when(home, F.lit(0)).otherwise(1) if s == "l" else F.explode(F.when(home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        cols = ["id", *keep, "a0", "b0", "a1", "b1"]
        out = out.select(*by, "level", "cell", "gx", "gy", lanes.alias("lane"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
        used = [(F.col("lane") == n) & F.col("level").isin(*k) for n, k in enumerate(lane_levels) if k]
        return out.where(reduce(Column.__or__, used) if used else F.lit(False))

    def small(s):
        """Whether the side's tiles, up to four at a level and in two lanes, are under the session's limit for broadcasts as rows in memory, whatever bytes its files have."""
        rows = sum(4 * r["count"] * (sum(k >= r["own"] for k in levels) + 1) for r in counted if r["side"] == s)
        return rows * (64 + 8 * (10 + len(by) + len(keep))) <= broadcast_limit(left.sparkSession)

    few = [small(s) for s in "lr"]
    tiles = tiled(a, "l"), tiled(b, "r").drop("cell")
    if few != [True, True]:
        tiles = [F.broadcast(t) if f else t if any(few) else sorted_side(t) for t, f in zip(tiles, few)]
    met = tiles[0].join(tiles[1], [*by, "level", "gx", "gy", "lane"])
    cx, cy = F.greatest("l_a0", "r_a0"), F.greatest("l_b0", "r_b0")
    meet = (F.col("l_a0") <= F.col("r_a1")) & (F.col("r_a0") <= F.col("l_a1")) & (F.col("l_b0") <= F.col("r_b1")) & (F.col("r_b0") <= F.col("l_b1"))
    if area:
        meet = (cx < F.least("l_a1", "r_a1")) & (cy < F.least("l_b1", "r_b1"))
    first = (F.floor(cx / F.col("cell")) == F.col("gx")) & (F.floor(cy / F.col("cell")) == F.col("gy"))
    once = met.where(meet & first)
    if one:
        once = once.where("l_id < r_id")
    return once.select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), *by, *[f"{s}_{c}" for s in "lr" for c in keep])


def with_shapes(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """The pairs with both shapes, lw and rw."""
    right = left if right is None else right
    out = pairs.join(sorted_side(left.select(F.col("feature_index").alias("l"), F.col("shape").alias("lw"))), "l")
    return out.join(sorted_side(right.select(F.col("feature_index").alias("r"), F.col("shape").alias("rw"))), "r")


class Cache:
    """Prepared shapes by their bytes, for the pairs of one task."""

    def __init__(self, most: int = 4096):
        self.most, self.kept = most, {}

    def __call__(self, data: bytes) -> Shape:
        found = self.kept.get(data)
        if found is None:
            if len(self.kept) >= self.most:
                self.kept.clear()
            found = self.kept[data] = Shape(wkb.load(data))
        return found


def similarity_bound(left: str, right: str, weights: tuple[float, float, float], dissolved: str | None = None) -> Column:
    """No pair's weighted similarity is above this, from areas, lengths and envelopes (structs of these names) alone.

    Lengths count what is repeated, overlap does not: lines are bounded only where dissolved names their length without repeats.
    """
    c = lambda s, n: F.col(f"{s}.{n}")
    both = lambda f, n: f(c(left, n), c(right, n))
    w = both(F.least, "x1") - both(F.greatest, "x0")
    h = both(F.least, "y1") - both(F.greatest, "y0")
    total = c(left, "area") + c(right, "area")
    common = F.least(c(left, "area"), c(right, "area"), F.greatest(F.lit(0.0), w * h))
    areas = (c(left, "area") > 0) & (c(right, "area") > 0)
    iou = F.when(areas, F.greatest(common / (total - common), both(F.greatest, "length") / total))
    if dissolved:
        iou = iou.when((c(left, "area") <= 0) & (c(right, "area") <= 0) & (both(F.greatest, dissolved) > 0), both(F.least, dissolved) / both(F.greatest, dissolved))
    iou = iou.otherwise(1.0)
    d = F.hypot(both(F.greatest, "x1") - both(F.least, "x0"), both(F.greatest, "y1") - both(F.least, "y0"))
    far = F.greatest(*[F.abs(c(left, n) - c(right, n)) for n in ("x0", "y0", "x1", "y1")])
    near = F.when(d > 0, F.greatest(F.lit(0.0), 1 - far / d)).otherwise(1.0)
    measure = lambda s: F.when(c(s, "area") > 0, c(s, "area")).otherwise(c(s, "length"))
    envelope = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    fill = lambda s: F.when(envelope(s) > 0, c(s, "area") / envelope(s)).otherwise(1.0)
    top = F.greatest(measure(left), measure(right))
    ratio = F.when(top > 0, F.least(measure(left), measure(right)) / top).otherwise(1.0)
    shape = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio + 1 - F.abs(fill(left) - fill(right))) / 2))
    return weights[0] * F.least(F.lit(1.0), iou) + weights[1] * near + weights[2] * shape


def reaching(both: DataFrame, weights: tuple[float, float, float], least: float, dissolved: str | None = None) -> DataFrame:
    """The rows whose structs lm and rm can reach the similarity.

    The bound is a column that is not deterministic, so that it is not pushed into a filter: projections evaluate common
    parts once, filters do not.
    """
    bound = F.when(F.monotonically_increasing_id() >= 0, similarity_bound("lm", "rm", weights, dissolved))
    return both.withColumn("_bound", bound).where(F.col("_bound") + 1e-9 >= least).drop("_bound")


MEASURED = ("area", "length", "x0", "y0", "x1", "y1")


def likely_pairs(left: DataFrame, right: DataFrame | None, tolerance: float, weights: tuple[float, float, float], least: float) -> DataFrame:
    """The envelope pairs whose similarity can reach ``least``."""
    met = envelope_pairs(left, right, tolerance, MEASURED)
    both = met.select("l", "r", *[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in MEASURED]).alias(s + "m") for s in "lr"])
    return reaching(both, weights, least).select("l", "r")
