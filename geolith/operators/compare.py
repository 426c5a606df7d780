"""Comparison of two versions of a dataset by geometry."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.geometry import overlay, wkb, wkt
from geolith.geometry.batch import of_pairs, similarities_of
from geolith.geometry.boxes import bounds_of, boxes_of, read_boxes
from geolith.geometry.cells import union_areas
from geolith.geometry.exact import topologically_equal
from geolith.operators.tiles import _prepare, likely_pairs, prepared, require, runs, saved, sorted_side, spread, with_shapes
from geolith.storage import Scratch


THIRDS = (1 / 3, 1 / 3, 1 / 3)


def _score(least: float):
    def run(batches):
        for batch in batches:
            flat, l, r = of_pairs(batch["l"], batch["r"], batch["lw"], batch["rw"], False)
            value = similarities_of(flat, l, r, THIRDS, least).sum(1) / 3
            kept, value = batch[value >= least], value[value >= least]
            equal = [lw == rw or (v > 1 - 1e-6 and topologically_equal(wkt.dump(wkb.load(lw)), wkt.dump(wkb.load(rw)))) for lw, rw, v in zip(kept["lw"], kept["rw"], value)]
            yield pd.DataFrame({"l": kept["l"].to_numpy(), "r": kept["r"].to_numpy(), "score": value, "equal": np.array(equal, dtype=bool)})

    return run


def match_once(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """The greedy one-to-one matching of (l, r, score): best score first, ties by the higher left, then the higher right index.

    A pair that comes first for both of its ends is certain; these are taken in rounds until no pair is left.
    """
    scratch = Scratch(spark, "matching")
    rest, taken = scratch.save(pairs), []
    order = F.struct("score", "l", "r")
    while not rest.isEmpty():
        tops = [rest.groupBy(s).agg(F.max(order).alias("m")).select("m.l", "m.r") for s in "lr"]
        sure = scratch.save(rest.join(sorted_side(tops[0]), ["l", "r"], "left_semi").join(sorted_side(tops[1]), ["l", "r"], "left_semi"))
        taken.append(sure)
        rest = scratch.save(rest.join(sorted_side(sure.select("l")), "l", "left_anti").join(sorted_side(sure.select("r")), "r", "left_anti"))
    out = rest
    for t in taken:
        out = out.unionByName(t)
    return out


def compare_features(spark: SparkSession, left: DataFrame, right: DataFrame, match_threshold: float = 0.5, geometry: str = "geometry", attributes: str | None = "attributes") -> DataFrame:
    """kind (added, removed, modified, unchanged), left_index, right_index, geometry_similarity_percent, changed_attributes.

    Features are matched one to one by the mean of three similarities. A match is unchanged if the two are the same
    point set and no attribute differs (a map of texts; absent equals null). Features without match are removed
    (left) or added (right), with similarity 0. Missing or empty geometries raise ValueError.
    """
    if not 0 <= match_threshold <= 1:
        raise ValueError("match_threshold must be within 0 and 1")
    a, b = (saved(prepared(spread(df, "feature_index"), geometry=geometry)) for df in (left, right))
    require(a)
    require(b)
    scored = with_shapes(likely_pairs(a, b, 0.0, THIRDS, match_threshold), a, b).mapInPandas(_score(match_threshold), "l bigint, r bigint, score double, equal boolean")
    matched = match_once(spark, scored)
    if attributes:
        empty = F.create_map().cast("map<string,string>")
        for s, df in (("l", left), ("r", right)):
            matched = matched.join(sorted_side(df.select(F.col("feature_index").alias(s), F.coalesce(F.col(attributes), empty).alias(s + "m"))), s)
        keys = F.array_union(F.map_keys("lm"), F.map_keys("rm"))
        changed = F.array_sort(F.filter(keys, lambda k: ~F.element_at("lm", k).eqNullSafe(F.element_at("rm", k))))
    else:
        changed = F.array().cast("array<string>")
    none = F.lit(None).cast("bigint")
    rows = matched.withColumn("changed", changed).select(
        F.when(F.col("equal") & (F.size("changed") == 0), "unchanged").otherwise("modified").alias("kind"), F.col("l").alias("left_index"), F.col("r").alias("right_index"),
        F.round(F.col("score") * 100, 4).alias("geometry_similarity_percent"), F.col("changed").alias("changed_attributes"),
    )
    rest = [F.lit(0.0).alias("geometry_similarity_percent"), F.array().cast("array<string>").alias("changed_attributes")]
    gone = a.select(F.col("feature_index").alias("l")).join(sorted_side(matched.select("l")), "l", "left_anti").select(F.lit("removed").alias("kind"), F.col("l").alias("left_index"), none.alias("right_index"), *rest)
    come = b.select(F.col("feature_index").alias("r")).join(sorted_side(matched.select("r")), "r", "left_anti").select(F.lit("added").alias("kind"), none.alias("left_index"), F.col("r").alias("right_index"), *rest)
    return rows.unionByName(gone).unionByName(come)


def compare_schemas(left: Mapping[str, str], right: Mapping[str, str]) -> dict[str, list[str]]:
    """Names added, removed and changed in type between two schemas (name to type), sorted."""
    return {
        "schema_added": sorted(set(right) - set(left)),
        "schema_removed": sorted(set(left) - set(right)),
        "schema_changed": sorted(k for k in set(left) & set(right) if left[k] != right[k]),
    }


CROWDED = 64
CROWDED_BOXES = 4096
MOST_SPLITS = 8
PARTS = "side int, x0 double, y0 double, x1 double, y1 double, box boolean, shape binary"
PARTS_SCHEMA = pa.schema([("side", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("box", pa.bool_()), ("shape", pa.binary())])


def _polygons(side: int):
    """The polygons of a side with their envelopes. Plain boxes have no shape, being their envelope."""

    def run(batches):
        for batch in batches:
            values = batch.column("geometry")
            text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
            at, corners = read_boxes(values) if text else boxes_of(values.to_pylist())
            if len(at):
                bounds = bounds_of(corners).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, dtype=np.int32)), *map(pa.array, bounds), pa.array(np.ones(len(at), dtype=bool)), pa.nulls(len(at), pa.binary())], schema=PARTS_SCHEMA)
            if len(at) < len(values):
                rest = np.ones(len(values), dtype=bool)
                rest[at] = False
                for found in _prepare([pd.DataFrame({"feature_index": 0, "geometry": values.filter(pa.array(rest)).to_pylist()})]):
                    found = found[found["fault"].isna() & found["kind"].isin(("POLYGON", "MULTIPOLYGON", "GEOMETRYCOLLECTION"))]
                    yield pa.RecordBatch.from_pandas(found.assign(side=side, box=False)[PARTS_SCHEMA.names], schema=PARTS_SCHEMA, preserve_index=False)

    return run


def _tile_area(frame: pd.DataFrame) -> tuple[float, float, float]:
    """Areas of the unions of both sides within one tile, and of their common part."""
    x0, y0, cell = (float(frame[c].iloc[0]) for c in ("tx", "ty", "cell"))
    x0, y0 = x0 * cell, y0 * cell
    ring = lambda a, b, c, d: [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]
    tile = ring(x0, y0, x0 + cell, y0 + cell)
    sides = [[], []]
    for side, data, *bounds in zip(frame["side"], frame["shape"], *(frame[c].tolist() for c in ("x0", "y0", "x1", "y1"))):
        sides[side].append(overlay.intersection(ring(*bounds) if data is None else wkb.load(data).polygons, tile))
    sides = [overlay.union(s) for s in sides]
    return overlay.area_of(sides[0]), overlay.area_of(sides[1]), overlay.area_of(overlay.intersection(*sides)) if all(sides) else 0.0


def _tile_areas(batches):
    """Rows sorted by tile: tiles of boxes alone by the batch, on the cells of their coordinates, all others one by one."""
    for frame, starts in runs(batches, "cell", "tx", "ty"):
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        other = frame["shape"].notna().to_numpy(dtype=bool)
        mixed = np.bincount(group[other], minlength=len(starts) - 1) > 0
        boxed = ~mixed[group]
        cell = frame["cell"].to_numpy()
        low = [frame[c].to_numpy() * cell for c in ("tx", "ty")]
        bounds = np.column_stack([*(np.maximum(frame[c].to_numpy(), v) for c, v in zip(("x0", "y0"), low)), *(np.minimum(frame[c].to_numpy(), v + cell) for c, v in zip(("x1", "y1"), low))])
        rows = [union_areas(group[boxed], bounds[boxed], frame["side"].to_numpy()[boxed])]
        rows += [_tile_area(frame.iloc[starts[g] : starts[g + 1]]) for g in np.flatnonzero(mixed)]
        yield pd.DataFrame(rows, columns=["a", "b", "both"])


def _in_tiles(shapes: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ()) -> DataFrame:
    """feature_index, keep, cell, tx, ty of every tile whose inside a feature's envelope meets. Tiles do not overlap; crowded ones are split in four.

    Features whose envelope holds the whole tile do not crowd it, as splitting would not part them. A tile of boxes alone, by a column box, may have many.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    mean = shapes.agg(F.sqrt(F.avg(side * side)).alias("s")).first()["s"]
    cell = 2.0 ** math.ceil(math.log2(4 * mean)) if mean else 1.0
    carried = list(dict.fromkeys(("feature_index", "x0", "y0", "x1", "y1", *(c for c in ("box",) if c in shapes.columns), *keep)))
    other = ~F.col("box") if "box" in shapes.columns else F.lit(True)

    def over_tiles(df, cell, within=None):
        for c, lo, hi in (("tx", "x0", "x1"), ("ty", "y0", "y1")):
            first = F.floor(F.col(lo) / cell)
            last = F.greatest(first, F.ceil(F.col(hi) / cell) - 1)
            if within:
                first, last = F.greatest(first, F.col("p" + c) * 2), F.least(last, F.col("p" + c) * 2 + 1)
            df = df.withColumn(c, F.explode(F.sequence(first, last)))
        return df.withColumn("cell", F.lit(cell))

    rest, done = over_tiles(shapes.select(carried), cell), []
    for k in range(MOST_SPLITS):
        if k:
            rest = scratch.save(rest)
        whole = (F.col("x0") <= F.col("tx") * cell) & (F.col("y0") <= F.col("ty") * cell) & (F.col("x1") >= (F.col("tx") + 1) * cell) & (F.col("y1") >= (F.col("ty") + 1) * cell)
        counted = rest.groupBy("tx", "ty").agg(F.count(F.when(~whole, 1)).alias("n"), F.count(F.when(other, 1)).alias("others"))
        crowded = scratch.save(counted.where(F.col("n") > F.when(F.col("others") > 0, CROWDED).otherwise(CROWDED_BOXES)).select("tx", "ty"))
        if crowded.isEmpty():
            done.append(rest)
            break
        done.append(rest.join(crowded, ["tx", "ty"], "left_anti"))
        if k == MOST_SPLITS - 1:
            done.append(rest.join(crowded, ["tx", "ty"], "left_semi"))
            break
        cell /= 2
        parents = rest.join(crowded, ["tx", "ty"], "left_semi").select(*carried, F.col("tx").alias("ptx"), F.col("ty").alias("pty"))
        rest = over_tiles(parents, cell, True).drop("ptx", "pty")
    out = [df.select("feature_index", *keep, "cell", "tx", "ty") for df in done]
    return reduce(DataFrame.unionByName, out)


def compare_boundaries(spark: SparkSession, left: DataFrame, right: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row: boundary_iou and boundary_difference_area of the two unions of polygons.

    Unions are made tile by tile, of the parts in the tile, so no task holds a connected layer; the areas add up.
    Two sides without area have an overlap of 1 if both are empty, else 0.
    """
    scratch = Scratch(spark, "boundary")
    sides = [df.select(F.col(geometry).alias("geometry")).mapInArrow(_polygons(s), PARTS) for s, df in ((0, left), (1, right))]
    both = scratch.save(sides[0].unionByName(sides[1]).withColumn("feature_index", F.monotonically_increasing_id()))  # written, so that a feature keeps its number
    tiles = _in_tiles(both.drop("shape"), scratch, ("side", "box", "x0", "y0", "x1", "y1"))
    shapes = both.where("not box").select("feature_index", "shape")
    kept = ["cell", "tx", "ty", "side", "x0", "y0", "x1", "y1", "shape"]
    parts = tiles.where("box").withColumn("shape", F.lit(None).cast("binary")).select(kept)
    if not shapes.isEmpty():
        parts = parts.unionByName(tiles.where("not box").join(sorted_side(shapes), "feature_index").select(kept))
    areas = spread(parts, "cell", "tx", "ty").sortWithinPartitions("cell", "tx", "ty").mapInPandas(_tile_areas, "a double, b double, both double")
    total = areas.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("a", "b", "both")])
    union = F.col("a") + F.col("b") - F.col("both")
    return total.select(F.round(F.when(union > 0, F.col("both") / union).otherwise(1.0), 6).alias("boundary_iou"), F.round(union - F.col("both"), 6).alias("boundary_difference_area"))
