"""Small gaps of a coverage, found tile by tile.

A gap is a hole of the union of all polygons.  Each tile's polygons are united within the tile; what is left of the tile
falls into fragments.  Fragments of neighbouring tiles that share a stretch of the border belong to one gap; a fragment
that is too large, or borders on a tile without polygons, is part of none that is small enough.  Only fragments of small
gaps are ever labelled and brought together, so no task holds more than one crowded tile or one gap.  Tiles of plain
boxes are measured many at once, on the cells of their coordinates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.geometry import overlay, wkb
from geolith.geometry.batch import as_wkb
from geolith.geometry.boxes import bounds_of, boxes_of, polygons_of
from geolith.geometry.cells import CHUNK, Cells, connected_cells
from geolith.geometry.measure import TOUCH, Shape, shared_length
from geolith.geometry.repair import AREA_EPSILON
from geolith.operators.components import connected
from geolith.operators.tiles import Cache, envelope_pairs, runs, sorted_side, spread
from geolith.storage import Scratch

CROWDED = 64
MOST_SPLITS = 8
SIDES = "array<struct<axis:int,line:double,lo:double,hi:double,way:int>>"


def tiles_with_members(shapes: DataFrame, scratch: Scratch, least_cell: float) -> tuple[DataFrame, float]:
    """(feature_index or null, envelope, box, cell, tx, ty of every tile that a feature's envelope meets, its borders included; the side of the largest tiles).

    Crowded tiles are split in four, into tiles that may be empty. Features that cover a whole tile do not crowd it.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    mean = shapes.agg(F.sqrt(F.avg(side * side)).alias("s")).first()["s"]
    base = 2.0 ** math.ceil(math.log2(max(4 * (mean or 1.0), least_cell)))
    cell = base
    carried = ("feature_index", "x0", "y0", "x1", "y1", "box")
    rest = shapes.select(*carried)
    for c, lo, hi in (("tx", "x0", "x1"), ("ty", "y0", "y1")):
        rest = rest.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    out = None
    for k in range(MOST_SPLITS + 1):
        if k:
            rest = scratch.save(rest)
        whole = (F.col("x0") <= F.col("tx") * cell) & (F.col("y0") <= F.col("ty") * cell) & (F.col("x1") >= (F.col("tx") + 1) * cell) & (F.col("y1") >= (F.col("ty") + 1) * cell)
        crowded = scratch.save(rest.groupBy("tx", "ty").agg(F.count(F.when(F.col("feature_index").isNotNull() & ~whole, 1)).alias("n")).where(F.col("n") > CROWDED).select("tx", "ty"))
        last = k == MOST_SPLITS or crowded.isEmpty()
        done = (rest if last else rest.join(crowded, ["tx", "ty"], "left_anti")).select(*carried, F.lit(cell).alias("cell"), "tx", "ty")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        half = cell / 2
        quarters = F.explode(F.array(*[F.struct((F.col("tx") * 2 + i).alias("tx"), (F.col("ty") * 2 + j).alias("ty")) for i in (0, 1) for j in (0, 1)])).alias("q")
        inside = rest.join(crowded, ["tx", "ty"], "left_semi").where("feature_index is not null").select(*carried, quarters)
        inside = inside.where((F.col("x1") >= F.col("q.tx") * half) & (F.col("x0") <= (F.col("q.tx") + 1) * half) & (F.col("y1") >= F.col("q.ty") * half) & (F.col("y0") <= (F.col("q.ty") + 1) * half))
        blank = crowded.select(*[F.lit(None).cast(t).alias(c) for c, t in (("feature_index", "bigint"), ("x0", "double"), ("y0", "double"), ("x1", "double"), ("y1", "double"), ("box", "boolean"))], quarters)
        rest = inside.unionByName(blank).select(*carried, "q.tx", "q.ty")
        cell = half
    return out, base


def _sides(ring, x0: float, y0: float, x1: float, y1: float):
    """Stretches of a counter-clockwise ring on the sides of the tile: axis 0 is upright; way is 1 where the tile lies above or right of the line."""
    for p, q in zip(ring, ring[1:]):
        for axis, lines in ((0, (x0, x1)), (1, (y0, y1))):
            if p[axis] == q[axis] and p[axis] in lines:
                a, b = sorted((p[1 - axis], q[1 - axis]))
                yield {"axis": axis, "line": p[axis], "lo": a, "hi": b, "way": 1 if p[axis] == lines[0] else -1}


MARKED = "feature_index bigint, x0 double, y0 double, x1 double, y1 double, box boolean, shape binary"
FRAGMENTS = f"tile boolean, shape binary, area double, sides {SIDES}"
FRAGMENT_NAMES = ["tile", "shape", "area", "sides"]
CLOSE = 1e-9


def _marked(batches):
    """Polygons, the plain boxes without shape."""
    for batch in batches:
        at, _ = boxes_of(batch["shape"].tolist())
        box = np.zeros(len(batch), dtype=bool)
        box[at] = True
        yield batch.assign(box=box, shape=batch["shape"].where(~box, None))[["feature_index", "x0", "y0", "x1", "y1", "box", "shape"]]


def _ring(x0, y0, x1, y1) -> list[tuple]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def _corners(bounds: np.ndarray) -> np.ndarray:
    return bounds[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]].reshape(-1, 2)


def _tile_fragments(frame: pd.DataFrame) -> list[tuple]:
    """One tile: what its polygons leave of it, and a row without fragment that tells the tile's own sides."""
    cell = float(frame["cell"].iloc[0])
    x0, y0 = float(frame["tx"].iloc[0]) * cell, float(frame["ty"].iloc[0]) * cell
    x1, y1 = x0 + cell, y0 + cell
    square = _ring(x0, y0, x1, y1)
    clipped = []
    for box, data, *b in zip(frame["box"], frame["shape"], frame["x0"].tolist(), frame["y0"].tolist(), frame["x1"].tolist(), frame["y1"].tolist()):
        if box or data is not None:
            polygons = [[_ring(*b)]] if box else wkb.load(data).polygons
            within = b[0] >= x0 and b[1] >= y0 and b[2] <= x1 and b[3] <= y1
            clipped.append(polygons if within else overlay.intersection(polygons, [[square]]))
    covered = overlay.union([c for c in clipped if c])
    left = overlay.difference([[square]], covered) if covered else [[square]]
    rows = [(True, None, 0.0, list(_sides(square, x0, y0, x1, y1)))]
    for polygon in left:
        rows.append((False, wkb.dump(overlay.region([polygon])), overlay.area_of([polygon]), [s for ring in polygon for s in _sides(ring, x0, y0, x1, y1)]))
    return rows


def _near(size: np.ndarray, threshold: float) -> np.ndarray:
    """Which areas are so near a limit that only exact ones may decide."""
    return (np.abs(size - threshold) <= CLOSE * threshold) | (np.abs(size - AREA_EPSILON) <= CLOSE * AREA_EPSILON)


def _box_fragments(group: np.ndarray, bounds: np.ndarray, tiles: np.ndarray, threshold: float) -> tuple[list[tuple], np.ndarray]:
    """Fragments of tiles of boxes, and the tiles to be cut one by one: those with a small fragment of several cells.

    A fragment of one cell is a box with no other corner on its sides. One that is not small needs its sides alone.
    """
    n = len(tiles)
    solid = (bounds[:, :2] < bounds[:, 2:]).all(1)
    group, bounds = group[solid], bounds[solid]
    cells = Cells(np.concatenate((group, np.arange(n))), np.vstack((bounds, tiles)), n)
    at, part = connected_cells(cells, cells.inner() & ~cells.covered(slice(0, len(group))))
    rows = [(True, None, 0.0, list(_sides(_ring(*t), *t))) for t in tiles.tolist()]
    if not len(at):
        return rows, np.zeros(0, dtype=np.int64)
    count, size = np.bincount(part), np.bincount(part, cells.areas()[at])
    first = np.empty(len(count), dtype=np.int64)
    first[part] = at
    owner, edges = cells.group[at], cells.bounds_at(at)
    hard = np.zeros(n, dtype=bool)
    hard[cells.group[first[((count > 1) & (size < threshold)) | _near(size, threshold)]]] = True
    sides: dict[int, list] = {}
    for axis, low, high in ((0, 0, 2), (1, 1, 3)):
        other = 1 - axis
        for k, way in ((low, 1), (high, -1)):
            on = np.flatnonzero(edges[:, k] == tiles[owner, k])
            for f, line, lo, hi in zip(part[on].tolist(), edges[on, k].tolist(), edges[on, other].tolist(), edges[on, other + 2].tolist()):
                sides.setdefault(f, []).append({"axis": axis, "line": line, "lo": lo, "hi": hi, "way": way})
    rows = [r for r, h in zip(rows, hard.tolist()) if not h]
    kept = np.flatnonzero(~hard[cells.group[first]])
    single = count[kept] == 1
    alone = kept[single]
    shapes = as_wkb(_corners(cells.bounds_at(first[alone])), np.full(len(alone), 5), np.ones(len(alone), dtype=bool))
    rows += [(False, w, a, sides.get(f, [])) for w, a, f in zip(shapes, size[alone].tolist(), alone.tolist())]
    rows += [(False, None, a, sides.get(f, [])) for a, f in zip(size[kept[~single]].tolist(), kept[~single].tolist())]
    return rows, np.flatnonzero(hard)


def _fragments(threshold: float):
    def run(batches):
        """Rows sorted by tile. Tiles of boxes alone are cut many at once."""
        for frame, starts in runs(batches, "cell", "tx", "ty"):
            starts = np.array(starts)
            n = len(starts) - 1
            group = np.repeat(np.arange(n), np.diff(starts))
            box = frame["box"].eq(True).to_numpy(dtype=bool)
            frame = frame.assign(box=box)
            other = frame["shape"].notna().to_numpy(dtype=bool)
            single = np.bincount(group[other], minlength=n) > 0
            cell, tx, ty = (frame[c].to_numpy()[starts[:-1]].astype(float) for c in ("cell", "tx", "ty"))
            tiles = np.column_stack((tx * cell, ty * cell, tx * cell + cell, ty * cell + cell))
            bounds = frame[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
            bounds = np.hstack((np.maximum(bounds[:, :2], tiles[group, :2]), np.minimum(bounds[:, 2:], tiles[group, 2:])))
            places = (2 * np.bincount(group[box], minlength=n) + 2) ** 2  # at most
            chunk = np.where(single, -1, (np.cumsum(places) - places) // CHUNK)
            rows = []
            for c in np.unique(chunk[~single]):
                mine = np.flatnonzero(chunk == c)
                some = box & (chunk[group] == c)
                found, hard = _box_fragments(np.searchsorted(mine, group[some]), bounds[some], tiles[mine], threshold)
                rows += found
                single[mine[hard]] = True
            for g in np.flatnonzero(single):
                rows += _tile_fragments(frame.iloc[starts[g] : starts[g + 1]])
            yield pd.DataFrame(rows, columns=FRAGMENT_NAMES)

    return run


def _links(stretches: DataFrame) -> DataFrame:
    """(a, b): fragments on both sides of a part of a border line, either way round; b is null where a lies beside no tile."""
    key = ["axis", "line", "block"]
    gaps, tiles = stretches.where("fragment >= 0"), stretches.where("fragment < 0")
    other = gaps.where("way = -1").select(*key, F.col("fragment").alias("b"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    pairs = gaps.where("way = 1").join(sorted_side(other), key).where("lo < ohi and olo < hi").select(F.col("fragment").alias("a"), "b").distinct()
    beside = tiles.select(*key, (-F.col("way")).alias("way"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    part = F.greatest(F.lit(0.0), F.least("hi", "ohi") - F.greatest("lo", "olo"))
    known = gaps.join(sorted_side(beside), [*key, "way"], "left").groupBy(*key, "way", "fragment", "lo", "hi").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("known"))
    bare = known.where(F.col("known") < (F.col("hi") - F.col("lo")) * (1 - 1e-9)).select(F.col("fragment").alias("a"), F.lit(None).cast("bigint").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(bare)


HOLES = "feature_index bigint, shape binary, area double, x0 double, y0 double, x1 double, y1 double"
HOLE_NAMES = [c.split()[0] for c in HOLES.split(", ")]


def _holes(threshold: float):
    def run(batches):
        """Rows sorted by gap: its outer ring as a polygon. Gaps of one box are taken by the batch."""
        for frame, starts in runs(batches, "component"):
            starts = np.array(starts)
            alone = starts[:-1][np.diff(starts) == 1]
            shapes = frame["shape"].tolist()
            at, corners = boxes_of([shapes[k] for k in alone])
            bounds = bounds_of(corners)
            size = (bounds[:, 2] - bounds[:, 0]) * (bounds[:, 3] - bounds[:, 1])
            sure = ~_near(size, threshold)
            good = sure & (size > AREA_EPSILON) & (size < threshold)
            done = alone[at[sure]]
            rows = alone[at[good]]
            yield pd.DataFrame(dict(zip(HOLE_NAMES, (frame["fragment"].to_numpy()[rows], [shapes[k] for k in rows], size[good], *bounds[good].T))))
            rows = []
            rest = ~np.isin(starts[:-1], done)
            for a, b in zip(starts[:-1][rest].tolist(), starts[1:][rest].tolist()):
                for polygon in overlay.union([wkb.load(w).polygons for w in shapes[a:b]]):
                    shell = [polygon[:1]]
                    size = overlay.area_of(shell)
                    if AREA_EPSILON < size < threshold:
                        s = Shape(overlay.region(shell))
                        rows.append((int(frame["fragment"].iloc[a:b].min()), wkb.dump(overlay.region(shell)), size, *map(float, s.bounds)))
            yield pd.DataFrame(rows, columns=HOLE_NAMES)

    return run


def small_gaps(spark: SparkSession, shapes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The holes of the union of polygons with an area below the threshold: feature_index (a name of the hole), shape, area, envelope.

    shapes: feature_index, shape (WKB) and envelope of polygons. A hole is the region within its ring, islands included.
    """
    return _small_gaps(spark, _marked_shapes(shapes, scratch), threshold, scratch)


def _marked_shapes(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.save(shapes.select("feature_index", "shape", "x0", "y0", "x1", "y1").mapInPandas(_marked, MARKED))


def _small_gaps(spark: SparkSession, marked: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    # A tile without polygons is larger than any small gap, so what borders on one is part of none.
    members, base = tiles_with_members(marked, scratch, math.sqrt(threshold) * (1 + 1e-9))
    others = marked.where("not box").select("feature_index", "shape")
    if others.isEmpty():
        with_shape = members.withColumn("shape", F.lit(None).cast("binary"))
    else:
        with_shape = members.join(sorted_side(others), "feature_index", "left")
    found = spread(with_shape, "cell", "tx", "ty").sortWithinPartitions("cell", "tx", "ty").mapInPandas(_fragments(threshold), FRAGMENTS)
    found = scratch.save(found.withColumn("fragment", F.when(~F.col("tile"), F.monotonically_increasing_id())))
    stretches = found.select(F.coalesce("fragment", F.lit(-1)).alias("fragment"), F.explode("sides").alias("s")).select("fragment", "s.*").withColumn("block", F.floor(F.col("lo") / base))
    ends = _links(stretches)
    small = found.where(F.col("fragment").isNotNull() & (F.col("area") < threshold)).select("fragment", "shape", "area")
    sizes = small.select(F.col("fragment").alias("b"), F.lit(True).alias("small"))
    ends = scratch.save(ends.join(sorted_side(sizes), "b", "left").join(sorted_side(small.select(F.col("fragment").alias("a"))), "a", "left_semi").select("a", "b", F.coalesce("small", F.lit(False)).alias("small")))
    open_ = ends.where("not small").select(F.col("a").alias("fragment")).distinct().withColumn("open", F.lit(True))
    labels = connected(spark, ends.where("small").select(F.col("a").alias("l"), F.col("b").alias("r")), small.select(F.col("fragment").alias("vertex")))
    labelled = scratch.save(small.join(sorted_side(labels.withColumnRenamed("vertex", "fragment")), "fragment").join(sorted_side(open_), "fragment", "left"))
    gaps = labelled.groupBy("component").agg(F.sum("area").alias("total"), F.count("open").alias("opens")).where((F.col("opens") == 0) & (F.col("total") < threshold) & (F.col("total") > AREA_EPSILON)).select("component")
    parts = labelled.join(sorted_side(gaps), "component").select("component", "fragment", "shape")
    return scratch.save(spread(parts, "component").sortWithinPartitions("component", "fragment").mapInPandas(_holes(threshold), HOLES))


def _box_shared() -> Column:
    """box_shared_lengths of the envelopes l_ and r_."""
    c = lambda s, a, k: F.col(f"{s}_{a}{k}")
    parts = []
    for k, m in (("x", "y"), ("y", "x")):
        span = c("l", m, 1) - c("l", m, 0)
        common = F.greatest(F.lit(0.0), F.least(c("l", m, 1), c("r", m, 1)) - F.greatest(c("l", m, 0), c("r", m, 0)))
        for i in (0, 1):
            off = F.least(F.abs(c("l", k, i) - c("r", k, 0)), F.abs(c("l", k, i) - c("r", k, 1)))
            parts.append(F.when(off <= TOUCH * span, common).otherwise(0.0))
    return parts[0] + parts[1] + parts[2] + parts[3]


def _shared(batches):
    shape = Cache()
    for batch in batches:
        length = [shared_length(shape(h).segments, shape(p).segments) for h, p in zip(batch["hole"], batch["polygon"])]
        yield batch.assign(shared=length)[["l", "r", "shared"]]


def _joined_boxes(polygons: np.ndarray, holes: np.ndarray) -> dict[int, bytes]:
    """By row, the union of a box and a box that fills it, both as corners, where it is one ring: it depends on the order of coordinates alone, so one overlay for each order does."""
    v = np.concatenate((polygons, holes), axis=1)
    ranks = (v[:, :, None, :] > v[:, None, :, :]).sum(2)
    orders, which = np.unique(ranks.reshape(len(v), 20), axis=0, return_inverse=True)
    out = {}
    for k, order in enumerate(orders):
        order = order.reshape(10, 2)
        whole = overlay.union([[[list(map(tuple, c.tolist()))]] for c in (order[:5], order[5:])])
        if len(whole) != 1 or len(whole[0]) != 1:
            continue
        ring = np.array(whole[0][0])
        rows = np.flatnonzero(which.ravel() == k)
        pick = [[int(np.flatnonzero(order[:, axis] == c)[0]) for c in ring[:, axis]] for axis in (0, 1)]
        xy = np.stack((v[rows][:, pick[0], 0], v[rows][:, pick[1], 1]), axis=2)
        out.update(zip(rows.tolist(), as_wkb(xy.reshape(-1, 2), np.full(len(rows), len(ring)), np.ones(len(rows), dtype=bool))))
    return out


def _detail(size: float) -> str:
    return f"Filled {size:.6g} of gap."


def _filled(batches):
    """Rows sorted by polygon: each with the gaps it takes. Boxes that take one box are filled by the batch."""
    for frame, starts in runs(batches, "feature_index"):
        starts = np.array(starts)
        polygons, holes, index = frame["polygon"].tolist(), frame["hole"].tolist(), frame["feature_index"].to_numpy()
        alone = starts[:-1][np.diff(starts) == 1]
        (l, a), (r, b) = boxes_of([polygons[k] for k in alone]), boxes_of([holes[k] for k in alone])
        both, i, j = np.intersect1d(l, r, assume_unique=True, return_indices=True)
        done = _joined_boxes(a[i], b[j]) if len(both) else {}
        size = np.abs((b[j, 2, 0] - b[j, 0, 0]) * (b[j, 2, 1] - b[j, 0, 1]))
        at = {int(alone[both[k]]): (w, [_detail(size[k])]) for k, w in done.items()}
        rows = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if s not in at:
                taken = sorted((polygons_of(h) for h in holes[s:e]), key=lambda h: min(map(tuple, h[0][0])))
                at[s] = wkb.dump(overlay.region(overlay.union([polygons_of(polygons[s]), *taken]))), [_detail(overlay.area_of(h)) for h in taken]
            rows.append((index[s], *at[s]))
        yield pd.DataFrame(rows, columns=["feature_index", "filled", "details"])


def fill_gaps(spark: SparkSession, shapes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """feature_index, filled (WKB), details of the polygons that small gaps were filled into: each into the one with the longest common edge, ties to the lowest index, none without common edge."""
    marked = _marked_shapes(shapes, scratch)
    holes = _small_gaps(spark, marked, threshold, scratch)
    box = _marked_shapes(holes, scratch)
    kept = ("x0", "y0", "x1", "y1", "box")
    met = envelope_pairs(box, marked, keep=kept)
    boxed = met.where("l_box and r_box").select("l", "r", _box_shared().alias("shared")).where("shared > 0")
    others = scratch.save(met.where("not (l_box and r_box)").select("l", "r")) if not (marked.where("not box").isEmpty() and box.where("not box").isEmpty()) else None
    hole = sorted_side(holes.select(F.col("feature_index").alias("l"), F.col("shape").alias("hole")))
    polygon = lambda name: sorted_side(shapes.select(F.col("feature_index").alias(name), F.col("shape").alias("polygon")))
    shared = boxed
    if others is not None:
        shared = shared.unionByName(spread(others.join(hole, "l").join(polygon("r"), "r"), "r").mapInPandas(_shared, "l bigint, r bigint, shared double").where("shared > 0"))
    taker = shared.groupBy("l").agg(F.max(F.struct("shared", (-F.col("r")).alias("minus"))).alias("m")).select("l", (-F.col("m.minus")).alias("feature_index"))
    taken = taker.join(hole, "l").join(polygon("feature_index"), "feature_index")
    return spread(taken, "feature_index").sortWithinPartitions("feature_index", "l").mapInPandas(_filled, "feature_index bigint, filled binary, details array<string>")
