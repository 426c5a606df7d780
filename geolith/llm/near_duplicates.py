"""Near-duplicate geometries by a multi-index Hamming join.

Every geometry gets a bit signature of its position and size: the cell of its envelope's centre, as a unary code
on each axis, and the order of magnitude of its measure, as a cyclic unary code.  Neighbouring values differ in
one bit, so the Hamming distance of two signatures is the number of steps between them.  A pair that reaches the
similarity cannot be further apart than MOST_ERRORS bits: meeting envelopes bound how far the centres are apart
(one cell on each axis), the overlap term bounds the ratio of the measures (one step).  The signature is
split into CHUNKS chunks; by pigeonhole a pair within the bound has a chunk with at most
MOST_ERRORS // CHUNKS wrong bits, so one side looks up its chunks as they are and the other with these errors
enumerated.  Cells are relative to the geometry's size: its home level has cells wider than its envelope's diagonal,
so the centres of envelopes that meet are at most one cell apart at the home level of the larger one.  A pair meets
there: each geometry is also a guest one level above its home, and further above at every level that is the home
of some geometry whose measure could suit it.  Guests never meet guests.

Geometries that are written differently but have the same vertices form one class; only one of a class is joined,
and members are put back at the end.  Exact scores follow the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.geometry import wkb, wkt
from geolith.geometry.batch import Flat, as_wkb, dissolved_lengths, of_pairs, read_plain, settled_lines, settled_rings, similarities_of
from geolith.operators.tiles import reaching
from geolith.storage import Scratch

WEIGHTS = (0.45, 0.35, 0.20)
CHUNKS = 2
MOST_ERRORS = 3
TILE_BITS = 2
MEASURE_BITS = 8
ROUNDING = 1e-12
SLACK = 1e-9

FEATURE = "feature_index bigint, shape binary, area double, length double, dissolved double, x0 double, y0 double, x1 double, y1 double"
PLACE = "home int, alike int, far int"
FEATURE_NAMES = [c.split()[0] for c in FEATURE.split(", ")]


def _line(path):
    a = np.asarray(path, dtype=float)[:, :2] + 0.0
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]).any(1)
    a = a[keep] if keep.sum() > 1 else a[:1].repeat(2, 0)
    return a if tuple(a.ravel()) <= tuple(a[::-1].ravel()) else a[::-1]


def _settled(geometries) -> Iterator[np.ndarray]:
    """The settled rings of all geometries, one after the other."""
    rings = [np.asarray(r, dtype=float)[:, :2] for g in geometries for p in g.polygons for r in p]
    if not rings:
        return iter(())
    xy, n = settled_rings(np.vstack(rings), np.array([len(r) for r in rings]))
    return iter(np.split(xy, np.cumsum(n)[:-1]))


def one_writing(g: wkt.Geom, rings: Iterator[np.ndarray] | None = None) -> wkt.Geom:
    """The geometry with ring starts, directions, repeated vertices and the order of parts settled; vertices stay. rings: its settled rings come next."""
    rings = _settled([g]) if rings is None else rings
    polygons = []
    for p in g.polygons:
        shell, holes = next(rings), [next(rings)[::-1] for _ in p[1:]]
        polygons.append([shell, *sorted(holes, key=lambda r: r.tobytes())])
    polygons.sort(key=lambda p: b"".join(r.tobytes() for r in p))
    lines = sorted((_line(x) for x in g.lines), key=lambda x: x.tobytes())
    points = sorted({(float(p[0]) + 0.0, float(p[1]) + 0.0) for p in g.points})
    kinds = [("MULTIPOINT", points), ("MULTILINESTRING", lines), ("MULTIPOLYGON", polygons)]
    if not points and len(lines) + len(polygons) == 1:
        return wkt.Geom("POLYGON" if polygons else "LINESTRING", lines=lines, polygons=polygons)
    parts = [wkt.Geom(k, **{f: v}) for (k, v), f in zip(kinds, ("points", "lines", "polygons")) if v]
    return parts[0] if len(parts) == 1 else wkt.collect(parts)


def _rows(index, shapes: list[bytes], flat: Flat) -> pd.DataFrame:
    """FEATURE rows of settled shapes."""
    once, bare = flat.length.copy(), np.flatnonzero((flat.area <= 0) & (flat.segments_n > 0))
    once[bare] = dissolved_lengths(flat, bare)
    return pd.DataFrame(dict(zip(FEATURE_NAMES, (index, shapes, flat.area, flat.length, once, *flat.bounds.T))))


def _described(index, texts) -> pd.DataFrame:
    """FEATURE rows of geometries that are not plain."""
    kept, geometries = [], []
    for i, text in zip(index, texts):
        try:
            g = wkt.parse(text)
        except wkt.BadGeometry:
            continue
        if not g.empty and all(math.isfinite(v) for c in g.coords() for v in c[:2]):
            kept.append(i)
            geometries.append(g)
    rings = _settled(geometries)
    shapes = [wkb.dump(one_writing(g, rings)) for g in geometries]
    return _rows(np.array(kept, dtype=np.int64), shapes, Flat.load(shapes))


def describe(batches):
    """feature_index, geometry_wkt -> FEATURE rows; null, empty and unreadable geometries and coordinates that are not finite are left out.

    Plain polygons and lines are settled and measured all at once; a part of another kind has the writing its whole has.
    """
    for batch in batches:
        index, texts = batch["feature_index"].to_numpy(), batch["geometry_wkt"].tolist()
        at, polygon, n, xy = read_plain(texts)
        if len(at):
            paths = []
            for is_polygon, settle in ((True, settled_rings), (False, settled_lines)):
                some = polygon == is_polygon
                if some.any():
                    path, counts = settle(xy[np.repeat(some, n)], n[some])
                    flat = Flat(path, counts, np.full(len(counts), int(is_polygon)), np.arange(len(counts)), len(counts))
                    paths.append(_rows(index[at[some]], as_wkb(path, counts, polygon[some]), flat))
            yield pd.concat(paths)
        if len(at) < len(texts):
            rest = np.ones(len(texts), dtype=bool)
            rest[at] = False
            yield _described(index[rest], batch["geometry_wkt"][rest])


def score(batches, least: float):
    """l, r, lw, rw -> the pairs that reach the similarity."""
    for batch in batches:
        flat, l, r = of_pairs(batch["l"], batch["r"], batch["lw"], batch["rw"], True)
        value = similarities_of(flat, l, r, WEIGHTS, least) @ np.array(WEIGHTS)
        yield batch.loc[value + ROUNDING >= least, ["l", "r"]]


def _codes(errors: bool) -> Column:
    """(chunk, step) for each key of a geometry: the chunk as it is, and with one wrong bit where errors. A step moves one of the three fields of a packed chunk."""
    steps = [0, *((1, -1, 16, -16, 256, -256) if errors else ())]
    return F.array(*[F.struct(F.lit(chunk).alias("chunk"), F.lit(step).alias("step")) for chunk in range(CHUNKS) for step in steps])


def _chunk(x: Column, y: Column, m: Column, chunk: int) -> Column:
    """One chunk, packed: alternate bits of the three codes, as the counts of ones that unary codes are. The cyclic code is on top, so that it wraps round."""
    half = lambda v: F.shiftright(v + (1 - chunk), 1)
    return half(m) * 256 + (half(x) + 1) * 16 + half(y) + 1


@dataclass(frozen=True)
class Bounds:
    """What a least similarity implies."""

    least: float

    @property
    def overlap(self) -> float:
        """Least intersection over union."""
        return (self.least - WEIGHTS[1] - WEIGHTS[2]) / WEIGHTS[0]

    @property
    def apart(self) -> float:
        """Least ratio of measures of a pair of which one diagonal is more than twice the other: the Hausdorff distance is then at least
        1 / (4 sqrt 2) of the common diagonal, and the shape term bounds the measures of all kinds."""
        return 2 * (self.least - WEIGHTS[0] - WEIGHTS[1] * (1 - 1 / math.sqrt(32))) / WEIGHTS[2] - 1

    def check(self) -> None:
        if self.overlap <= 0 or 1 - (1 - self.least) / WEIGHTS[1] <= 0:
            raise ValueError("below this similarity neither overlap nor distance is bounded")

    def places(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The frame with PLACE: the level whose cells are wider than the envelope's diagonal (null for a point), and the steps of measure for pairs of one kind and for far ones."""
        d = np.hypot(frame["x1"] - frame["x0"], frame["y1"] - frame["y0"]).to_numpy(dtype=float)
        area, length, dissolved = (frame[c].to_numpy(dtype=float) for c in ("area", "length", "dissolved"))

        def steps(measure, ratio):
            with np.errstate(divide="ignore"):
                return np.where(measure > 0, np.floor(np.log(np.where(measure > 0, measure, 1)) / (max(math.log(1 / ratio), 1e-6) * (1 + SLACK))), 0).astype("int32")

        home = pd.array(np.floor(np.log2(np.where(d > 0, d, 1))).astype("int32") + 1, dtype="Int32")
        home[d == 0] = pd.NA
        return frame.assign(home=home, alike=steps(np.where(area > 0, area, dissolved), self.overlap), far=steps(np.where(area > 0, area, length), self.apart) if self.apart > 0 else np.int32(0))


def signature(x: Column, y: Column, m: Column) -> Column:
    """The bits: unary codes of x and y (0 to 6), cyclic unary code of m (0 to 2 * MEASURE_BITS - 1)."""
    unary = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v.cast("int")) - 1
    full = (1 << MEASURE_BITS) - 1
    cyclic = F.when(m <= MEASURE_BITS, unary(m)).otherwise(F.lit(full).cast("bigint") - unary(m - MEASURE_BITS))
    return unary(x) + unary(y) * (1 << 8) + cyclic * (1 << 16)


NATIVE, BESIDE, ABOVE, UPWARD = 1, 2, 4, 8


def candidate_pairs(shapes: DataFrame, scratch: Scratch, bounds: Bounds) -> DataFrame:
    """Distinct (l, r), l < r, within MOST_ERRORS bits of one another. shapes: feature_index, area, length, envelope and PLACE, one row for each class."""
    overlap = bounds.overlap
    sized = shapes.where("home is not null")
    # Overlap is bounded by measures of one kind only: areas with areas, lengths with lengths. Polygons that only touch overlap by
    # a part of either boundary against both areas, so each has less area than its own boundary allows. A line in a polygon
    # overlaps by its length against the area: the polygon has less area than the longest line it can meet allows, that of the
    # levels beside its own, or for pairs of unlike diagonals that of all.
    lines = sized.where("area <= 0").groupBy("home").agg(F.max("length").alias("length"))
    lines = scratch.save(lines)  # one row for each binary order of magnitude
    beside_longest = lines.select(F.explode(F.array(*[F.col("home") + k for k in (-1, 0, 1)])).alias("home"), "length").groupBy("home").agg(F.max("length").alias("longest_near"))
    longest = lines.agg(F.coalesce(F.max("length"), F.lit(0.0)).alias("longest"))
    is_area, is_line = F.col("area") > 0, (F.col("area") <= 0) & (F.col("length") > 0)
    thin = is_area & (F.col("area") <= F.col("length") / overlap)
    crossed = is_area & F.coalesce(F.col("area") <= F.col("longest_near") / overlap, F.lit(False))
    crossed_far = is_area & (F.col("area") <= F.col("longest") / overlap)
    # Kinds: points 0, lines 1, areas 2, touching areas 3, lines in areas 4 and 5 by who is the guest; 10 more for the far ones of
    # these. A feature has a row for each kind it takes part in, with its roles: native of its home level, guest there, one level
    # above, and further upward.
    kinds = [
        (~is_area & ~is_line, 0, NATIVE + BESIDE), (is_line, 1, NATIVE + BESIDE + ABOVE + UPWARD), (is_area, 2, NATIVE + BESIDE + ABOVE + UPWARD), (thin, 3, NATIVE + BESIDE + ABOVE), (thin, 13, NATIVE + UPWARD),
        (is_line, 4, NATIVE), (crossed, 4, BESIDE + ABOVE), (is_line, 14, NATIVE), (crossed_far, 14, UPWARD), (crossed, 5, NATIVE), (is_line, 5, ABOVE), (crossed_far, 15, NATIVE), (is_line, 15, UPWARD),
    ]
    taking = F.array(*[F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(roles).alias("roles"))) for condition, kind, roles in kinds])
    placed = sized.crossJoin(F.broadcast(longest)).join(F.broadcast(beside_longest), "home", "left")
    placed = placed.select("feature_index", "home", "alike", "far", (F.col("x0") + F.col("x1")).alias("sx"), (F.col("y0") + F.col("y1")).alias("sy"), F.explode(taking).alias("k")).where("k is not null")
    step = F.when(F.col("k.kind").isin(1, 2), F.col("alike")).when(F.col("k.kind") > 10, F.col("far")).otherwise(0)
    # Written, as generated code that placed features and made keys in one method would be too long to be compiled.
    placed = scratch.save(placed.select("feature_index", "home", "sx", "sy", "k.kind", "k.roles", step.alias("step")))
    has = lambda role: F.col("roles").bitwiseAND(role) != 0
    natives = placed.where(has(NATIVE))
    # At most one row for each kind and order of magnitude of measure and size.
    around_step = F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step")
    homes = natives.where("kind in (1, 2) or kind > 10").select("kind", "step", "home").distinct().select("kind", around_step, "home").groupBy("kind", "step").agg(F.collect_set("home").alias("levels"))
    upward = placed.where(has(UPWARD)).join(F.broadcast(homes), ["kind", "step"])
    upward = scratch.save(upward.withColumn("level", F.explode(F.filter("levels", lambda v: v > F.col("home") + 1))).select("feature_index", "kind", "step", "sx", "sy", "level"))
    # Of the far kinds only those natives look whose level and measure have guests: as bounded as homes.
    expected = upward.where("kind > 10").select("kind", F.col("level").alias("home"), "step").distinct().select("kind", "home", around_step).distinct()
    natives = natives.where("kind < 10").unionByName(natives.where("kind > 10").join(F.broadcast(expected), ["kind", "home", "step"], "left_semi").select(*natives.columns))
    side = 1 << TILE_BITS

    def celled(df, *further):
        out = df.withColumn("cell", 2 * F.pow(F.lit(2.0), F.col("level")))
        return out.select("feature_index", "kind", F.pmod("step", F.lit(2 * MEASURE_BITS)).alias("m"), "level", F.floor(F.col("sx") / F.col("cell")).alias("cx"), F.floor(F.col("sy") / F.col("cell")).alias("cy"), *further)

    def rows(tx, ty, role, source):
        x, y = (F.col("cx") - tx * side + 1).cast("int"), (F.col("cy") - ty * side + 1).cast("int")
        further = ["any_order"] if role == "kept" else []
        out = source.select(F.col("feature_index").alias(role), "m", *further, x.alias("x"), y.alias("y"), F.xxhash64("kind", "level", tx, ty).alias("at"))
        codes = [F.col(c) for c in ("x", "y", "m")]
        out = out.select(role, signature(*codes).alias(role + "_bits"), *further, "at", *[_chunk(*codes, k).alias(f"c{k}") for k in range(CHUNKS)], F.explode(_codes(role == "probe")).alias("e"))
        own = F.when(F.col("e.chunk") == 0, F.col("c0")).otherwise(F.col("c1"))
        wrapped = (own + F.col("e.step")).bitwiseAND(256 * MEASURE_BITS - 1) + F.col("e.chunk") * (512 * MEASURE_BITS)
        return out.select(role, role + "_bits", *further, F.col("at").bitwiseXOR(wrapped.cast("bigint")).alias("key"))

    tile = lambda c, k=0: F.floor((F.col(c) + k) / side)
    probe = rows(tile("cx"), tile("cy"), "probe", celled(natives.withColumnRenamed("home", "level")))
    as_guest = lambda level, guest: F.struct(level.alias("level"), F.lit(guest).alias("guest"))
    near = placed.where(has(BESIDE + ABOVE)).withColumn("g", F.explode(F.array(F.when(has(BESIDE), as_guest(F.col("home"), False)), F.when(has(ABOVE), as_guest(F.col("home") + 1, True))))).where("g is not null")
    takers = near.select("feature_index", "kind", "step", "sx", "sy", "g.level", "g.guest").unionByName(upward.withColumn("guest", F.lit(True)))
    takers = celled(takers, (F.col("guest") | (F.col("kind") == 4)).alias("any_order"))
    for c, u in (("cx", "ux"), ("cy", "uy")):  # the tiles within one cell: one or two
        takers = takers.withColumn(u, F.explode(F.array(tile(c, -1), F.when(tile(c, 1) != tile(c, -1), tile(c, 1))))).where(F.col(u).isNotNull())
    kept = rows(F.col("ux"), F.col("uy"), "kept", takers)
    met = probe.join(kept, "key").where((F.col("any_order") | (F.col("probe") < F.col("kept"))) & (F.bit_count(F.col("probe_bits").bitwiseXOR(F.col("kept_bits"))) <= MOST_ERRORS))
    return met.select(F.least("probe", "kept").alias("l"), F.greatest("probe", "kept").alias("r")).where("l < r").distinct()


def near_duplicate_classes(features: DataFrame, scratch: Scratch, least: float = 0.85, index: str = "feature_index", geometry: str = "geometry_wkt", newest: str | None = "edited_at") -> tuple[DataFrame, DataFrame]:
    """The result of near_duplicate_features without copies multiplied out: links and members.

    links: (left_class, right_class), one row for two classes whose geometries reach the similarity. members: (class,
    feature_index, n), one row for each feature with a geometry; a class is named by its least feature and has n equal
    geometries, all linked to one another. Rows grow with the features, however many copies there are of one.
    """
    rows = features.where(features[index].isNotNull() & features[geometry].isNotNull())
    order = [features[newest]] if newest else []
    rows = rows.groupBy(rows[index].cast("bigint").alias("feature_index")).agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], features[geometry].alias("g"))).alias("v"))
    bounds = Bounds(least)
    bounds.check()
    described = rows.select("feature_index", F.col("v.g").alias("geometry_wkt")).mapInPandas(lambda batches: map(bounds.places, describe(batches)), f"{FEATURE}, {PLACE}")
    shapes = scratch.save(described.withColumn("class", F.unhex(F.sha2("shape", 256))))
    classes = shapes.groupBy("class").agg(F.min("feature_index").alias("first"), F.count(F.lit(1)).alias("n"))
    classed = scratch.save(shapes.join(classes, "class").drop("class"))
    scratch.drop(shapes)
    members = classed.select("first", "feature_index", "n")
    one = classed.where("first = feature_index").drop("first", "n")
    narrow = one.drop("shape")
    met = candidate_pairs(narrow, scratch, bounds)
    measured = F.struct("area", "length", "dissolved", "x0", "y0", "x1", "y1")
    a, b = (narrow.select(F.col("feature_index").alias(s), measured.alias(s + "m")) for s in "lr")
    envelopes_meet = F.expr("lm.x0 <= rm.x1 and rm.x0 <= lm.x1 and lm.y0 <= rm.y1 and rm.y0 <= lm.y1")
    likely = scratch.save(reaching(met.join(a, "l").join(b, "r").where(envelopes_meet), WEIGHTS, least, "dissolved").select("l", "r"))
    texts = [one.select(F.col("feature_index").alias(s), F.col("shape").alias(s + "w")) for s in "lr"]
    pairs = likely.join(texts[0], "l").join(texts[1], "r").select("l", "r", "lw", "rw")
    alike = pairs.mapInPandas(lambda batches: score(batches, least), "l bigint, r bigint")
    return alike.select(F.col("l").alias("left_class"), F.col("r").alias("right_class")), members.select(F.col("first").alias("class"), "feature_index", "n")


def near_duplicate_features(features: DataFrame, scratch: Scratch, least: float = 0.85, index: str = "feature_index", geometry: str = "geometry_wkt", newest: str | None = "edited_at") -> DataFrame:
    """(left_index, right_index), left < right, of different features whose similarity reaches ``least``.

    Similarity is 0.45 overlap + 0.35 Hausdorff + 0.20 shape similarity, for geometries whose envelopes meet.  A
    feature is its index: of several rows the newest geometry counts, ties by the greatest text.  Features with
    null index, null, empty or unreadable geometry have no pairs.  Equal geometries are all pairs of one another,
    as the result demands: n copies have n (n - 1) / 2 rows, near_duplicate_classes has n.  An empty table gives no rows; other columns are not read.
    """
    links, members = near_duplicate_classes(features, scratch, least, index, geometry, newest)
    several = members.where("n > 1")
    left, right = (members.select(F.col("class").alias(s + "_class"), F.col("feature_index").alias(s[0] + "i")) for s in ("left", "right"))
    across = links.join(left, "left_class").join(right, "right_class").select("li", "ri")
    within = several.select("class", F.col("feature_index").alias("li")).join(several.select("class", F.col("feature_index").alias("ri")), "class").where("li < ri").select("li", "ri")
    return across.unionByName(within).select(F.least("li", "ri").alias("left_index"), F.greatest("li", "ri").alias("right_index"))
