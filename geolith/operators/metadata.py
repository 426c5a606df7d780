"""Audits of dataset metadata: coordinate reference systems, datum shifts, axis order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.crs import canonical_crs


def scan_crs(sources: DataFrame) -> DataFrame:
    """The sources (seq, uri, crs, read_error) with status and the baseline, whatever the writing of a CRS.

    The baseline is the first source by (seq, uri) with a readable CRS; a source equals it (consistent), differs
    (mismatch), declares none or a blank one (missing), or could not be read or names no reference system (error).
    baseline and crs are as written, crs null where it is not readable. One row of baseline is broadcast; without any
    valid CRS every readable source is missing.
    """
    blank = F.col("crs").isNull() | (F.trim("crs") == "")
    read = sources.withColumn("_known", F.when(F.col("read_error").isNull(), canonical_crs(F.col("crs"))))
    first = read.where("_known is not null").agg(F.min(F.struct("seq", "uri", "crs", "_known")).alias("b")).select(F.col("b.crs").alias("baseline"), F.col("b._known").alias("_first"))
    status = F.when(F.col("read_error").isNotNull(), "error").when(blank, "missing").when(F.col("_known").isNull(), "error").when(F.col("_known") == F.col("_first"), "consistent").otherwise("mismatch")
    return read.crossJoin(F.broadcast(first)).select("seq", "uri", F.when(F.col("_known").isNotNull(), F.col("crs")).alias("crs"), "baseline", status.alias("status"))  # first: one row


def crs_consistent(scanned: DataFrame) -> DataFrame:
    """One row: datasets, mismatched, is_consistent (there are datasets and all are consistent)."""
    ok = F.count(F.when(F.col("status") == "consistent", 1))
    return scanned.agg(F.count(F.lit(1)).alias("datasets"), F.count(F.when(F.col("status") == "mismatch", 1)).alias("mismatched"), ((F.count(F.lit(1)) > 0) & (ok == F.count(F.lit(1)))).alias("is_consistent"))


def datum_grid(areas: DataFrame, grid_size: int = 3) -> DataFrame:
    """grid_size * grid_size sample points of each area (audit_id, west, south, east, north), by longitude then latitude, numbered from 0."""
    if isinstance(grid_size, bool) or not isinstance(grid_size, int) or not 2 <= grid_size <= 25:
        raise ValueError("grid_size must be an integer within 2 and 25")
    n = grid_size - 1
    steps = F.sequence(F.lit(0), F.lit(n))
    return (
        areas.withColumn("i", F.explode(steps))
        .withColumn("j", F.explode(steps))
        .select("audit_id", (F.col("i") * grid_size + F.col("j")).alias("sample_id"), (F.col("west") + F.col("i") * (F.col("east") - F.col("west")) / n).alias("longitude"), (F.col("south") + F.col("j") * (F.col("north") - F.col("south")) / n).alias("latitude"))
    )


def datum_shifts(samples: DataFrame, threshold_m: float = 5.0) -> DataFrame:
    """One row for each audit_id of (audit_id, displacement_m): samples, maximum and mean shift, abnormal samples, status.

    abnormal if the maximum is above the threshold, normal if not, indeterminate without any displacement.
    """
    if not (math.isfinite(threshold_m) and threshold_m > 0):
        raise ValueError("threshold_m must be finite and positive")
    d = F.col("displacement_m")
    out = samples.groupBy("audit_id").agg(F.count(d).alias("samples"), F.max(d).alias("maximum_shift_m"), F.avg(d).alias("mean_shift_m"), F.count(F.when(d > threshold_m, 1)).alias("abnormal_samples"))
    return out.withColumn("status", F.when(F.col("maximum_shift_m").isNull(), "indeterminate").when(F.col("maximum_shift_m") > threshold_m, "abnormal").otherwise("normal"))


def transformation_quality(evidence: DataFrame, threshold_m: float = 5.0) -> DataFrame:
    """quality (reliable or warning) and the warnings' codes of (audit_id, best_available, ballpark, missing_grids, accuracy_m)."""
    codes = F.array(
        F.when(~F.col("best_available"), "best_operation_missing"), F.when(F.col("ballpark"), "ballpark"), F.when(F.size("missing_grids") > 0, "grids_missing"),
        F.when(F.col("accuracy_m").isNull(), "accuracy_unknown").when(F.col("accuracy_m") > threshold_m, "accuracy_poor"),
    )
    out = evidence.withColumn("warnings", F.filter(codes, lambda c: c.isNotNull()))
    return out.select("audit_id", F.when(F.size("warnings") > 0, "warning").otherwise("reliable").alias("quality"), "warnings", F.array_distinct("missing_grids").alias("missing_grids"))


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, a: float = 6378137.0, f: float = 1 / 298.257223563, rounds: int = 12) -> Column:
    """Length in metres of the geodesic between two points on an ellipsoid by Vincenty's inverse series; null for points it does not converge at (nearly antipodal).

    Built of column expressions, so it stays in the JVM.
    """
    b = a * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    big = F.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)

    def parts(lam, s1, c1, s2, c2):
        ss = F.sqrt((c2 * F.sin(lam)) * (c2 * F.sin(lam)) + (c1 * s2 - s1 * c2 * F.cos(lam)) * (c1 * s2 - s1 * c2 * F.cos(lam)))
        cs = s1 * s2 + c1 * c2 * F.cos(lam)
        return ss, cs

    start = F.struct(big.alias("lam"), big.alias("big"), su1.alias("s1"), cu1.alias("c1"), su2.alias("s2"), cu2.alias("c2"), F.lit(1.0).alias("moved"))

    def step(v, _):
        ss, cs = parts(v["lam"], v["s1"], v["c1"], v["s2"], v["c2"])
        sigma = F.atan2(ss, cs)
        sa = F.when(ss == 0, 0.0).otherwise(v["c1"] * v["c2"] * F.sin(v["lam"]) / ss)
        ca2 = 1 - sa * sa
        cm = F.when(ca2 == 0, 0.0).otherwise(cs - 2 * v["s1"] * v["s2"] / ca2)
        c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        lam = v["big"] + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))
        return F.struct(lam.alias("lam"), v["big"].alias("big"), v["s1"].alias("s1"), v["c1"].alias("c1"), v["s2"].alias("s2"), v["c2"].alias("c2"), F.abs(lam - v["lam"]).alias("moved"))

    def finish(v):
        ss, cs = parts(v["lam"], v["s1"], v["c1"], v["s2"], v["c2"])
        sigma = F.atan2(ss, cs)
        sa = F.when(ss == 0, 0.0).otherwise(v["c1"] * v["c2"] * F.sin(v["lam"]) / ss)
        ca2 = 1 - sa * sa
        cm = F.when(ca2 == 0, 0.0).otherwise(cs - 2 * v["s1"] * v["s2"] / ca2)
        u = ca2 * (a * a - b * b) / (b * b)
        ka = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        kb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = kb * ss * (cm + kb / 4 * (cs * (-1 + 2 * cm * cm) - kb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
        return F.when(v["moved"] < 1e-10, b * ka * (sigma - ds))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish)


def _world(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    inside = (x0 >= -180) & (x1 <= 180) & (y0 >= -90) & (y1 <= 90) & (x0 < x1) & (y0 < y1)
    return F.coalesce(inside, F.lit(False))


def axis_order(bounds: DataFrame) -> DataFrame:
    """The rows of (dataset_id, min_x, min_y, max_x, max_y and, may be null, expected_west, _south, _east, _north) with status.

    correct, likely_swapped, ambiguous or invalid: by whether the bounds as declared and with exchanged axes are on the
    globe or, where an expected area is given, share positive area with it. Bounds that are not finite, or without
    width or height, are invalid on the globe's terms and so is their status.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    names = ("expected_west", "expected_south", "expected_east", "expected_north")
    have = [F.col(c) if c in bounds.columns else F.lit(None).cast("double") for c in names]
    declared, swapped = _world(x0, y0, x1, y1), _world(y0, x0, y1, x1)

    def overlap(a0, b0, a1, b1):
        w, s, e, n = have
        return F.coalesce((F.greatest(a0, w) < F.least(a1, e)) & (F.greatest(b0, s) < F.least(b1, n)), F.lit(False))

    known = have[0].isNotNull() & have[1].isNotNull() & have[2].isNotNull() & have[3].isNotNull()
    a = F.when(known, declared & overlap(x0, y0, x1, y1)).otherwise(declared)
    b = F.when(known, swapped & overlap(y0, x0, y1, x1)).otherwise(swapped)
    status = F.when(a & ~b, "correct").when(b & ~a, "likely_swapped").when(a & b, "ambiguous").otherwise("invalid")
    return bounds.withColumns({"declared_valid": declared, "swapped_valid": swapped, "status": status})


def extent(features: DataFrame, by: str | None = None) -> DataFrame:
    """Bounds of prepared shapes: min_x, min_y, max_x, max_y; null without any envelope."""
    sums = [F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y")]
    return features.groupBy(by).agg(*sums) if by else features.agg(*sums)
