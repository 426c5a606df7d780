"""Connected components by minimum labels with shortcutting, for the coverage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.storage import Scratch


def connected(spark: SparkSession, pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, component): the least vertex each is linked to. pairs: l, r; vertices: vertex.

    Alternates large-star and small-star: every vertex links its greater neighbours, then its lesser ones, to its
    minimum, until no link moves; both are combining aggregations and joins.
    """
    scratch = Scratch(spark, "components")
    edges = scratch.save(pairs.select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return vertices.select("vertex", F.col("vertex").alias("component"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.save(near)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    labels = edges.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(labels, vertices["vertex"] == labels["u"], "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
