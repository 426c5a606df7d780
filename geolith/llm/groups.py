"""Consolidating pairwise matches into groups by seed-tree pruning.

Each round, every vertex tells its neighbourhood the least vertex in it.  A vertex that nobody named as a
minimum is pruned: it hangs below the least minimum it heard of, as a leaf of a propagation forest, and leaves
the graph; the minima it heard of stay linked through that least one.  Rounds shrink the graph until no edge is
left; then the seeds' identifiers flow down the forest, last pruned first.  The rounds grow with the logarithm of a
group's size, every step is a combining aggregation or an equi-join, and each vertex's label is written once, with its round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.storage import Scratch

MOST_ROUNDS = 200


def match_pairs(pairs: DataFrame, least_similarity: float = 85.0, left: str = "left_index", right: str = "right_index", similarity: str | None = "similarity_percent") -> DataFrame:
    """Distinct matches (a, b), a <= b. Null sides, null and NaN similarities are no match; evaluations of a pair that disagree match if any does."""
    kept = pairs.where(pairs[left].isNotNull() & pairs[right].isNotNull())
    if similarity is not None:
        kept = kept.where((pairs[similarity] >= least_similarity) & ~F.isnan(pairs[similarity].cast("double")))
    return kept.select(F.least(pairs[left], pairs[right]).cast("bigint").alias("a"), F.greatest(pairs[left], pairs[right]).cast("bigint").alias("b")).distinct()


def linked_groups(matches: DataFrame, scratch: Scratch, first: str = "a", second: str = "b") -> DataFrame:
    """(group_index, feature_index) for every vertex of a match; group_index is the least vertex linked to it.

    matches: two bigint columns; null sides are ignored, repeated rows and either order change nothing, a vertex
    matched with itself only is its own group.  An empty table gives no rows.
    """
    ends = matches.select(F.col(first).cast("bigint").alias("u"), F.col(second).cast("bigint").alias("v")).where("u is not null and v is not null")
    loops = scratch.save(ends.where("u = v").select("u").distinct())
    apart = ends.where("u <> v")
    edges = scratch.save(apart.unionByName(apart.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    pruned = []
    while not edges.isEmpty():
        if len(pruned) >= MOST_ROUNDS:
            raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
        # u's minimum, itself included, told to its neighbours and to itself. Distinct before the write: a hub hears few minima.
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        heard = scratch.save(edges.join(least, "u").select(F.col("v").alias("w"), "m").unionByName(least.select(F.col("u").alias("w"), "m")).distinct())
        fate = heard.groupBy("w").agg(F.min("m").alias("parent"), F.max(F.col("m") == F.col("w")).alias("stays"))
        pruned.append(scratch.save(fate.where(~F.col("stays")).select(F.col("w").alias("vertex"), "parent")))
        links = heard.join(fate.select("w", "parent"), "w").where(F.col("m") != F.col("parent")).select(F.col("m").alias("u"), F.col("parent").alias("v"))
        rest = scratch.save(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        scratch.drop(edges, heard)
        edges = rest
    # A vertex's parent is a seed or was pruned in a later round: labels are made round by round, last first, each written once.
    known = None
    for forest in reversed(pruned):
        if known is None:
            below = forest.select(F.col("parent").alias("group_index"), F.col("vertex").alias("feature_index"))
        else:
            above = known.select(F.col("feature_index").alias("parent"), "group_index")
            below = forest.join(above, "parent", "left").select(F.coalesce("group_index", "parent").alias("group_index"), F.col("vertex").alias("feature_index"))
        below = scratch.save(below)
        scratch.drop(forest)
        known = below if known is None else known.unionByName(below)
    labels = known
    alone = loops.select(F.col("u").alias("group_index"), F.col("u").alias("feature_index"))
    if labels is None:
        return alone
    seeds = labels.select("group_index").distinct().select("group_index", F.col("group_index").alias("feature_index"))
    grouped = labels.unionByName(seeds)
    return grouped.unionByName(alone.join(grouped.select("feature_index"), "feature_index", "left_anti").select("group_index", "feature_index"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """How many groups there are of each size."""
    return groups.groupBy("group_index").agg(F.count(F.lit(1)).alias("features")).groupBy("features").agg(F.count(F.lit(1)).alias("groups"))
