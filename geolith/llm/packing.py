"""Filling containers of fixed capacity with the sum-of-squares rule.

An item goes to the fill level at which the sum of the squared numbers of partly filled containers becomes least.  The
levels are one array of counts, so a step is one vector operation whatever the number of containers.  Every partition of
the items is packed where it stands, online, with its own levels: no shuffle, no key and no count of all items, so
neither equal nor null items gather anywhere and the packing of one partition does not depend on the rest of the data.
Items arrive in windows of a bounded number; within a window the larger ones go first, which leaves less unused space,
and the open containers are handed on from window to window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
WINDOW_ITEMS = 1 << 17
PARTITION_BITS = 40


class Levels:
    """The open containers by fill level."""

    def __init__(self, capacity: int):
        self.capacity, self.made, self.last = capacity, 0, -1
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open_at: dict[int, list[int]] = {}

    def place(self, sizes) -> np.ndarray:
        """Container of each item (0..capacity), by arrival. Ties go to the fullest level, then to a new container last.

        Placing s into level h > 0 changes the sum of squares by 2 (N[h+s] - N[h]) + 2, by 1 - 2 N[h] if that fills the
        container, and opening a container changes it by 2 N[s] + 1 (not at all if s fills it). An item of size 0 joins
        the container filled last, or opens one that the next item fills.
        """
        capacity, counts, open_at = self.capacity, self.counts, self.open_at
        out = np.empty(len(sizes), dtype=np.int64)
        for i, s in enumerate(sizes):
            if s == 0:
                if self.last < 0:
                    self.last, self.made = self.made, self.made + 1
                    open_at[0] = [self.last]
                out[i] = self.last
                continue
            level = 0 if open_at.get(0) else -1
            if level < 0 and s < capacity:
                gain = 2 * (counts[s + 1 :] - counts[1 : capacity - s + 1]) + 2
                gain[-1] -= 1  # counts[capacity] is always 0: the full container leaves the sum
                gain[counts[1 : capacity - s + 1] == 0] = 1 << 60
                k = len(gain) - 1 - int(np.argmin(gain[::-1]))
                if gain[k] <= 2 * counts[s] + 1:
                    level = k + 1
            if level < 0:
                at, level, self.made = self.made, 0, self.made + 1
            else:
                at = open_at[level].pop()
                if level:
                    counts[level] -= 1
            out[i] = self.last = at
            if level + s < capacity:
                counts[level + s] += 1
                open_at.setdefault(level + s, []).append(at)
        return out


def sum_of_squares(sizes, capacity: int) -> np.ndarray:
    """Container of each of a list of items, from no open container on."""
    return Levels(capacity).place(sizes)


def pieces_of(n: int, capacity: int) -> list[int]:
    """Sizes of the pieces of an item: itself, or for an item over the capacity full pieces and the rest."""
    if n <= capacity:
        return [n]
    full, rest = divmod(n, capacity)
    return [capacity] * full + [rest] * (rest > 0)


def pack_window(frame: pd.DataFrame, levels: Levels) -> pd.DataFrame:
    """item, n_tokens -> item, piece, piece_tokens, container. Larger pieces arrive first."""
    n = frame["n_tokens"].to_numpy()
    pieces = [pieces_of(int(x), levels.capacity) for x in n]
    counts = np.array([len(p) for p in pieces], dtype=np.int64)
    row = np.repeat(np.arange(len(frame)), counts)
    piece = np.concatenate([np.arange(c) for c in counts]) if len(frame) else np.empty(0, int)
    size = np.array([s for p in pieces for s in p], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    container = np.empty(len(size), dtype=np.int64)
    container[order] = levels.place(size[order])
    return pd.DataFrame({"item": frame["item"].to_numpy()[row], "piece": piece.astype("int32"), "piece_tokens": size, "container": container})


def packer(capacity: int, window: int):
    def run(batches):
        levels, held = Levels(capacity), []
        first = TaskContext.get().partitionId() << PARTITION_BITS

        def packed():
            out = pack_window(pd.concat(held, ignore_index=True), levels)
            held.clear()
            return out.assign(container=out["container"] + first)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= window:
                yield packed()
        if held:
            yield packed()

    return run


def pack_items(items: DataFrame, *, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, window: int = WINDOW_ITEMS) -> DataFrame:
    """Placements: item, piece, piece_tokens, container_id (unique over partitions).

    Every row of items is placed once, whole if it fits a container, else in full pieces and a rest.  A null or
    negative size counts as 0; items of size 0 join the container filled last.  Rows that repeat an item are items
    of their own; null items are placed like any.  Each partition of items is packed by itself: few large partitions
    leave less unused space than many small ones.  No items, no containers.
    """
    size_of = F.greatest(F.coalesce(items[size].cast("bigint"), F.lit(0)), F.lit(0))
    keyed = items.select(items[item].cast("bigint").alias("item"), size_of.alias("n_tokens"))
    packed = keyed.mapInPandas(packer(capacity, window), "item bigint, piece int, piece_tokens bigint, container bigint")
    return packed.select(F.col("item").alias(item), "piece", "piece_tokens", F.col("container").alias("container_id"))


def packing_report(placements: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items placed, containers, tokens, least possible number of containers, unused share."""
    fills = placements.groupBy("container_id").agg(F.sum("piece_tokens").alias("fill"), F.count(F.lit(1)).alias("pieces"))
    totals = fills.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.max("fill"), F.lit(0)).alias("fullest"))
    unused = F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0)
    return totals.select("pieces", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(unused, 6).alias("unused_share"))
