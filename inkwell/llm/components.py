"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_count, settle


#: Links of a checkpointed part at least, where there are fewer than Spark's partitions.
ROWS_PER_PART = 200_000


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the numbers under ``n`` that connect what (a, b) do: from each to its least one."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _forest(links: DataFrame) -> DataFrame:
    """Of each part's links only what connects the same nodes: from each to its least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 5 * ROWS_PER_PART:
                yield reduced(held)
                held, size = [], 0
        if held:
            yield reduced(held)

    def reduced(held: list) -> pa.RecordBatch:
        pairs = np.concatenate([np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in held], axis=1)
        names, at = np.unique(pairs, return_inverse=True)
        moved, label = spanning(len(names), *at.reshape(pairs.shape))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label])], names=["u", "v"])

    return links.mapInArrow(run, links.schema)


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first())


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; ``least`` has (x, m, n), n being the edges of x.

    Hubs, at most a thousand as each has over a thousandth of all edges, are broadcast, so
    that none of them draws its edges into one task.
    """
    heavy = heavy_count(2 * total)
    if 2 * total <= heavy:
        return edges.join(least, F.col("u") == F.col("x"))
    hubs = F.broadcast(least.where(F.col("n") > heavy))
    usual = edges.join(hubs, F.col("u") == F.col("x"), "left_anti").join(least.where(F.col("n") <= heavy).hint("merge"), F.col("u") == F.col("x"))
    return edges.join(hubs, F.col("u") == F.col("x")).unionByName(usual)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("x"), "m", "n")
    joined = _with_least(edges, least, total)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node it reaches.

    ``edges`` has two columns of one orderable type, each row a link in any direction;
    self-links and repeats are allowed. Each round works on as many rows as there are
    links at most and is checkpointed, so a lost executor costs one round.
    """
    a, b = edges.columns
    oriented = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = settle(oriented)
    tally = _tally(now)
    done = False
    if tally[0] and dict(now.dtypes)["u"] in ("int", "bigint"):
        # Rounds move each link again and again; a group of copies has many more than it needs.
        parts = tally[0] // ROWS_PER_PART + 1
        now = _forest(now.coalesce(parts))
        # One part has seen all links, so its stars are the components.
        done = parts == 1
        now = settle(now if done else now.distinct())
        tally = _tally(now)
    while tally[0] and not done:
        # A round has at most as many rows as the one before, so a few go to few files.
        after_round = _small_star(_large_star(now, tally[0]).where("u <> v").distinct(), tally[0]).distinct()
        now = settle(after_round.coalesce(tally[0] // ROWS_PER_PART + 1))
        if (after := _tally(now)) == tally:
            break
        tally = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
