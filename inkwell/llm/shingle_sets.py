"""Exact likeness of shingle sets: Jaccard similarity within groups of candidates.

A group holds the sets that some cheaper test has joined. Its links are the pairs whose
sets share at least ``least`` of their union; of these as many are given as connect the
same sets. Small groups are settled in a task each. A large group is first compared with
one set of its own, the centre: what is alike is connected by that alone, so a large group
of near copies costs in proportion to its members. The others are compared with each
other, and with the centre's set only if the distances to the centre allow a link (the
Jaccard distance is a metric), block by block; nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import lean, settle, settle_few, text_slices
from .simhash import shingle_hashes

#: Sets of a group, of which the centre is chosen.
HEADS = 32


def digest_of(hashes: np.ndarray) -> bytes:
    """128 bits of a set of shingles, given sorted."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def set_rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, shingles): each text's distinct shingle hashes, sorted, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            sets = [np.unique(shingle_hashes(text, words)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(digest_of, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), "digest binary, shingles binary")


def _alike(shared: np.ndarray, union: np.ndarray, least: float) -> np.ndarray:
    return (shared > 0) & (shared + 1e-9 >= least * union)


def connect(sets: list[np.ndarray], joined: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of indices that connect all sets that are alike; those marked ``joined`` count as one."""
    lengths = np.array([len(s) for s in sets], np.int64)
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(lengths)
    free = ~joined
    mark = np.zeros(len(names), bool)
    live = np.flatnonzero(free)
    own, who = token[np.repeat(free, lengths)], np.repeat(np.arange(len(live)), lengths[live])
    stack, out = np.flatnonzero(joined).tolist(), []
    while free.any():
        if not stack:
            stack = [int(np.argmax(free))]
            free[stack[0]] = False
        first = stack[0]
        while stack and free.any():
            if 2 * free.sum() < len(live):
                stay = free[live]
                own, who = own[stay[who]], (np.cumsum(stay) - 1)[who[stay[who]]]
                live = live[stay]
            at = stack.pop()
            mine = token[ends[at] - lengths[at] : ends[at]]
            mark[mine] = True
            shared = np.bincount(who[mark[own]], minlength=len(live))
            mark[mine] = False
            hit = live[free[live] & _alike(shared, lengths[at] + lengths[live] - shared, least)]
            free[hit] = False
            stack += hit.tolist()
            out += [(int(x), first) for x in hit]
        stack = []
    return out


def _connected(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) links of each (root, b1, b2); rows have node, near (of the centre's set) and shingles."""
    keys = ["root", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pd.DataFrame):
            codes = rows[keys].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1), True])
            node, near, shingles = rows["node"].to_numpy(), rows["near"].to_numpy().astype(bool), rows["shingles"].tolist()
            found = []
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if end - at > 1 and not near[at:end].all():
                    pairs = connect([np.frombuffer(x, np.uint64) for x in shingles[at:end]], near[at:end], least)
                    found += [(node[at + i], node[at + j]) for i, j in pairs]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found, strict=True)], names=["a", "b"])

        held = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            codes = rows[keys].to_numpy()
            same = (codes == codes[-1]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from links(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None:
            yield from links(held)

    placed = rows.select(*keys, "node", "near", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(lean(run), "a long, b long")


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        out.append(shared / max(len(x) + len(y) - shared, 1))
    return pd.Series(out, dtype="float64")


def _centres(heads: DataFrame, least: float) -> DataFrame:
    """(root, node): of each group's heads the one that most of them are like."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        like = [sum(len(s := np.intersect1d(x, y, assume_unique=True)) + 1e-9 >= least * (len(x) + len(y) - len(s)) for y in sets) for x in sets]
        return rows.iloc[[int(np.argmax(like))]][["root", "node"]]

    return heads.groupBy("root").applyInPandas(choose, "root long, node long")


def _blocks(block_rows: int, block_bytes: int) -> Column:
    size = F.sum(F.octet_length("shingles"))
    return F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(size / block_bytes)).cast("long")


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def set_links(groups: DataFrame, sets: DataFrame, least: float, block_rows: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(a, b): links that connect all alike sets of each group.

    ``groups`` has (root, node), ``sets`` has (node, shingles), both settled.
    """
    rows = groups.join(sets.hint("merge"), "node")
    total = groups.count()
    sizes = settle_few(rows.groupBy("root").agg(_blocks(block_rows, block_bytes).alias("blocks")), total)
    one = lambda name: F.lit(0).cast("long").alias(name)
    usual = groups.join(sizes.where("blocks = 1"), "root").join(sets.hint("merge"), "node")
    usual = usual.select("root", one("b1"), one("b2"), "node", F.lit(False).alias("near"), "shingles")
    wide = sizes.where("blocks > 1")
    if wide.isEmpty():
        return _connected(usual, least)

    many = groups.join(wide, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    heads = many.groupBy("root", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HEADS)).alias("salt")).agg(F.min("node").alias("node"))
    centres = _centres(heads.join(sets.hint("merge"), "node").select("root", "node", "shingles"), least)
    centres = settle(centres.join(sets.hint("merge"), "node").select("root", F.col("node").alias("centre"), F.col("shingles").alias("middle")))
    spread = centres.join(wide, "root").withColumn("block", _upto("blocks")).drop("blocks")
    many = many.join(sets.hint("merge"), "node").join(spread.hint("merge"), ["root", "block"])
    many = many.select("root", "node", "shingles", "block", "blocks", "centre", _jaccard("shingles", "middle").alias("j"))
    # Files of about 4 MB, as the number of rows says little of sets.
    mean = sets.agg(F.avg(F.octet_length("shingles"))).first()[0] or 0
    many = settle_few(many, total, max(1, min(20_000, int((4 << 20) / (mean + 1)))))
    near, far = many.where(F.col("j") + 1e-9 >= least), many.where(F.col("j") + 1e-9 < least)
    out = near.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))

    left = settle_few(far.groupBy("root").agg(_blocks(block_rows, block_bytes).alias("others")), total)
    far = far.join(left, "root").withColumn("other", F.pmod(F.xxhash64("node", F.lit(2)), "others"))
    # Over twice the allowed distance from the centre, none of what the centre is like is in reach.
    reach = far.where(F.col("j") + 1e-9 >= 2 * least - 1)
    across = near.join(left, "root").select("root", F.col("block").alias("b1"), _upto("others").alias("b2"), "node", F.lit(True).alias("near"), "shingles")
    across = across.unionByName(reach.select("root", _upto("blocks").alias("b1"), F.col("other").alias("b2"), "node", F.lit(False).alias("near"), "shingles"))
    among = far.select("root", "other", _upto("others").alias("with"), "node", "shingles")
    among = among.select("root", F.least("other", "with").alias("b1"), F.greatest("other", "with").alias("b2"), "node", F.lit(False).alias("near"), "shingles")
    # The usual groups have other roots, and a negative number tells the blocks across from those among.
    across = across.withColumn("b1", -1 - F.col("b1"))
    return out.unionByName(_connected(usual.unionByName(across).unionByName(among), least))
