"""Probes of fingerprints that travel once to a cell, not once for each key probed.

At larger radii a fingerprint probes hundreds of keys; a shuffled row for each is many
times the texts. Here the key of a partition of bits is cut: a few of its bits name a
cell, and a fingerprint goes to its own cell and to those whose bits are within the
threshold of its own. What it probes among the keys of a cell is found in the task that
holds the cell. Of two keys within the threshold the larger one's fingerprint visits the
smaller one's, so each pair meets once in a partition. Fingerprints travel packed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .components import spanning

#: Fingerprints packed at a time, and the most that a cell should hold with its visitors.
PACKED, CELL_POINTS = 50_000, 4_000_000
#: Bits that name a cell at least, so that tables of any size make some hundred tasks.
CELL_BITS = 5
#: Pairs compared at once, and links that a cell holds before they are reduced.
AT_ONCE, HELD = 1 << 20, 1 << 19


class Part:
    """A partition of bits with its threshold; ``by`` is the column that it keys, 0 or 1.

    ``crowded`` are keys whose fingerprints are settled elsewhere; they still visit.
    """

    def __init__(self, bits: list[int], threshold: int, by: int, odds: np.ndarray, total: int, crowded: list[int]):
        # Bits that are set in half the fingerprints make cells of like size.
        ranked = sorted(bits, key=lambda b: (-abs(odds[b] - 0.5), b))
        self.bits, self.threshold, self.by = ranked, threshold, by
        named = min(CELL_BITS, len(bits))
        while named < len(bits) and total * _ball(named, threshold) / 2**named > CELL_POINTS:
            named += 1
        self.named, self.fine = named, len(bits) - named
        self.steps = _masks(named, threshold)
        self.flips = [(f, int(f).bit_count()) for f in _masks(self.fine, threshold)]
        self.crowded = np.sort(self.codes(np.array(crowded, np.int64).view(np.uint64)))

    def codes(self, fp: np.ndarray) -> np.ndarray:
        """The partition's bits side by side, those that name the cell above the others."""
        out = np.zeros(len(fp), np.int64)
        for i, b in enumerate(self.bits):
            out |= (((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)).astype(np.int64)
        return out


def _ball(width: int, radius: int) -> int:
    return len(_masks(width, radius))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in itertools.combinations(range(width), k)]


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns], axis=1)


def pack(points: DataFrame, parts: list[Part]) -> DataFrame:
    """(cell, held): for each cell the fingerprints (fp, fp2) that are in it or visit it."""

    def packed(chunk: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(parts):
            home = part.codes(chunk[:, part.by]) >> part.fine
            who, to = [], []
            for step in part.steps:
                target = home ^ step
                visits = np.flatnonzero(target <= home)
                who.append(visits)
                to.append(target[visits])
            who, to = np.concatenate(who), np.concatenate(to)
            order = np.argsort(to, kind="stable")
            who, to = who[order], to[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            held = [chunk[who[a:b]].tobytes() for a, b in itertools.pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array((k << 32) + to[cuts[:-1]]), pa.array(held, pa.binary())], names=["cell", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_points(batch))
            size += batch.num_rows
            if size >= PACKED:
                yield from packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from packed(np.concatenate(held))

    return points.select("fp", "fp2").mapInArrow(lean(run), "cell long, held binary")


def crowded_rows(points: DataFrame, parts: list[Part], by: int) -> DataFrame:
    """(part, key, own, fp, fp2) of the crowded keys: their own fingerprints, and the visitors of larger keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _points(batch)
            for k, part in enumerate(parts):
                if part.by != by or not len(part.crowded):
                    continue
                codes = part.codes(both[:, by])
                for key in part.crowded.tolist():
                    at = np.flatnonzero((np.bitwise_count(codes ^ key) <= part.threshold) & (codes >= key))
                    if len(at):
                        rows = both[at].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), key)), pa.array(codes[at] == key), pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["part", "key", "own", "fp", "fp2"])

    return points.select("fp", "fp2").mapInArrow(lean(run), "part int, key long, own boolean, fp long, fp2 long")


def _bucket(first: np.ndarray, other: np.ndarray, own: int, radius: int, radius2: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that connect all rows of a bucket within the radius of one of its first ``own`` rows."""
    n = len(first)
    found, label, size = [], None, 0
    step = max(1, AT_ONCE // n)
    for at in range(0, own, step):
        near = np.bitwise_count(first[at : min(at + step, own), None] ^ first[None])
        hits = np.flatnonzero(near.ravel() <= radius)
        i, j = hits // n + at, hits % n
        # Of the bucket's own pairs one side is enough.
        keep = j > i
        i, j, hits = i[keep], j[keep], hits[keep]
        if radius2 >= 0 and len(hits):
            keep = near.ravel()[hits].astype(np.int32) + np.bitwise_count(other[i] ^ other[j]) <= radius2
            i, j = i[keep], j[keep]
        found.append((i, j))
        size += len(i)
        if size > max(4 * n, 1 << 16):
            found, size = [_spread(n, found)], n
    if size > n:
        found = [_spread(n, found)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spread(n: int, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``n`` places, as few as connect the same ones."""
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return spanning(n, a, b)


def _cell_links(part: Part, cell: int, points: np.ndarray, radius: int, radius2: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (of fp, as everywhere) between the keys of a cell and all its points."""
    first, other = points[:, part.by], points[:, 1 - part.by]
    codes = part.codes(first)
    spent = np.bitwise_count((codes >> part.fine) ^ cell).astype(np.int8)
    fine = codes & ((1 << part.fine) - 1)
    here = spent == 0
    index = np.flatnonzero(here & ~np.isin(codes, part.crowded)) if len(part.crowded) else np.flatnonzero(here)
    index = index[np.argsort(fine[index], kind="stable")]
    keys, start, count = np.unique(fine[index], return_index=True, return_counts=True)
    if not len(keys):
        return
    table = None
    if part.fine <= 22:
        table = np.full(1 << part.fine, -1, np.int32)
        table[keys] = np.arange(len(keys))
    slots, guests = [], []
    for flip, cost in part.flips:
        able = np.flatnonzero(spent + cost <= part.threshold)
        target = fine[able] ^ flip
        # Within the cell the larger key visits; what comes from other cells has the larger key.
        ok = ~here[able] | (target < fine[able])
        able, target = able[ok], target[ok]
        if table is None:
            slot = np.searchsorted(keys, target)
            slot[slot == len(keys)] = 0
            hit = keys[slot] == target
        else:
            slot = table[target]
            hit = slot >= 0
        slots.append(slot[hit].astype(np.int32))
        guests.append(able[hit].astype(np.int32))
    slots, guests = np.concatenate(slots), np.concatenate(guests)
    order = np.argsort(slots, kind="stable")
    guests = guests[order]
    ends = np.cumsum(np.bincount(slots, minlength=len(keys)))
    del slots, order
    for k in np.flatnonzero((count > 1) | (np.diff(ends, prepend=0) > 0)).tolist():
        own = int(count[k])
        rows = np.concatenate([index[start[k] : start[k] + own], guests[ends[k - 1] if k else 0 : ends[k]]])
        a, b = _bucket(first[rows], other[rows], own, radius, radius2)
        if len(a):
            yield points[rows[a], 0], points[rows[b], 0]


def _fewest(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints, as few as connect the same ones, each to the least (as signed numbers)."""
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    moved, label = spanning(len(names), at[: len(a)], at[len(a) :])
    return names[moved].view(np.uint64), names[label].view(np.uint64)


def verify(packed: DataFrame, parts: list[Part], radius: int, radius2: int) -> DataFrame:
    """(a, b) links that connect what the cells' fingerprints are within the radius of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell: int, held: list[bytes]):
            part = parts[cell >> 32]
            points = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
            found, size = [], 0
            for pair in _cell_links(part, cell & 0xFFFFFFFF, points, radius, radius2):
                found.append(pair)
                size += len(pair[0])
                if size > HELD:
                    found = [_fewest(found)]
                    yield from out(found)
                    found, size = [], 0
            if found:
                yield from out([_fewest(found)])

        def out(found: list):
            a, b = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            for cell, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if cell != now:
                    if held:
                        yield from links(now, held)
                    now, held = cell, []
                held.append(blob.as_py())
        if held:
            yield from links(now, held)

    # The number is given, as tasks are long for their few bytes and would be put together.
    count = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(count, "cell").sortWithinPartitions("cell").mapInArrow(lean(run), "a long, b long")
