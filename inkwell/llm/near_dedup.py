"""SimHash near duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit majority fingerprint of its word shingles. The bits are grouped
into partitions of correlated bits; every partition gets its own threshold, -1 (not
probed), 0, 1, ..., such that the thresholds plus one add up to the radius plus one.
Two fingerprints within the radius then agree within the threshold in one partition at
least. The thresholds come from a dynamic programme over the estimated candidate counts
of each partition, which are taken from statistics of all fingerprints. Every
fingerprint probes the keys within the threshold of its own; candidates are verified on
all bits; what remains are links, and components of links are the classes.

A bucket's links are reduced to a spanning set where they are found, so a large group
of near copies gives rows in proportion to its members, not to its pairs. Buckets over
``full`` members go another, exact way: see ``_full_buckets``. At a radius over 2 the
probes are too many to travel one by one: see ``probe_cells``.

A fingerprint only estimates likeness. Where a Jaccard similarity is asked for, the classes
above are no more than groups of candidates, and links are the pairs in them whose shingle
sets are that similar: see ``shingle_sets``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_count, join_counted, lean, settle, settle_few, small_batches, text_or_empty, text_slices, unused
from .components import components
from .probe_cells import PACKED, Part, crowded_rows, pack, verify
from .shingle_sets import digest_of, set_links, set_rows
from .simhash import bit_votes, majority_fingerprints, pack_bits, shingle_hashes

BITS = 64


def fingerprint_rows(docs: DataFrame, words: int, second: bool, id_col: str = "doc_id", text_col: str = "text", sets: bool = False, sha: bool = False) -> DataFrame:
    """(doc_id, fp, fp2) of whole texts; fp2 is a second, independent fingerprint or 0.

    With ``sets`` also digest, 128 bits of the set of shingles, each hashed once; with
    ``sha`` also the text's SHA-256, by which rows that share an id are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column(1).to_pylist()
            columns = {"doc_id": batch.column(0)}
            if sets:
                hashes = [shingle_hashes(text, words) for text in texts]
                n = np.array([len(h) for h in hashes], np.int64)
                first = pack_bits(2 * bit_votes(np.concatenate(hashes), n) > n[:, None])
                columns["digest"] = pa.array([digest_of(np.unique(h)) for h in hashes], pa.binary())
            else:
                first = majority_fingerprints(texts, words)
            other = _second_fingerprints(texts, words) if second else np.zeros(len(texts), np.uint64)
            columns |= {"fp": pa.array(first.view(np.int64)), "fp2": pa.array(other.view(np.int64))}
            if sha:
                columns["sha"] = batch.column(2)
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    order = ["doc_id", "fp", "fp2", *["digest"] * sets, *["sha"] * sha]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, fp long, fp2 long" + ", digest binary" * sets + ", sha binary" * sha
    extra = [F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("sha")] if sha else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra).mapInArrow(lean(run), schema)


def _second_fingerprints(texts: list, words: int) -> np.ndarray:
    out = []
    for text in texts:
        h = shingle_hashes(text, words, seed=4242)
        n = np.array([len(h)], np.int64)
        out.append(pack_bits(2 * bit_votes(h, n) > n[:, None]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# Statistics and the plan ----------------------------------------------------------


def _bit_statistics(points: DataFrame) -> tuple[int, np.ndarray]:
    """Count of points and, for each pair of bits, of points that have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += len(bits)
            both += bits.T @ bits
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[-1, j]), pa.array(np.r_[total, both[i, j]].astype(np.int64))], names=["i", "j", "n"])

    rows = points.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total, both = 0, np.zeros((BITS, BITS))
    for r in rows:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return total, both


def correlated_partitions(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt greedily into groups of near-equal size, each around correlated bits."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].sum(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def _key(bits: list[int], column) -> F.Column:
    """The listed bits of a fingerprint; the mask keeps them in place."""
    mask = sum(1 << b for b in bits)
    return column.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _ball_size(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def allocate(costs: list[dict[int, float]], units: int) -> list[int]:
    """Thresholds of least total cost whose values plus one add up to ``units``.

    ``costs[i][t]`` is the cost of threshold t, from -1, in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for table in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for (used, (cost, chosen)), (t, more) in itertools.product(best.items(), table.items()):
            at, value = used + t + 1, cost + more
            if at <= units and (at not in after or value < after[at][0]):
                after[at] = (value, [*chosen, t])
        best = after
    return best[units][1]


def plan(points: DataFrame, radius: int, part_counts: tuple[int, ...], full: int | None = None) -> tuple[list[tuple[list[int], int]], list[list[int]], np.ndarray, int]:
    """[(bits, threshold)] of the cheapest of the given numbers of partitions.

    Then, if ``full`` is given, each one's keys with more fingerprints than that (and than a
    thousandth of all, so that they are a thousand at most), the bits' odds and the count.

    The pairs that agree on a partition are counted over all points; those that differ
    there by up to t bits are estimated from the odds that a pair differs in each bit.
    A probe is weighed as eight comparisons.
    """
    total, both = _bit_statistics(points)
    p = np.diag(both) / max(total, 1)
    differ = 2 * p * (1 - p)
    options = {m: correlated_partitions(total, both, m) for m in part_counts if sum(min(radius, 2) + 1 for _ in range(m)) >= radius + 1}
    keys = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    # All partitions' keys are counted in one pass.
    tagged = F.array(*[F.struct(F.lit(j).alias("j"), _key(bits, F.col("fp")).alias("key")) for j, (_, _, bits) in enumerate(keys)])
    sizes = points.select(F.explode(tagged).alias("k")).groupBy("k.j", "k.key").count()
    pairs = F.col("count").cast("double") * (F.col("count") - 1) / 2
    most = F.lit(None) if full is None else F.lit(heavy_count(total, full))
    many = F.collect_list(F.when(F.col("count") > most, F.col("key"))).alias("many")
    counted = {r["j"]: r for r in sizes.groupBy("j").agg(F.sum(pairs).alias("n"), many).collect()}
    exact = {(m, i): counted[j]["n"] if j in counted else 0.0 for j, (m, i, _) in enumerate(keys)}
    crowded = {(m, i): counted[j]["many"] if j in counted else [] for j, (m, i, _) in enumerate(keys)}
    choices = []
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            odds = [differ[b] / max(1 - differ[b], 1e-9) for b in bits]
            symmetric = [1.0] + [0.0] * radius
            for o in odds:
                for k in range(radius, 0, -1):
                    symmetric[k] += symmetric[k - 1] * o
            costs.append({-1: 0.0} | {t: exact[m, i] * sum(symmetric[: t + 1]) + 8.0 * total * _ball_size(len(bits), t) for t in range(min(radius, 2) + 1)})
        if sum(max(c) + 1 for c in costs) >= radius + 1:
            chosen = allocate(costs, radius + 1)
            choices.append((sum(c[t] for c, t in zip(costs, chosen, strict=True)), m, chosen))
    _, m, chosen = min(choices)
    used = [(i, bits, t) for i, (bits, t) in enumerate(zip(options[m], chosen, strict=True)) if t >= 0]
    return [(bits, t) for _, bits, t in used], [crowded[m, i] for i, _, _ in used], p, total


# Probing and verifying ----------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], threshold: int) -> list[int]:
    return [_signed(sum(1 << b for b in chosen)) for k in range(threshold + 1) for chosen in itertools.combinations(bits, k)]


def _probes(points: DataFrame, scheme: list[tuple[list[int], int]], by: str) -> DataFrame:
    """(part, key, own, fp, fp2): own rows are the index, the others come from neighbours
    of the fingerprint ``by``."""
    def entry(k: int, bits: list[int], threshold: int):
        flips = F.array(*[F.lit(f) for f in _flips(bits, threshold)])
        return F.transform(flips, lambda f, i: F.struct(F.lit(k).alias("part"), _key(bits, F.col(by)).bitwiseXOR(f).alias("key"), (i == 0).alias("own")))

    entries = [entry(k, bits, t) for k, (bits, t) in enumerate(scheme)]
    return points.select("fp", "fp2", F.explode(F.concat(*entries)).alias("p")).select("p.part", "p.key", "p.own", "fp", "fp2")


def _star(fp: np.ndarray, fp2: np.ndarray, own: np.ndarray, radius: int, radius2: int, by: str, once: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between index rows and all rows of one bucket, as few as keep it connected: from
    each row of a component to its least fingerprint, which other buckets name too. With
    ``once`` a neighbour's probe has come to this bucket only, else to both of a pair."""
    first, other = (fp, fp2) if by == "fp" else (fp2, fp)

    def linked(a, b):
        near = np.bitwise_count(first[a][:, None] ^ first[b][None]).astype(np.int32)
        ok = near <= radius
        if radius2 >= 0:
            ok &= near + np.bitwise_count(other[a][:, None] ^ other[b][None]) <= radius2
        return ok

    index, everyone = np.flatnonzero(own), np.arange(len(fp))
    out = []
    if len(index) * len(fp) <= 1 << 20:
        # A pair is found from both sides, in the bucket of either; the one of the smaller
        # fingerprint counts, so a neighbour's probe need only be compared if it is larger.
        a, b = np.nonzero(linked(index, everyone) & (once | own[None] | (fp[None] > fp[index][:, None])))
        a, keep = index[a], index[a] != b
        if not keep.any():
            return out
        # Labels in order of the fingerprints, so that a component's is its least one.
        names, at = np.unique(fp, return_inverse=True)
        a, b, label = at[a[keep]], at[b[keep]], np.arange(len(names))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(names)))
        return [(names[moved], names[label[moved]])]
    free = np.ones(len(fp), bool)
    for start in index:
        if not free[start]:
            continue
        free[start] = False
        frontier, members = np.array([start]), [np.array([start])]
        while len(frontier) and free.any():
            rest = np.flatnonzero(free)
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 64):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                hit[todo] = linked(rest[todo], frontier[at : at + 64]).any(axis=1)
            frontier = rest[hit]
            free[frontier] = False
            members.append(frontier)
        if len(members) > 1:
            found = np.unique(fp[np.concatenate(members)])
            out.append((found[1:], np.full(len(found) - 1, found[0])))
    return out


def _verify(probes: DataFrame, keys: list[str], radius: int, radius2: int, by: str, once: bool = False) -> DataFrame:
    """(a, b) links of all buckets; a bucket's rows lie in one partition, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def settle_rows(rows: pd.DataFrame):
            codes = rows[keys].to_numpy()
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[first, len(rows)])
            fp, fp2, own = rows["fp"].to_numpy().view(np.uint64), rows["fp2"].to_numpy().view(np.uint64), rows["own"].to_numpy()
            found = []
            for at, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                s = slice(at, at + n)
                found += _star(fp[s], fp2[s], own[s], radius, radius2, by, once)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = batch.to_pandas()
            if held:
                rows = pd.concat([*held, rows], ignore_index=True)
            if not len(rows):
                continue
            codes = rows[keys].to_numpy()
            same = (codes == codes[-1]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from settle_rows(rows.iloc[:last])
            held = [rows.iloc[last:]]
        if held:
            yield from settle_rows(held[0].reset_index(drop=True))

    placed = probes.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(lean(run), "a long, b long")


def _full_buckets(rows: DataFrame, sizes: DataFrame, radius: int, radius2: int, by: str, full: int, once: bool = False) -> DataFrame:
    """Links of buckets with over ``full`` rows, none lost.

    For radius 2 without a second check: two fingerprints differ by two bits at most if
    and only if one lies within one bit of both, so members are grouped by the 65 points
    within one bit of them, at most 65 in a group however many members there are.
    Else a bucket is cut into blocks of about half of ``full`` rows and every pair of
    blocks is verified as a bucket of its own.
    """
    if radius == 2 and radius2 < 0:
        around = F.transform(F.array(*[F.lit(f) for f in _flips(list(range(BITS)), 1)]), lambda f: F.col("fp").bitwiseXOR(f))
        near = rows.select("fp").distinct().select("fp", F.explode(around).alias("point"))
        least = near.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("point").alias("p"), "b")
        return near.join(least, F.col("point") == F.col("p")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    blocks = F.ceil(F.col("n") * 2 / full)
    cut = rows.join(sizes, ["part", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", "fp2"), "blocks"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("part", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "own", "fp", "fp2")
    return _verify(spread, ["part", "key", "b1", "b2"], radius, radius2, by, once)


def links(points: DataFrame, radius: int, radius2: int = -1, part_counts: tuple[int, ...] | None = None, full: int | None = None) -> DataFrame:
    """(a, b): links that connect all of ``points`` (distinct fp, fp2) within the radius.

    ``radius2`` (-1: none) also bounds the distance over both fingerprints together; a pair
    is then linked if either fingerprint is within the radius, each being probed.
    """
    part_counts = part_counts or tuple(m for m in (2, 3, 4, 6, 8) if m <= radius + 2)
    # Neighbours' probes make up most of a bucket at larger radii, and cost less than its own.
    full = full or (4096 if radius <= 2 else 32_768)
    if radius > 2:
        return _links_by_cells(points, radius, radius2, part_counts, full)
    found = [_links_by(points, by, radius, radius2, part_counts, full) for by in (("fp",) if radius2 < 0 else ("fp", "fp2"))]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _links_by(points: DataFrame, by: str, radius: int, radius2: int, part_counts: tuple[int, ...], full: int) -> DataFrame:
    scheme, *_ = plan(points.select(F.col(by).alias("fp")), radius, part_counts)
    probes = _probes(points, scheme, by)
    sizes = settle(probes.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > full))
    if sizes.isEmpty():
        return _verify(probes, ["part", "key"], radius, radius2, by)
    usual = probes.join(sizes, ["part", "key"], "left_anti")
    crowded = probes.join(sizes.select("part", "key"), ["part", "key"], "left_semi")
    return _verify(usual, ["part", "key"], radius, radius2, by).unionByName(_full_buckets(crowded, sizes, radius, radius2, by, full))


def _links_by_cells(points: DataFrame, radius: int, radius2: int, part_counts: tuple[int, ...], full: int) -> DataFrame:
    """As ``_links_by`` over both fingerprints, by probes packed to cells; keys with over an
    eighth of ``full`` fingerprints of their own are cut into blocks of pairs."""
    columns = ("fp",) if radius2 < 0 else ("fp", "fp2")
    parts = []
    for k, by in enumerate(columns):
        scheme, crowded, odds, total = plan(points.select(F.col(by).alias("fp")), radius, part_counts, full // 8)
        parts += [Part(bits, t, k, odds, total, keys) for (bits, t), keys in zip(scheme, crowded, strict=True)]
    found = verify(pack(points, parts), parts, radius, radius2)
    for k, by in enumerate(columns):
        if any(len(part.crowded) for part in parts if part.by == k):
            rows = crowded_rows(points, parts, k)
            sizes = settle(rows.groupBy("part", "key").agg(F.count("*").alias("n")))
            found = found.unionByName(_full_buckets(rows, sizes, radius, radius2, by, full, True))
    return found


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 11, radius2: int = 26, id_col: str = "doc_id", text_col: str = "text", full: int | None = None, jaccard: float | None = None, **blocks) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest id of its class).

    Classes are the components of links between fingerprints; equal texts, rows with the
    same fingerprint and repeated rows share a class. A null text is the empty text,
    whose fingerprint is zero like any text's without words. A null id takes part and
    gets its class's smallest id, null if there is none. Texts are read whole; other
    columns aren't read. The defaults find a similarity of about 0.8 or more over
    shingles of five words: ``radius`` bits of either fingerprint, and ``radius2``
    of both together, so that unrelated texts, 32 of 64 bits apart on average, aren't joined.

    With ``jaccard``, such links only name candidates: classes are the components of pairs
    among them whose sets of shingles have at least that similarity, ``blocks`` being options
    of ``set_links``. Rows with the same fingerprint then share a class only if their sets
    do; rows with the same set always do.
    """
    rows, classes = _classes(docs, words, radius, radius2, id_col, text_col, full, jaccard, blocks, False)
    return join_counted(rows, classes.select(*_keys(jaccard), F.col("first.doc_id").alias("component_id"), "_n"), _keys(jaccard), heavy_count(rows.count())).select("doc_id", "fp", "component_id")


def _keys(jaccard: float | None) -> list[str]:
    return ["fp", "fp2"] if jaccard is None else ["digest"]


def _classes(docs: DataFrame, words: int, radius: int, radius2: int, id_col: str, text_col: str, full: int | None, jaccard: float | None, blocks: dict, sha: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have doc_id and ``_keys``; classes have one row of each keys with
    ``first``, the first row of its class: (no_id, doc_id, and with ``sha`` the text's),
    and ``_n``, how many rows have these keys. Both are settled."""
    small_batches(docs.sparkSession)
    keys = _keys(jaccard)
    rows = settle(fingerprint_rows(docs, words, radius2 >= 0, id_col, text_col, sets=jaccard is not None, sha=sha))
    # A known id comes before a null one, ties go by the text's digest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *["sha"] * sha)).alias("first")
    points = rows.groupBy(*dict.fromkeys(["fp", "fp2", *keys])).agg(first, F.count("*").alias("_n"))
    if jaccard is None:
        points = settle(points)
        prints = points.select("fp", "fp2")
    else:
        points = settle_few(points, rows.count())
        prints = settle_few(points.select("fp", "fp2").distinct(), points.count(), PACKED)
    total = points.count()
    keep = settle if jaccard is None else lambda df: settle_few(df, total)
    roots = keep(components(settle(links(prints, radius, radius2, full=full))))
    table = points.groupBy("fp").agg(F.count("*").alias("_n")).join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    table = keep(table.withColumn("root", F.coalesce("root", "fp")))
    named = join_counted(points.withColumnRenamed("_n", "_k"), table, ["fp"], heavy_count(total)).withColumnRenamed("_k", "_n")
    if jaccard is None:
        return rows, settle(_with_first(settle(named), "root", total, settle).select(*keys, "first", "_n"))
    members = keep(named.groupBy("root", "digest").agg(F.min("first").alias("first"), F.sum("_n").alias("_n")))
    return rows, _verified(docs, members, total, words, id_col, text_col, jaccard, blocks)


def _with_first(members: DataFrame, by: str, total: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Settled ``members`` with ``first`` as the least of all rows with the same ``by``; ``keep`` settles."""
    least = members.groupBy(by).agg(F.min("first").alias("first"), F.count("*").alias("_m"))
    least = keep(least).select(by, "first", F.col("_m").alias("_n"))
    counts = members.drop("first").withColumnRenamed("_n", "_k")
    return join_counted(counts, least, [by], heavy_count(total)).withColumnRenamed("_k", "_n")


def _verified(docs: DataFrame, members: DataFrame, total: int, words: int, id_col: str, text_col: str, jaccard: float, blocks: dict) -> DataFrame:
    """Classes of the candidates' components, ``members``, by the likeness of their sets."""
    several = members.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1")
    keep = lambda df: settle_few(df, total)
    asked = keep(join_counted(members.select("root", "digest", "first"), keep(several), ["root"], heavy_count(total)))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = asked.select(F.col("first.doc_id").alias("_id")).distinct()
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = set_rows(texts, words, "doc_id", "text").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = settle(sets.withColumn("node", F.monotonically_increasing_id()))
    groups = keep(asked.join(sets.select("digest", "node").hint("merge"), "digest").select("root", "node"))
    found = keep(components(settle(set_links(groups, sets.select("node", "shingles"), jaccard, **blocks))))

    # A set that no other is like is a class of its own. Words that repeat count for the
    # fingerprint and not for the set, so a set may be a member of several components.
    firsts = members.groupBy("digest").agg(F.min("first").alias("first"), F.sum("_n").alias("_n"))
    linked = sets.select("digest", "node").join(found.hint("merge"), "node").select("digest", "root")
    classes = firsts.join(linked.hint("merge"), "digest", "left").withColumn("class", F.coalesce(F.col("root").cast("string"), F.hex("digest")))
    classes = keep(classes.select("digest", "class", "first", "_n"))
    return keep(_with_first(classes, "class", total, keep).select("digest", "first", "_n"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = 0.8, words: int = 5, radius: int = 11, radius2: int = 26, full: int | None = None, **blocks) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were.

    The row with the smallest id stays, a null id only where no row has one; of rows that
    share it, the one whose text has the least SHA-256; of rows that repeat both id and text
    one. Rows with the same id but texts that aren't alike are of different classes, and
    each class keeps a row. Columns may have any names; an empty table stays empty.
    """
    rows, classes = _classes(docs, words, radius, radius2, id_col, text_col, full, jaccard, blocks, True)
    # The rows that go are fewer than those that stay, and few enough in many tables for
    # Spark to broadcast them after its own check of their size.
    total = rows.count()
    found = join_counted(rows.select("doc_id", "sha", *_keys(jaccard)), classes, _keys(jaccard), heavy_count(total))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    name, sha = unused(docs, "_gone"), unused(docs, "_sha")
    gone = settle_few(found.where(~stays).select(F.col("doc_id").alias(name), F.col("sha").alias(sha + "k")).distinct(), total)
    named = docs.withColumn(sha, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    out = named.join(gone, (F.col(sha) == F.col(sha + "k")) & F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
    repeats = settle_few(rows.groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "sha"), total)
    if not repeats.isEmpty():
        repeats = repeats.select(F.col("doc_id").alias(name), F.col("sha").alias(sha + "k"))
        match = (F.col(sha) == F.col(sha + "k")) & F.col(id_col).eqNullSafe(F.col(name))
        out = out.join(repeats, match, "left_anti").unionByName(out.join(repeats, match, "left_semi").dropDuplicates([id_col, sha]).select(*out.columns))
    return out.select(*docs.columns)
