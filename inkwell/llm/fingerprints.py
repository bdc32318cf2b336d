"""SimHash document fingerprints and the search for all of them within a radius.

The terms of a document are its runs of five words. Each distinct term has a 128-bit
hash and the weight 1 + ln(times it occurs); its hash votes with that weight for each
bit that is set and against each that is not. The share of bits in which two
fingerprints differ estimates the angle between the documents' weighted terms.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_count, join_counted, mix64, settle, small_batches, text_or_empty, text_slices
from .components import components
from .simhash import bit_votes, pack_bits

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def term_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of ``words`` words; one for all of them if there are fewer."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = np.flatnonzero(~space)
    lengths = np.diff(np.r_[np.searchsorted(letters, starts), len(letters)])
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (raw[letters].astype(np.uint64) + np.uint64(1)) * (mix64(np.arange(int(lengths.max()))) | np.uint64(1))[place]
    word = mix64(np.add.reduceat(value, np.cumsum(lengths) - lengths))
    n = max(1, len(word) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return out


def weighted_fingerprints(texts, words: int = WORDS) -> np.ndarray:
    """(n, 2) uint64: the 128-bit fingerprints of whole texts; zero without words."""
    out = np.zeros((len(texts), 2), np.uint64)
    hashes, weights, who, held = [], [], [], 0

    def flush():
        if not who:
            return
        h, w = np.concatenate(hashes), np.concatenate(weights)
        counts = np.array([len(x) for x in hashes], np.int64)
        total = np.array([x.sum() for x in weights])
        for k, part in enumerate((h, mix64(h ^ _SECOND))):
            out[who, k] = pack_bits(2 * bit_votes(part, counts, w) > total[:, None])

    for i, text in enumerate(texts):
        distinct, times = np.unique(term_hashes(text, words), return_counts=True)
        if len(distinct):
            hashes.append(distinct)
            weights.append(1 + np.log(times))
            who.append(i)
            held += len(distinct)
        if held >= 1 << 18:
            flush()
            hashes, weights, who, held = [], [], [], 0
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine that the share of differing bits estimates, 0 to 1; 1 for equal fingerprints."""
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    return np.clip(np.cos(np.pi * differ / 128), 0.0, 1.0)


def hex_digits(fp: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in fp]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (32 hex digits).

    Texts are read whole. Equal texts have equal fingerprints; null, empty and blank
    texts have the zero fingerprint. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            fp = weighted_fingerprints(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hex_digits(fp), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def block_tables(radius: int, expected: int, bits: int = 128) -> list[list[tuple[int, int]]]:
    """Tables of the permuted search: each names the blocks (first bit, width) that must agree.

    The bits are cut into ``radius + kept`` blocks; two fingerprints within the radius
    agree on ``kept`` blocks at least, so there is a table for each choice of them. The
    least ``kept`` is taken whose blocks together have enough bits that chance partners
    are rare among ``expected`` fingerprints.
    """
    need = max(8, math.ceil(math.log2(max(expected, 2))))
    for kept in range(1, 5):
        blocks = radius + kept
        if kept * (bits // blocks) >= need or kept == 4 or math.comb(blocks + 1, kept + 1) > 128:
            break
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in itertools.pairwise(edges)]
    return [list(chosen) for chosen in itertools.combinations(spans, kept)]


def _mask(spans: list[tuple[int, int]]) -> tuple[int, int]:
    """The bits of some blocks in the high and the low half, as signed 64-bit numbers."""
    bits = sum(1 << (127 - b) for at, width in spans for b in range(at, at + width))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (bits >> 64, bits & (2**64 - 1)))


def connect(hi: np.ndarray, lo: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of indices, one less than rows of a component, that connect what is within the radius."""
    left, out = np.arange(len(hi)), []
    while len(left) > 1:
        first, left = left[0], left[1:]
        frontier = [first]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(hi[left] ^ hi[at]).astype(np.int32) + np.bitwise_count(lo[left] ^ lo[at]) <= radius
            hit, left = left[near], left[~near]
            frontier += hit.tolist()
            out += [(int(x), int(first)) for x in hit]
    return out


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of nodes; the rows (t, k1, k2, node, hi, lo) of a key lie in one partition."""
    keys = ["t", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(columns: list[np.ndarray]):
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            cuts = np.concatenate([[0], changes, [len(columns[0])]])
            node, hi, lo = columns[3], columns[4].view(np.uint64), columns[5].view(np.uint64)
            found = []
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                s = slice(cuts[k], cuts[k + 1])
                found += [(node[s][i], node[s][j]) for i, j in connect(hi[s], lo[s], radius)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found, strict=True)], names=["a", "b"])

        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            other = np.flatnonzero(np.any([c != c[-1] for c in columns[:3]], axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from links([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None and len(held[0]):
            yield from links(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def within_radius(points: DataFrame, radius: int, full: int = 20_000) -> DataFrame:
    """(a, b): links that connect all ``points`` (node, hi, lo; distinct) within ``radius`` bits.

    Permuted block tables: each table keys every fingerprint by some of its blocks, and the
    fingerprints of a key are compared. A dense group gives links in proportion to its
    members, not to its pairs. A key with over ``full`` fingerprints is split by the bits
    that its blocks leave: of ``radius`` + 1 blocks of these, two fingerprints within the
    radius agree on one at least. None is lost.
    """
    tables = block_tables(radius, points.count())
    entries, finer = [], []
    for t, spans in enumerate(tables):
        hi, lo = _mask(spans)
        entries.append(F.struct(F.lit(t).alias("t"), F.col("hi").bitwiseAND(F.lit(hi)).alias("k1"), F.col("lo").bitwiseAND(F.lit(lo)).alias("k2")))
        rest = [b for b in range(128) if not any(at <= b < at + width for at, width in spans)]
        masks = [_mask([(b, 1) for b in rest[k * len(rest) // (radius + 1) : (k + 1) * len(rest) // (radius + 1)]]) for k in range(radius + 1)]
        finer.append(F.array(*[F.struct(F.lit(len(tables) + t * (radius + 1) + k).alias("t"), F.lit(m[0]).cast("long").alias("m1"), F.lit(m[1]).cast("long").alias("m2")) for k, m in enumerate(masks)]))
    rows = points.select("node", "hi", "lo", F.explode(F.array(*entries)).alias("e")).select("e.t", "e.k1", "e.k2", "node", "hi", "lo")
    crowded = settle(rows.groupBy("t", "k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > full).select("t", "k1", "k2"))
    if crowded.isEmpty():
        return _bucket_links(rows, radius)
    # Keys with over ``full`` of the points are few, at most one in ``full`` for each table.
    usual = rows.join(F.broadcast(crowded), ["t", "k1", "k2"], "left_anti")
    split = rows.join(F.broadcast(crowded), ["t", "k1", "k2"], "left_semi").withColumn("f", F.explode(F.element_at(F.array(*finer), F.col("t") + 1)))
    split = split.select(F.col("f.t").alias("t"), F.col("k1").bitwiseOR(F.col("hi").bitwiseAND(F.col("f.m1"))).alias("k1"), F.col("k2").bitwiseOR(F.col("lo").bitwiseAND(F.col("f.m2"))).alias("k2"), "node", "hi", "lo")
    return _bucket_links(usual, radius).unionByName(_bucket_links(split, radius))


def near_classes(prints: DataFrame, radius: int = 3, fp_col: str = "fingerprint", full: int = 20_000) -> DataFrame:
    """One row per distinct fingerprint: fingerprint, near_class, rows (that have it).

    ``near_class`` is the least fingerprint that it reaches by steps of ``radius`` differing
    bits or fewer, itself included. Null fingerprints have no row.
    """
    half = lambda at: F.shiftleft(F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring("fingerprint", at + 8, 8), 16, 10).cast("long"))
    points = prints.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fingerprint")).agg(F.count("*").alias("rows"))
    points = settle(points.withColumns({"hi": half(1), "lo": half(17), "node": F.monotonically_increasing_id()}))
    roots = settle(components(settle(within_radius(points.select("node", "hi", "lo"), radius, full))))
    named = settle(points.join(roots.hint("merge"), "node").select("fingerprint", "rows", "root"))
    least = settle(named.groupBy("root").agg(F.min("fingerprint").alias("near_class"), F.count("*").alias("_n")))
    several = join_counted(named, least, ["root"], heavy_count(named.count())).select("fingerprint", "near_class", "rows")
    alone = points.join(roots.select("node").hint("merge"), "node", "left_anti").select("fingerprint", F.col("fingerprint").alias("near_class"), "rows")
    return several.unionByName(alone)


def with_near_class(rows: DataFrame, radius: int = 3) -> DataFrame:
    """Settled ``rows`` with ``near_class`` of their ``fingerprint``."""
    classes = settle(near_classes(rows, radius).withColumnRenamed("rows", "_n"))
    return join_counted(rows, classes, ["fingerprint"], heavy_count(rows.count()))


# Each document beside the next one ----------------------------------------------


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, guest, doc_id, text): buckets of neighbouring ids, each ending with a guest,
    the first document of the next bucket (after the last: of the first), so that every
    document's successor lies in its own bucket. Texts are shuffled once."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("doc_id"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 50 * buckets).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), np.int32)
        out[known] = 1 + np.searchsorted(cuts, values[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    heads = ids.withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("head")).orderBy("bucket").collect()
    before = {r["bucket"]: heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    # At most two rows for each shuffle partition.
    guests = F.broadcast(spark.createDataFrame([(r["bucket"], r["head"], before[r["bucket"]]) for r in heads], "b int, head long, to int"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("bucket", bucket_of("doc_id"))
    rows = rows.join(guests, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"))))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row per row of ``docs``. The next document is that of the next larger integer id
    (after the last, the first; null ids come first; rows that share an id follow each
    other by a hash of the text). A document on its own is its own next. Null texts count
    as empty. Likeness is the cosine that two fingerprints estimate, 0 to 1.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    rows = with_next(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "tie")
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in (part for whole in batches for part in text_slices(whole, 3)):
            columns = [batch.column(k).to_pylist() for k in range(4)]
            ids, texts, following = [], [], []
            for row in zip(*columns, strict=True):
                if last is not None and last[0] == row[0] and not last[1]:
                    ids.append(last[2])
                    texts.append(last[3])
                    following.append(row[3])
                last = row
            for at in range(0, len(ids), 1000):
                now, then = texts[at : at + 1000], following[at : at + 1000]
                changed = [edited(t, f) for t, f in zip(now, then, strict=True)]
                # The next document of one is the next row, so each is hashed once.
                chain = weighted_fingerprints([*now, then[-1]], words)
                same = np.array([a is b for a, b in zip(then[:-1], now[1:], strict=True)] + [True])
                after = chain[1:].copy()
                odd = np.flatnonzero(~same)
                if len(odd):
                    after[odd] = weighted_fingerprints([then[i] for i in odd], words)
                mine, other = chain[:-1], weighted_fingerprints(changed, words)
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + 1000], batch.column(2).type), pa.array([len(t) for t in now], pa.int64()), pa.array(sha), pa.array(hex_digits(mine)), pa.array(hex_digits(other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, after))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return placed.select("bucket", "guest", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
