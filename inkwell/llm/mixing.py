"""Mixing sources to target weights in fixed-length blocks.

Each source's words form one stream, cut into blocks of a fixed length. Output shards
have a fixed number of slots; the count of slots that each source gets in a shard is
drawn from a multinomial over what the sources still have to give, so that the shards
vary as a random mix does and the totals meet the targets. A source's slots, numbered
through all shards, are mapped to its blocks by keyed pseudorandom permutations, one
for each pass over the source; the blocks are then joined by index.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, Feistel, lean, running_start, settle, small_batches, text_or_empty, text_slices, unused


def capped_shares(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none over ``most`` times its size; excess is reshared."""
    shares = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole >= most * sizes[i]]
        if not full:
            for i in open_:
                shares[i] = left * weights[i] / whole
            break
        for i in full:
            shares[i] = most * sizes[i]
        left -= sum(shares[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return shares


def draw_counts(quotas: list[int], slots: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial counts of each shard; columns add up to the quotas."""
    left = np.array(quotas, np.int64)
    rng = np.random.default_rng(seed)
    rows = []
    while left.sum():
        want = min(slots, int(left.sum()))
        row = np.zeros(len(left), np.int64)
        while (more := want - int(row.sum())) > 0:
            room = left - row
            row += np.minimum(rng.multinomial(more, room / room.sum()), room)
        rows.append(row)
        left -= row
    return np.array(rows, np.int64).reshape(len(rows), len(quotas))


#: Sources at most: each is weighed, and its share drawn, on the driver.
MOST_SOURCES = 10_000


def _sources(rows: DataFrame, weights, share: float, most: float, block_words: int) -> list[dict]:
    """One entry per source, null last; over ``MOST_SOURCES`` of them are an error."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources to weigh")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.size) for r in found]
    weigh = [float(weights[i % len(weights)]) if isinstance(weights, (list, tuple)) else float(weights.get(r.source, 0.0)) for i, r in enumerate(found)]
    targets = capped_shares(sizes, weigh, share * sum(sizes), most)
    out = []
    for number, (r, size, target) in enumerate(zip(found, sizes, targets, strict=True)):
        length = max(1, min(block_words, size // 256))
        blocks = -(-size // length)
        # A source at its limit gives whole passes, its last, shorter block included.
        quota = int(most * blocks) if target >= most * size * (1 - 1e-12) else min(int(target / length + 0.5), int(most * blocks))
        out.append({"number": number, "source": r.source, "size": size, "target": target, "length": length, "blocks": blocks, "quota": quota})
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, picks) of the mixture.

    rows: one row per row of ``docs`` with doc_id, row, source, size (words), source_size,
    target, sha (the text's SHA-256). picks: one row for each part of a document in a slot,
    with shard, slot, place (the slot's word that it begins at), row, doc_id, first (the
    document's word that it begins at) and words. ``row`` numbers the rows of
    ``docs``, repeated ones too, and is fixed by a checkpoint. ``weights`` is a list that
    repeats over the sources by code point, null last, or a map by source. The mix takes
    ``share`` times all words; no source, and no document, is taken more than ``most`` (a
    whole number of passes) times. Null texts and texts without words have size 0 and are
    not taken. The block length is ``block_words``, less for a source of under 256 blocks.
    The same rows give the same mixture on any cluster. A shard has ``shard_slots`` slots;
    by default 4096, or more if there would be over 20,000 shards, whose counts the driver
    draws: name it to keep the shards of a table that grows.
    """
    return _mix(docs, weights, share, most, block_words, shard_slots, seed, id_col, text_col, source_col)[:2]


def _mix(docs, weights, share, most, block_words, shard_slots, seed, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame, int]:
    """``mix``, and how many shards there are."""
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
    )
    base = settle(base.withColumn("row", F.monotonically_increasing_id()))
    sources = _sources(base, weights, share, most, block_words)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(s["number"], s["source"], s["size"], float(s["target"]), s["length"]) for s in sources], "number int, name string, source_size long, target double, length long"))
    rows = base.join(table, F.col("source").eqNullSafe(F.col("name")))
    rows = settle(running_start(rows, "size", ["doc_id", "sha"], ["number"], "start", cell_rows=2_000))
    shard_slots = shard_slots or max(4096, -(-sum(s["quota"] for s in sources) // 20_000))
    counts = draw_counts([s["quota"] for s in sources], shard_slots, seed)
    before = np.vstack([np.zeros((1, len(sources)), np.int64), np.cumsum(counts, axis=0)]) if len(counts) else counts
    plan = [(k, before[k].tolist(), counts[k].tolist()) for k in range(len(counts))]
    shards = spark.createDataFrame(plan, "shard long, before array<long>, counts array<long>")
    if len(plan) > 1:
        shards = shards.repartition(min(len(plan), 1000), "shard")
    keys = [(s["blocks"], seed * 1_000_003 + zlib.crc32(repr(s["source"]).encode())) for s in sources]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = np.repeat(np.arange(len(counts)), counts)
                order = np.random.default_rng([seed, shard]).permutation(len(number))
                at = np.concatenate([np.arange(b, b + n) for b, n in zip(before, counts, strict=True)])
                block = np.zeros(len(at), np.int64)
                for i in np.unique(number):
                    mine = np.flatnonzero(number == i)
                    blocks, key = keys[i]
                    turns = at[mine] // blocks
                    for turn in np.unique(turns):
                        now = mine[turns == turn]
                        block[now] = Feistel(blocks, key + 7919 * int(turn)).forward(at[now] % blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(order.astype(np.int64)), pa.array(number.astype(np.int32)), pa.array(block)], names=["shard", "slot", "number", "block"])

    taken = shards.mapInArrow(slots, "shard long, slot long, number int, block long")
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    parts = rows.where("size > 0").select("row", "doc_id", "number", "start", "size", "length", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * F.col("length"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    parts = parts.select("row", "doc_id", "number", "block", (begin - F.col("start")).alias("first"), (end - begin).alias("words"), (begin - F.col("block") * F.col("length")).alias("place"))
    # Spark takes the slots for as small as the counts they come from, so the join is named.
    picks = parts.join(taken.hint("merge"), ["number", "block"]).select("shard", "slot", "place", "row", "doc_id", "first", "words")
    return rows.select("doc_id", "row", "source", "size", "source_size", "target", "sha"), picks, len(counts)


#: Shards that stand in one partition of the mixed documents.
SHARDS_TOGETHER = 8


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", places: bool = False) -> DataFrame:
    """The mixture as documents: one row for each part that a slot holds, in ``docs``' columns.

    The text is that part's words with the white space between them as it was; the id and
    the other columns are the document's; ``chars_col``, if present, is counted anew. Rows
    stand in the mixture's order: partitions hold ranges of shards, and the rows of each are
    sorted by shard, slot and place in the block. With ``places`` they also carry shard, slot
    and place (the slot's word that the part begins at); a name that is taken gets underscores.
    Repeated rows are mixed each by itself; columns may have any names; an empty table, or
    one without words, gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, picks, shards = _mix(docs, weights, share, most, block_words, shard_slots, seed, id_col, text_col, source_col)
    # Rows alike in id, source and text are numbered, so that each gets its own parts.
    key = ["doc_id", "source", "sha"]
    copies = settle(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n > 1").select(*key))
    wanted = picks.select("row", F.struct("first", "words", "shard", "slot", "place").alias("p")).groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    wanted = rows.select(*key, "row").join(wanted.hint("merge"), "row")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("sha"))

    def matched(left: DataFrame, right: DataFrame, more: list[str]) -> DataFrame:
        on = F.lit(True)
        for c in [*key, *more]:
            on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        return left.alias("l").join(right.hint("merge").alias("r"), on).select("l.doc", "r.parts")

    if copies.isEmpty():
        joined = matched(packed, wanted, [])
    else:
        def split(frame: DataFrame, how: str) -> DataFrame:
            on = F.lit(True)
            for c in key:
                on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}"))
            return frame.alias("l").join(copies.alias("c"), on, how)

        number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
        several = split(rows.select(*key, "row"), "left_semi").withColumn("copy", number("row")).select("row", "copy")
        numbered = split(wanted, "left_semi").join(several, "row").select(*key, "copy", "parts")
        joined = matched(split(packed, "left_anti"), split(wanted, "left_anti"), [])
        joined = joined.unionByName(matched(split(packed, "left_semi").withColumn("copy", number("sha")), numbered, ["copy"]))

    word = re.compile(WORD)
    columns = docs.columns
    at = columns.index(text_col)
    extra = [unused(docs, c) for c in ("shard", "slot", "place")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, at, 2 << 20)):
            owner, parts, places = [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)):
                bounds = np.array([m.span() for m in word.finditer(text)], np.int64)
                owner += [i] * len(wanted)
                parts += [text[bounds[r["first"], 0] : bounds[r["first"] + r["words"] - 1, 1]] for r in wanted]
                places += [(r["shard"], r["slot"], r["place"]) for r in wanted]
            rows = batch.select(list(range(len(columns)))).take(pa.array(owner, pa.int64()))
            rows = rows.set_column(at, text_col, pa.array(parts, rows.schema.field(at).type))
            if chars_col in columns:
                k = columns.index(chars_col)
                rows = rows.set_column(k, chars_col, pa.array([len(p) for p in parts], rows.schema.field(k).type))
            numbers = zip(*places, strict=True) if places else [[]] * 3
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(list(x), pa.int64()) for x in numbers]], names=[*columns, *extra])

    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in extra]])
    found = joined.select(*[F.col("doc").getField(c).alias(c) for c in columns], F.col("parts").alias(unused(docs, "parts"))).mapInArrow(lean(cut), schema)
    parts_of = F.floor(F.col(extra[0]) / SHARDS_TOGETHER).cast("int")
    found = found.repartitionById(max(1, -(-shards // SHARDS_TOGETHER)), parts_of).sortWithinPartitions(*extra)
    return found if places else found.select(*columns)
