"""Byte-level BPE with a global distinct-word shuffle.

Texts are split into pre-tokens by the vocabulary's pattern. Per block of documents the
distinct pre-tokens are gathered and sent, packed, to the partition that their hash
names; there each distinct pre-token is encoded once for all blocks. The ids return to
their block, where the documents' positions, sent there once as indexes into the block's
distinct pre-tokens, are put together again. Decoding joins the token-byte table, which
has a row for each vocabulary entry.

Packing is what keeps the shuffles below the size of the input: one row for each block
and hash bucket instead of one for each pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fixed_rows, give_back, lean, small_batches, text_slices

#: Bytes of text in a block of documents; bounds a worker's memory.
BLOCK_BYTES = 4_500_000
#: Encoded pre-tokens that a worker keeps at most; older ones are encoded again if needed.
KEEP = 400_000


class Vocabulary:
    """Ranks read from a tiktoken file, the pre-token pattern and the token-byte table."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

        # Native unsigned types of 2 and 4 bytes, little-endian on all hosts of Spark's workers.
        self.code = "H" if len(self.bytes_of) <= 1 << 16 else "I"

    def packed_ids(self, word: bytes) -> bytes:
        """Ids of one pre-token, end to end."""
        return array(self.code, self.coder.encode_ordinary(word.decode("utf-8", "surrogatepass"))).tobytes()


_loaded: dict = {}


def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    """The vocabulary of this worker, read once."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = Vocabulary(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def splitter(pattern: str):
    """Function from a text to its pre-tokens, in order and without gaps."""
    return regex.compile(pattern).findall


def _pack(parts: list[bytes], squeeze: zstandard.ZstdCompressor) -> bytes:
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return squeeze.compress(np.uint32(len(parts)).tobytes() + lengths.tobytes() + b"".join(parts))


def _unpack(raw: bytes, spread: zstandard.ZstdDecompressor) -> list[bytes]:
    raw = spread.decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.r_[4 + 4 * n, ends[:-1]]
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] if n else []


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str):
    """(key, id column, pre-tokens of each document, distinct pre-tokens in order of occurrence)."""
    split = splitter(pattern)
    for batch in batches:
        for part in text_slices(batch, most=BLOCK_BYTES):
            texts = part.column(1).to_pylist()
            found = [split(text) if text else [] for text in texts]
            distinct: dict[str, None] = {}
            for tokens in found:
                distinct.update(dict.fromkeys(tokens))
            # The key names the content, so a block that came out otherwise the second
            # time finds no partner and the job fails instead of mixing documents up.
            key = xxhash.xxh3_128()
            for value, text in zip(part.column(0).to_pylist(), texts, strict=True):
                key.update(repr(value).encode())
                key.update(b"\0" if text is None else b"\1" + text.encode("utf-8", "surrogatepass"))
            del texts
            yield key.digest(), part.column(0), found, list(distinct)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, finish: Callable[[pa.Table], pa.Table] | None = None, schema: str = "n_tokens long, ids array<int>", fixed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (array of int).

    Every text is encoded whole, without special tokens, as the tiktoken library does
    with the same ranks and pattern; a null text counts as empty and has no ids. Repeated
    rows are encoded like any others; an empty table gives no rows; other columns are not
    read. ``docs`` is scanned twice, so ids and texts are first written to the checkpoint
    folder, unless ``fixed`` says that it is a table whose files don't change. ``finish``
    may turn each block's rows into others, with the columns of ``schema`` after doc_id, in
    the worker that has them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    source = fixed_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fixed)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for key, _, _, words in _blocks(batches, pattern):
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            to = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([key] * len(rows), pa.binary()), pa.array([squeeze.compress(which.astype("<u4").tobytes()) for _, which in rows], pa.binary()), pa.array([_pack([raw[i] for i in which.tolist()], squeeze) for _, which in rows], pa.binary())], names=["bucket", "block", "which", "words"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(ranks_path, pattern)
        squeeze, spread = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for block, which, packed in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                words = _unpack(packed, spread)
                if len(known) > KEEP:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = coder.packed_ids(w)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([which], pa.binary()), pa.array([_pack([known[w] for w in words], squeeze)], pa.binary())], names=["block", "which", "ids"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for key, ids, found, words in _blocks(batches, pattern):
            place = dict(zip(words, range(len(words)), strict=True)).__getitem__
            counts = [len(tokens) for tokens in found]
            flat = np.fromiter(map(place, chain.from_iterable(found)), "<u4", sum(counts))
            # Low and high bytes apart: the high ones are alike and squeeze well.
            planes = np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
            head = _pack([np.array(counts, "<u4").tobytes(), sink.getvalue().to_pybytes(), np.uint32(len(words)).tobytes()], squeeze)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([head], pa.binary()), pa.array([squeeze.compress(planes)], pa.binary())], names=["block", "which", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        wide = len(vocabulary(ranks_path, pattern).bytes_of) > 1 << 16
        spread = zstandard.ZstdDecompressor()
        heads, parts = [], []
        for head, which, ids in zip(table["head"].to_pylist(), table["which"].to_pylist(), table["ids"].to_pylist(), strict=True):
            (heads if head else parts).append((which, ids))
        if not heads:
            raise RuntimeError("the input gave other rows when it was scanned again; leave ``fixed`` off")
        counts, id_column, n = _unpack(heads[0][0], spread)
        n_words = int(np.frombuffer(n, "<u4")[0])
        words: list = [None] * n_words
        for which, ids in parts:
            for i, x in zip(np.frombuffer(spread.decompress(which), "<u4").tolist(), _unpack(ids, spread), strict=True):
                words[i] = x
        if any(w is None for w in words):
            raise RuntimeError("the input gave other rows when it was scanned again; leave ``fixed`` off")
        planes = np.frombuffer(spread.decompress(heads[0][1]), np.uint8).reshape(4, -1)
        flat = np.ascontiguousarray(planes.T).view("<u4").ravel().tolist()
        counts = np.frombuffer(counts, "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        raw = [b"".join([words[i] for i in flat[b - c : b]]) for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        width = 4 if wide else 2
        lengths = np.fromiter((len(r) // width for r in raw), np.int64, len(raw))
        values = np.frombuffer(b"".join(raw), "<u4" if wide else "<u2").astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))
        owner = pa.ipc.open_stream(id_column).read_all().column(0).combine_chunks()
        out = pa.table({"doc_id": owner, "n_tokens": pa.array(lengths), "ids": lists})
        out = finish(out) if finish else out
        del raw, words, flat
        give_back()
        # A block that occurs again, with the same rows, has a head of its own each time.
        return pa.concat_tables([out] * len(heads))

    asked = source.mapInArrow(lean(requests), "bucket long, block binary, which binary, words binary").repartition("bucket")
    answers = asked.mapInArrow(lean(answer), "block binary, which binary, ids binary").withColumn("head", F.lit(False))
    placed = source.mapInArrow(lean(sequences), "block binary, which binary, ids binary").withColumn("head", F.lit(True))
    return answers.unionByName(placed).groupBy("block").applyInArrow(assemble, f"doc_id {kind}, {schema}")


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    """Bytes of a sequence of ids by the token-byte table."""
    return b"".join([table[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of ``ids_col``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(ranks_path, pattern).bytes_of
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            raw = [None if x.as_py() is None else decode_ids(np.asarray(x.values), table) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(ranks_path: str, pattern: str, keep_ids: bool = False) -> Callable:
    """Function from (doc_id, n_tokens, ids) in Arrow to the digests of each row's ids, as
    decimals joined by spaces, and of the bytes that its ids decode to one by one."""

    def run(rows):
        table = vocabulary(ranks_path, pattern).bytes_of
        decimal = [b"%d" % i for i in range(len(table))]
        values = rows.column(2).combine_chunks() if isinstance(rows, pa.Table) else rows.column(2)
        ids_sha, text_sha = [], []
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            ids = flat[a:b].tolist()
            ids_sha.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
            text_sha.append(hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest())
        columns = {"doc_id": rows.column(0), "n_tokens": rows.column(1), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        return type(rows).from_pydict(columns | ({"ids": values} if keep_ids else {}))

    return run


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of an encoding, decoding every id."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    work = digest_rows(ranks_path, pattern)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lambda batches: map(work, batches), f"doc_id {kind}, {DIGESTS}")


def encode_with_digests(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, **options) -> DataFrame:
    """``encode`` and ``digests`` in one worker: the ids needn't leave it for their digests."""
    schema = DIGESTS + (", ids array<int>" if keep_ids else "")
    return encode(docs, ranks_path, pattern, finish=digest_rows(ranks_path, pattern, keep_ids), schema=schema, **options)
