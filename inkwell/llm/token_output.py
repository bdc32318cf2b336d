"""Token-ID output in training order.

Every document's tokens are cut into sequences of a fixed stride. Sequences are numbered
through the table, in the order of its rows, and a keyed Feistel permutation with
cycle-walking gives each number a global slot. A shard is a range of slots; ranges of
shards make the partitions, whose number follows from the count of slots. A shard file has
rows of equal width in the order of slots, so a reader resumes at slot s by seeking to
(s mod shard_slots) x stride x width. Beside it stands an index of its rows, and a manifest
names all shards when they are complete.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Feistel, fixed_rows, small_batches, text_or_empty, text_slices

#: Marks beside the byte values as ids: neither byte occurs in UTF-8.
END, PAD = 0xFF, 0xFE
#: Bytes of token ids in a partition of shards, about.
PARTITION_BYTES = 64 << 20
#: Texts, and bytes of each, of which the dictionary of the shuffled pieces is made.
SAMPLE, SAMPLE_BYTES = 1000, 4096


@dataclass
class Layout:
    """What a shard folder holds: ``slots`` rows of ``stride`` ids of ``width`` bytes each."""

    slots: int
    stride: int
    width: int
    shard_slots: int
    key: int

    @property
    def shards(self) -> int:
        return -(-self.slots // self.shard_slots)

    @property
    def row_bytes(self) -> int:
        return self.stride * self.width

    @property
    def shards_together(self) -> int:
        return max(1, PARTITION_BYTES // (self.shard_slots * self.row_bytes))

    def slots_of(self, shard: int) -> int:
        return min(self.shard_slots, self.slots - shard * self.shard_slots)


def _dictionary(docs: DataFrame, text_col: str) -> bytes:
    """Raw content that makes single pieces compress well; which rows it has changes no result."""
    rows = docs.select(F.substring(text_or_empty(text_col), 1, SAMPLE_BYTES).alias("t")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(1 << 16, [r["t"].encode("utf-8", "surrogatepass")[i : i + 1024] for r in rows for i in range(0, SAMPLE_BYTES, 1024)], k=200, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coded(content: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}


def _placed(docs: DataFrame, stride: int, shard_slots: int, key: int, id_col: str, text_col: str, ids_col: str | None, width: int, marks: tuple[int, int], fixed: bool) -> tuple[DataFrame | None, Layout, dict]:
    """Pieces (slot, doc_id, part, piece) in partitions of whole shards, sorted by slot."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = fixed_rows(docs.select(F.col(id_col).alias("doc_id"), (F.col(ids_col) if ids_col else text_or_empty(text_col).cast("binary")).alias("raw")), fixed)
    tokens = F.coalesce(F.size("raw") if ids_col else F.octet_length("raw"), F.lit(0))
    parts = F.floor(F.greatest(tokens, F.lit(0)) / stride) + 1
    rows = docs.select(F.spark_partition_id().alias("at"), parts.alias("parts"))
    # One row for each partition of the input, as numbering rows in order always needs.
    found = rows.groupBy("at").agg(F.sum("parts").alias("parts"), F.count("*").alias("n")).orderBy("at").collect()
    starts, total = {}, 0
    for r in found:
        starts[r["at"]] = (total, int(r["parts"]))
        total += int(r["parts"])
    layout = Layout(total, stride, width, shard_slots, key)
    if not total:
        return None, layout, {}
    content = b"" if ids_col else _dictionary(docs.withColumn("t", F.col("raw").cast("string")), "t")
    permutation = Feistel(total, key)
    known = spark.sparkContext.broadcast(starts)
    dtype = f"<u{width}"

    def packed(ids: pa.ListScalar) -> bytes:
        values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
        if len(values) and (values.min() < 0 or int(values.max()) >> (8 * width)):
            raise ValueError(f"an id doesn't fit into {width} bytes")
        return values.astype(dtype).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False, **_coded(content))
        start, left = known.value.get(TaskContext.get().partitionId(), (0, 0))
        for batch in (part for whole in batches for part in (text_slices(whole) if not ids_col else [whole])):
            owner, parts, pieces = [], [], []
            for i, raw in enumerate(batch.column(1)):
                raw = packed(raw) if ids_col else raw.as_py()
                n = len(raw) // (stride * width) + 1
                owner += [i] * n
                parts += range(n)
                pieces += [squeeze.compress(raw[p * stride * width : (p + 1) * stride * width]) for p in range(n)]
            left -= len(parts)
            if left < 0:
                break
            slots = permutation.forward(np.arange(start, start + len(parts)))
            start += len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(parts, pa.int64()), pa.array(pieces, pa.binary())], names=["slot", "doc_id", "part", "piece"])
        if left:
            raise RuntimeError("the input gave other rows when it was scanned again; leave ``fixed`` off")

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.mapInArrow(cut, f"slot long, doc_id {kind}, part long, piece binary")
    together = layout.shards_together
    placed = pieces.repartitionById(-(-layout.shards // together), F.floor(F.col("slot") / (shard_slots * together)).cast("int"))
    return placed.sortWithinPartitions("slot"), layout, {"content": content, "marks": marks, "kind": kind}


def _widened(layout: Layout, content: bytes, marks: tuple[int, int]):
    """Function from a batch of pieces to (tokens, n_tokens, crc32) of each."""
    spread = zstandard.ZstdDecompressor(**_coded(content))
    end, pad = (np.array([m], f"<u{layout.width}").tobytes() for m in marks)

    def widen(pieces) -> tuple[list, list, list]:
        tokens, counts = [], []
        for piece in pieces:
            raw = spread.decompress(piece, max_output_size=layout.row_bytes)
            n = len(raw) // layout.width
            if n < layout.stride:
                raw += end + pad * (layout.stride - n - 1)
            tokens.append(raw)
            counts.append(min(n + 1, layout.stride))
        return tokens, counts, [zlib.crc32(t) for t in tokens]

    return widen


COLUMNS = "slot long, shard long, byte_offset long, doc_id {kind}, part long, n_tokens int, crc32 long, tokens binary"


def training_sequences(docs: DataFrame, stride: int = 1024, shard_slots: int = 8192, key: int = 20, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, width: int = 1, marks: tuple[int, int] = (END, PAD), fixed: bool = False) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset, doc_id, part, n_tokens, crc32, tokens.

    The token ids are the text's UTF-8 bytes, or with ``ids_col`` those of an array column
    (an encoding's; null counts as empty), then an end mark; a document has floor(ids /
    stride) + 1 sequences, the last one filled up with the pad mark. ``tokens`` holds stride
    little-endian ids of ``width`` bytes. Slots are 0..N-1, each once. A null text is the
    empty text; repeated rows get sequences of their own; an empty table gives no rows.
    Numbers follow the rows' order. The input is scanned twice and is first written down in
    the checkpoint folder, unless ``fixed`` says that it is a table whose files don't change.
    """
    placed, layout, more = _placed(docs, stride, shard_slots, key, id_col, text_col, ids_col, width, marks, fixed)
    schema = COLUMNS.format(kind=docs.schema[id_col].dataType.simpleString())
    if placed is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widen = _widened(layout, more["content"], more["marks"])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens, counts, crc = widen(part.column(3).to_pylist())
                slot = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(slot // shard_slots), pa.array(slot % shard_slots * layout.row_bytes), part.column(1), part.column(2), pa.array(counts, pa.int32()), pa.array(crc, pa.int64()), pa.array(tokens, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "crc32", "tokens"])

    return placed.mapInArrow(run, schema)


def _store(folder: str):
    """(file system, path) of a folder given as a path or a URI, also as Hadoop prints one."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _name(root: str, shard: int, kind: str) -> str:
    return f"{root}/shard-{shard:08d}.{kind}"


class _Shard:
    """A shard being written: its rows' ids in one file, what they are in another.

    Both have names of the attempt's own until they are whole, so a task that is run again,
    or twice at a time, leaves the same files.
    """

    def __init__(self, system, root: str, layout: Layout, shard: int):
        self.system, self.root, self.layout, self.shard, self.rows = system, root, layout, shard, []
        self.temp = f"{root}/.part-{shard}-{os.getpid()}-{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.temp + ".bin")

    def add(self, rows: pa.RecordBatch, tokens: list[bytes]) -> None:
        done = sum(r.num_rows for r in self.rows)
        if (rows.column("slot").to_numpy() != self.shard * self.layout.shard_slots + done + np.arange(rows.num_rows)).any():
            raise ValueError(f"the rows of shard {self.shard} are not in the order of their slots")
        self.out.write(b"".join(tokens))
        self.rows.append(rows)

    def close(self) -> tuple[int, int]:
        self.out.close()
        table = pa.Table.from_batches(self.rows)
        if table.num_rows != self.layout.slots_of(self.shard):
            raise ValueError(f"shard {self.shard} has {table.num_rows} of {self.layout.slots_of(self.shard)} rows")
        with self.system.open_output_stream(self.temp + ".idx") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        for kind in ("idx", "bin"):
            self.system.move(f"{self.temp}.{kind}", _name(self.root, self.shard, kind))
        return self.shard, table.num_rows


def write_shards(docs: DataFrame, folder: str, stride: int = 1024, shard_slots: int = 8192, key: int = 20, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, width: int = 1, marks: tuple[int, int] = (END, PAD), fixed: bool = False) -> Layout:
    """Write the sequences of ``training_sequences`` as shard files into ``folder``, at once.

    ``folder`` is shared by all executors. Files are ``shard-<n>.bin`` (ids), ``shard-<n>.idx``
    (Arrow: slot, doc_id, part, n_tokens, crc32) and, when every shard is there,
    ``manifest.json``; what failed attempts have left is removed. An empty table has a
    manifest of no shards.
    """
    spark = docs.sparkSession
    placed, layout, more = _placed(docs, stride, shard_slots, key, id_col, text_col, ids_col, width, marks, fixed)
    system, root = _store(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widen = _widened(layout, more["content"], more["marks"])
        system, root = _store(folder)
        now, done = None, []
        for batch in batches:
            shards = batch.column("slot").to_numpy() // shard_slots
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if now is None or shards[at] != now.shard:
                    if now is not None:
                        done.append(now.close())
                    now = _Shard(system, root, layout, int(shards[at]))
                part = batch.slice(at, end - at)
                tokens, counts, crc = widen(part.column("piece").to_pylist())
                now.add(pa.RecordBatch.from_arrays([part.column("slot"), part.column("doc_id"), part.column("part"), pa.array(counts, pa.int32()), pa.array(crc, pa.int64())], names=["slot", "doc_id", "part", "n_tokens", "crc32"]), tokens)
        if now is not None:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in (0, 1)], names=["shard", "slots"])

    if placed is not None:
        written = placed.mapInArrow(run, "shard long, slots long").agg(F.count("*"), F.sum("slots")).first()
        if tuple(written) != (layout.shards, layout.slots):
            raise RuntimeError(f"{written[0]} of {layout.shards} shards were written")
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith(".part-"):
            system.delete_file(info.path)
    kind = docs.schema[id_col].dataType.simpleString()
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(asdict(layout) | {"shards": layout.shards, "id_type": kind}).encode())
    return layout


def read_shards(spark: SparkSession, folder: str, first_slot: int = 0) -> DataFrame:
    """The rows of ``training_sequences`` from ``first_slot`` on, read from the shard files.

    Each file is read once from the first wanted row to its end; the CRC is of the bytes
    that were read. Without a manifest, so with shards missing, it is an error.
    """
    system, root = _store(folder)
    with system.open_input_stream(f"{root}/manifest.json") as source:
        found = json.loads(source.read())
    schema = COLUMNS.format(kind=found.pop("id_type"))
    shards = found.pop("shards")
    layout = Layout(**found)
    todo = spark.range(first_slot // layout.shard_slots, max(shards, first_slot // layout.shard_slots), 1, max(1, -(-shards // layout.shards_together)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(folder)
        for shard in (s for batch in batches for s in batch.column(0).to_pylist()):
            with system.open_input_file(_name(root, shard, "idx")) as source:
                rows = pa.ipc.open_file(source).read_all()
            begin = max(0, first_slot - shard * layout.shard_slots)
            with system.open_input_file(_name(root, shard, "bin")) as source:
                source.seek(begin * layout.row_bytes)
                for at in range(begin, rows.num_rows, 4096):
                    part = rows.slice(at, 4096)
                    raw = source.read(part.num_rows * layout.row_bytes)
                    tokens = [raw[i : i + layout.row_bytes] for i in range(0, len(raw), layout.row_bytes)]
                    slot = part.column("slot").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // layout.shard_slots), pa.array(slot % layout.shard_slots * layout.row_bytes), part.column("doc_id").combine_chunks(), part.column("part").combine_chunks(), part.column("n_tokens").combine_chunks(), pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array(tokens, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "crc32", "tokens"])

    return todo.mapInArrow(run, schema)
