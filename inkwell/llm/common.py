"""Pieces that several operators share: checkpoints, prefix sums, permutations."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

_LIBC = ctypes.CDLL(None)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names.

    Only a local session without one, as in tests, gets a folder of its own here; on a
    cluster executors would write to disks that the others can't read, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through the file system that Spark itself uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of about ``most`` bytes in this session, unless it has a limit of its own.

    Spark's own limits, 10,000 rows or 64 MB, are large for whole texts: a batch stands in
    the JVM's direct memory and in the worker's at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) == 64 << 20:
        spark.conf.set(name, str(most))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that every executor can read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle_few(df: DataFrame, rows: int, per_file: int = 20_000) -> DataFrame:
    """``settle`` for a table of at most about ``rows`` narrow rows, in a file for each ``per_file``.

    Each file and each task that reads it takes a block of disk or several, whatever it
    holds; a few rows in as many files as there are shuffle partitions add up.
    """
    return settle(df.coalesce(rows // per_file + 1))


def fixed_rows(df: DataFrame, fixed: bool) -> DataFrame:
    """``df`` as rows that come in the same order and partitions whenever they are read.

    A table's files do (``fixed``): the number of parts that Spark cuts them into is held,
    as it would otherwise follow the executors that are there. Anything else is written to
    the checkpoint folder first.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if fixed:
        return df
    folder = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least.

    Python objects are made of a slice at a time, so a worker's memory doesn't follow the
    size of Spark's batches.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        limit = (upto[at - 1] if at else 0) + most
        end = max(at + 1, int(np.searchsorted(upto, limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and keep what it used."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(run):
    """A function over batches that gives memory back when it has ended."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Feistel:
    """Keyed permutation of 0..size-1: four Feistel rounds and cycle-walking.

    The network permutes the smallest domain of an even number of bits that holds
    ``size``; a value that falls outside is encrypted again until it falls inside,
    which takes fewer than four steps on average.
    """

    ROUNDS = 4

    def __init__(self, size: int, key: int):
        if size < 1:
            raise ValueError("a permutation needs at least one element")
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = np.arange(1, self.ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = mix64(seeds ^ mix64(np.array([key & (2**64 - 1)], np.uint64)))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix64(left ^ k) & self.mask), left
        return (left << self.half) | right

    def _walk(self, values, step) -> np.ndarray:
        out = step(np.asarray(values, dtype=np.uint64))
        while (outside := out >= np.uint64(self.size)).any():
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def forward(self, values) -> np.ndarray:
        return self._walk(values, lambda x: self._once(x, self.keys))

    def inverse(self, values) -> np.ndarray:
        return self._walk(values, self._back)


def _sums_before(heads: DataFrame, by: list[str], span: int) -> DataFrame:
    """``heads`` (by, _cell, _sum) with ``_head``, the sum of the earlier cells of the same ``by``.

    Cells are summed in runs of ``span``, and the runs along the group, so that no task
    sorts more than ``span`` cells or one row for each run.
    """
    runs = heads.withColumn("_run", F.floor(F.col("_cell") / span))
    totals = runs.groupBy(*by, "_run").agg(F.sum("_sum").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.col("_run").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    match = F.col("_run") == F.col("_r")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    along = Window.partitionBy(*by, "_run").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("_head", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    return inside.join(totals, match).select(*heads.columns, (F.col("_head") + F.col("_base")).alias("_head"))


def running_start(df: DataFrame, size: str, order: list[str], by: list[str], start: str, cell_rows: int = 50_000, span: int = 100_000) -> DataFrame:
    """Add ``start``: the sum of ``size`` over all earlier rows of the same ``by``.

    Rows stand in the order of a hash of ``order``, then of ``order`` itself. The hash
    deals each group into cells of about ``cell_rows`` rows, so that neither a group
    with a third of the rows nor the whole table is ever sorted in one task; only one
    row per cell is summed along the group, in two steps where there are over ``span``.
    """
    widest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-widest // cell_rows))
    celled = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    heads = celled.groupBy(*by, "_cell").agg(F.sum(size).alias("_sum"))
    if cells > span:
        heads = _sums_before(heads, by, span)
    else:
        along = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.withColumn("_head", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    heads = heads.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_cell").alias("_c"), "_head")
    match = F.col("_cell") == F.col("_c")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = celled.withColumn("_before", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inside.join(heads, match).withColumn(start, F.col("_head") + F.col("_before")).select(*df.columns, start)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], heavy: int) -> DataFrame:
    """Inner join with ``table``, one row for each of ``keys``, whose column ``_n`` counts their ``rows``.

    Keys with over ``heavy`` rows are few, at most one in ``heavy`` of the rows: they are
    broadcast, and their rows stay where they are. The rest is an ordinary shuffled join,
    in which no key has more than ``heavy`` rows. Both inputs should be settled.
    """
    hot, rest = table.where(F.col("_n") > heavy), table.where(F.col("_n") <= heavy)
    if hot.isEmpty():
        return rows.join(table.drop("_n").hint("merge"), keys)
    known = F.broadcast(hot.drop("_n"))
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.drop("_n").hint("merge"), keys)
    return rows.join(known, keys).unionByName(cool)


def heavy_count(total: int, least: int = 1_000) -> int:
    """Rows over which a key of ``total`` rows is heavy, so that at most 1,000 keys are."""
    return max(least, -(-total // 1_000))
