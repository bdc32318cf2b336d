"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are the rows of equal key. Groups of at least one ``grain``-th of a shard are
items of their own, of which there are at most shards x grain; the smaller ones are
dealt by a hash into as many parcels, each again an item. Items are packed largest
first, each into the bin with the least room that still holds it, found in a balanced
tree of the bins' remaining room.

A given number of shards is packed on the driver, whose items that number bounds. Shards of
a given capacity grow with the table: beyond ``REGION`` of them, groups are dealt by a hash
into regions of about that many, each packed in a task of its own, at the cost of one
shard in each region that isn't full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_count, join_counted, settle, text_or_empty

#: Shards of a region, where the capacity is given.
REGION = 64


class RoomTree:
    """AA tree of (room, bin): finds the least room of at least a given size in log time."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.left, self.right, self.level = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.level == t.right.right.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return self._Node(key)
            if key < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def take(t, key):
            if t is None:
                raise KeyError(key)
            if key < t.key:
                t.left = take(t.left, key)
            elif key > t.key:
                t.right = take(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                after = t.right
                while after.left:
                    after = after.left
                t.key, t.right = after.key, take(t.right, after.key)
            level = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
            if level < t.level:
                t.level = level
                if t.right and t.right.level > level:
                    t.right.level = level
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = take(self.root, key)

    def tightest(self, size):
        """The least (room, bin) with room >= size, or None."""
        t, found = self.root, None
        while t:
            if t.key[0] >= size:
                found, t = t.key, t.left
            else:
                t = t.right
        return found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item. A new bin opens only when no open bin has room.

    An item over the capacity gets a bin of its own.
    """
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if found := tree.tightest(sizes[i]):
            tree.remove(found)
            room, place = found
        else:
            room, place, bins = max(capacity, sizes[i]), bins, bins + 1
        out[i] = place
        tree.insert((room - sizes[i], place))
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing into ``bins`` bins, near equal but for items that can't be.

    An item over the mean of what is left gets a bin of its own, largest first, so that its
    size isn't the capacity of the others. The rest go by the least capacity (by bisection)
    that needs the other bins at most. No bin stays empty if there are items enough.
    """
    if not sizes:
        return []
    out, order, left, alone = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sum(sizes), 0
    while alone < len(order) and sizes[order[alone]] * (bins - alone) > left:
        left -= sizes[order[alone]]
        out[order[alone]] = alone
        alone += 1
    rest, room = order[alone:], bins - alone
    if not rest:
        return out
    few = [sizes[i] for i in rest]
    low = max(few[0], -(-left // room))
    high = 2 * low
    while low < high:
        middle = (low + high) // 2
        if max(best_fit_decreasing(few, middle)) < room:
            high = middle
        else:
            low = middle + 1
    held: list[list[int]] = [[] for _ in range(room)]
    for i, b in zip(rest, best_fit_decreasing(few, low), strict=True):
        held[b].append(i)
    for b in range(room):
        if not held[b] and (several := [x for x in held if len(x) > 1]):
            full = max(several, key=lambda x: sum(sizes[i] for i in x))
            held[b], full[:] = full[1::2], full[::2]
    for b, items in enumerate(held):
        for i in items:
            out[i] = alone + b
    return out


def assign_shards(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, grain: int = 256, cell_rows: int = 2_000, region: int = REGION) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Give either ``shards`` (their sizes come out near equal, but for a group over the mean
    of what is left, which has a shard to itself) or ``capacity`` in bytes
    (the fewest shards that best fit finds, in each ``region`` of them; a group over it gets
    its own). Size is the UTF-8 bytes of the text plus ``overhead``; a null text counts as empty. Rows of equal
    text stay together. Slots run from 0 without gaps in each shard, in an order that
    depends on the rows alone. An empty table gives an empty result; a null id is kept.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = text_or_empty(text_col)
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        )
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = shards or max(1, -(-total // capacity))
    regions = 1 if shards else -(-bins // region)
    parcels = min(bins, region) * grain if regions > 1 else bins * grain
    least = max(1, total // (regions * parcels))
    groups = settle(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    near = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(regions)).cast("int")
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels)).cast("int")
    big = groups.where(F.col("bytes") >= least).select(near.alias("region"), F.lit(-1).alias("parcel"), "group", "bytes", "n")
    small = groups.where(F.col("bytes") < least).groupBy(near.alias("region"), parcel.alias("parcel")).agg(F.lit(None).cast("binary").alias("group"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    items = big.unionByName(small.select("region", "parcel", "group", "bytes", "n"))

    def packed(found: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(found)), key=lambda i: (-found["bytes"].iat[i], found["parcel"].iat[i], bytes(found["group"].iat[i] or b"")))
        found = found.iloc[order].reset_index(drop=True)
        sizes = [int(x) for x in found["bytes"]]
        where = pack_into(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
        return found.assign(item=range(len(found)), shard=where, cells=[-(-int(n) // cell_rows) for n in found["n"]])

    schema = "region int, parcel int, group binary, bytes long, n long, item int, shard int, cells long"
    spark = docs.sparkSession
    place = F.struct("item", "shard", "cells").alias("p")
    rows = rows.withColumns({"region": near, "parcel": parcel})
    if regions == 1:
        table = packed(items.toPandas())
        named = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), schema)
        # At most 2 x bins x grain rows, which the parameters fix.
        large = F.broadcast(named.where("parcel < 0").select("group", place))
        other = F.broadcast(named.where("parcel >= 0").select("parcel", F.col("item").alias("i"), F.col("shard").alias("s"), F.col("cells").alias("c")))
        both = rows.join(large, "group", "left").join(other, "parcel", "left")
        placed = both.withColumn("p", F.coalesce("p", F.struct(F.col("i").alias("item"), F.col("s").alias("shard"), F.col("c").alias("cells"))))
    else:
        named = settle(items.groupBy("region").applyInPandas(packed, schema))
        # One row for each region: before it stand the shards of the earlier ones.
        counts = named.groupBy("region").agg((F.max("shard") + 1).alias("n")).orderBy("region").collect()
        first, upto = [], 0
        for r in counts:
            first.append((r["region"], upto))
            upto += r["n"]
        named = settle(named.join(F.broadcast(spark.createDataFrame(first, "region int, first int")), "region").withColumn("shard", F.col("shard") + F.col("first")))
        heavy = heavy_count(rows.count())
        large = settle(named.where("parcel < 0").select("group", place, F.col("n").alias("_n")))
        hot = F.broadcast(large.where(F.col("_n") > heavy).select("group"))
        alone = rows.join(hot, "group", "left_anti").join(large.where(F.col("_n") <= heavy).select("group").hint("merge"), "group", "left_anti")
        parcels_of = settle(named.where("parcel >= 0").select("region", "parcel", place, F.col("n").alias("_n")))
        known = join_counted(rows, large, ["group"], heavy)
        placed = known.select(*rows.columns, "p").unionByName(join_counted(alone, parcels_of, ["region", "parcel"], heavy).select(*rows.columns, "p"))
    placed = placed.select("doc_id", "size", "text_crc32", "group", "p.item", "p.shard", "p.cells")
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "group"), "cells"))
    heads = celled.groupBy("shard", "item", "cell").agg(F.count("*").alias("n"))
    along = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "item", "cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("head"))
    inside = Window.partitionBy("shard", "item", "cell").orderBy("doc_id", "group")
    numbered = celled.withColumn("at", F.row_number().over(inside) - 1).join(heads, ["shard", "item", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("head") + F.col("at")).cast("long").alias("slot"))
