"""Dataset building: union, duplicates, coverage, quotas, splits, weights, sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of all parts, each with the name of its part as ``source``."""
    out = None
    for name, part in parts.items():
        named = part.withColumn("source", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, with the group's size.

    By an aggregate that keeps one row per key and task, so that a key with very many
    rows is reduced before the shuffle.
    """
    packed = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"), F.count("*").alias("copies"))
    return packed.select("_r.*", "copies")


def in_range(df: DataFrame, label: str, idx: str, classes: int) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(idx).between(0, classes - 1))


def universe(spark: SparkSession, classes: int, name: str = "cls") -> DataFrame:
    return spark.range(classes).select(F.col("id").cast("int").alias(name))


def coverage(samples: DataFrame, classes: int) -> DataFrame:
    """Per source: covered and missing classes, percentage and the sorted missing ones."""
    spark = samples.sparkSession
    have = samples.select("source", "cls").distinct()
    every = have.select("source").distinct().crossJoin(F.broadcast(universe(spark, classes)))
    missing = every.join(have, ["source", "cls"], "left_anti")
    n = have.where(F.col("cls").between(0, classes - 1)).groupBy("source").agg(F.count("*").alias("covered"))
    gone = missing.groupBy("source").agg(F.sort_array(F.collect_list("cls")).alias("missing"))
    out = n.join(gone, "source", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<int>")))
    return out.withColumn("pct", F.round(100.0 * F.col("covered") / classes, 2))


def missing_everywhere(samples: DataFrame, classes: int) -> DataFrame:
    """Classes that no source has."""
    return universe(samples.sparkSession, classes).join(samples.select("cls").distinct(), "cls", "left_anti")


def cap(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, a feature of dataset building."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def stratified_split(df: DataFrame, by: list[str], order: list[Column], train: int = 70, val: int = 15) -> DataFrame:
    """``split`` of each row: the first 70 % of its group, then 15 %, then the rest."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    upto = lambda share: F.col("_i") * 100 <= F.col("_n") * share
    return rows.withColumn("split", F.when(upto(train), "train").when(upto(train + val), "val").otherwise("test")).drop("_i", "_n")


def random_split(df: DataFrame, key: str, val_percent: int = 20, seed: int = 42) -> DataFrame:
    """``split`` by a hash of the key: no shuffle, and the same row always falls alike."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < val_percent, "val").otherwise("train"))


def frequent(df: DataFrame, cls: str, least: int) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bincount(df: DataFrame, cls: str, classes: int, least: int = 1) -> DataFrame:
    """Count of each class 0..classes-1, at least ``least`` where there is none."""
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    return universe(df.sparkSession, classes, cls).join(counts, cls, "left").select(cls, F.greatest(F.coalesce("n", F.lit(0)), F.lit(least)).alias("n"))


def sample_weights(df: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """Inverse class frequency times the source's multiplier (1 by default), adding up to N."""
    counts = df.groupBy("cls").agg(F.count("*").alias("_n"))
    per = F.create_map(*[x for k, v in multipliers.items() for x in (F.lit(k), F.lit(float(v)))]).cast("map<string,double>")
    rows = df.join(counts, "cls").withColumn("_w", F.coalesce(per[F.col("source")], F.lit(1.0)) / F.col("_n"))
    total = rows.agg(F.sum("_w").alias("_t"), F.count("*").alias("_c"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_w") / F.col("_t") * F.col("_c")).drop("_n", "_w", "_t", "_c")


def effective_weights(counts: DataFrame, beta: float = 0.999, raised: Column | None = None, factor: float = 1.5) -> DataFrame:
    """(1 - beta) / (1 - beta^n) over its mean, times the factor where ``raised`` holds."""
    raw = (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.col("n").cast("double")))
    rows = counts.withColumn("_raw", raw)
    mean = rows.agg(F.avg("_raw").alias("_mean"))
    weight = F.col("_raw") / F.col("_mean")
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.when(raised, weight * factor).otherwise(weight) if raised is not None else weight).drop("_raw", "_mean")


def quota(counts: DataFrame, stroke: Column, enough: int = 100, none: int = 300, strokes: int = 200) -> DataFrame:
    """Samples to make for each class: strokes up to their number; ``none`` for a class
    without any; what is missing to ``enough``; otherwise 0."""
    n = F.coalesce(F.col("n"), F.lit(0))
    return counts.withColumn("make", F.when(stroke, F.greatest(F.lit(strokes) - n, F.lit(0))).when(n == 0, F.lit(none)).when(n < enough, F.lit(enough) - n).otherwise(0))


#: Rows of a cell of the weighted draw, and cells at most, whose sums go to the driver.
CELL_ROWS, MOST_CELLS = 1_000, 1 << 17


def weighted_sample(df: DataFrame, weight: str, draws: int, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``draws`` rows with replacement in proportion to ``weight``, numbered by ``draw``.

    Weights are summed within hash cells of about ``cell_rows`` rows, then over the cells. A
    draw is a point of [0, total) by a hash of its number, so the same on any cluster; it is
    joined to its cell, found by bisection, and to the row whose range holds it. Null and
    negative weights count as 0; without any weight there are no draws.
    """
    spark = df.sparkSession
    columns = df.columns
    cells = min(max(1, df.count() // cell_rows), MOST_CELLS)
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("_w", own).where("_w > 0").withColumn("_cell", F.pmod(F.xxhash64(*columns), F.lit(cells)).cast("int"))
    within = Window.partitionBy("_cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum("_w").over(within)).withColumn("_from", F.lag("_to", 1, 0.0).over(Window.partitionBy("_cell").orderBy(*columns)))
    # A cell's sum is its last row's edge, to the last bit, so no point falls between two rows.
    sums = rows.groupBy("_cell").agg(F.max("_to").alias("_s")).orderBy("_cell").collect()
    if not sums:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), *columns)
    edges = np.cumsum([0.0] + [r["_s"] for r in sums])
    names, widths = np.array([r["_cell"] for r in sums]), np.array([r["_s"] for r in sums])

    @F.pandas_udf("cell int, y double")
    def place(x: pd.Series) -> pd.DataFrame:
        point = x.to_numpy() * edges[-1]
        at = np.clip(np.searchsorted(edges, point, side="right") - 1, 0, len(names) - 1)
        return pd.DataFrame({"cell": names[at].astype("int32"), "y": np.minimum(point - edges[at], np.nextafter(widths[at], 0))})

    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)
    points = spark.range(draws).select(F.col("id").alias("draw"), place(unit).alias("_p")).select("draw", "_p.cell", "_p.y")
    hit = points.join(rows, (F.col("cell") == F.col("_cell")) & (F.col("y") >= F.col("_from")) & (F.col("y") < F.col("_to")))
    return hit.select("draw", *columns)
