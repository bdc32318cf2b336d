"""Synthetic inputs: strokes, quotas, layouts and labels; seeded, alike in distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K

#: A stroke's pixel at t of 0..1 within the unit square, by name.
CURVES = {
    "línea_vertical": lambda t: (t, F.lit(0.5)),
    "línea_horizontal": lambda t: (F.lit(0.5), t),
    "línea_oblicua_derecha": lambda t: (1 - t, t),
    "línea_oblicua_izquierda": lambda t: (t, t),
    "curva": lambda t: (0.5 + 0.25 * F.sin(t * 2 * math.pi), t),
    "círculo": lambda t: (0.5 + 0.5 * F.sin(t * 2 * math.pi), 0.5 + 0.5 * F.cos(t * 2 * math.pi)),
}


def strokes(spark: SparkSession, size: int = K.CANVAS, margin: int = 16, steps: int = 512) -> DataFrame:
    """(name, row, col): pixels of the six strokes."""
    t = spark.range(steps).select((F.col("id") / (steps - 1)).alias("t"))
    side = size - 2 * margin - 1
    out = None
    for name in K.STROKES:
        r, c = CURVES[name](F.col("t"))
        part = t.select(F.lit(name).alias("name"), (margin + F.round(r * side)).cast("int").alias("row"), (margin + F.round(c * side)).cast("int").alias("col")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def images_per_class(missing: Column, report: Column | None = None, many: int = 200, few: int = 10, unknown: int = 80) -> Column:
    """More pictures for a class that no source has; a fixed number without a report."""
    count = F.when(missing, many).otherwise(few)
    return F.when(report, count).otherwise(unknown) if report is not None else count


def negatives(missing: Column, total: Column, per_missing: int = 50, per_existing: int = 20, unknown: int = 100) -> Column:
    """Pictures without characters, by how many classes are missing; fixed without a report."""
    return F.when(total.isNull(), unknown).otherwise(missing * per_missing + F.greatest(total - missing, F.lit(0)) * per_existing)


def layouts(spark: SparkSession, n: int, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """(id, layout): n draws of a layout by weight; the same seed gives the same draws."""
    total, upto, pick = sum(weights.values()), 0.0, F.lit(None).cast("string")
    rows = spark.range(n).withColumn("x", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    for name, weight in weights.items():
        lower, upto = upto, upto + weight / total
        pick = F.when((F.col("x") >= lower) & (F.col("x") < upto), name).otherwise(pick)
    last = list(weights)[-1]
    return rows.select("id", F.coalesce(pick, F.lit(last)).alias("layout"))


def place_rows(items: DataFrame, width: int, gap: int = 8) -> DataFrame:
    """Items (canvas, ord, w, h) set side by side into rows of a canvas: adds x1, y1, x2, y2.

    A fold over each canvas' items: the next stands right of the last, or starts a row
    under the highest so far.
    """
    packed = items.groupBy("canvas").agg(F.sort_array(F.collect_list(F.struct("ord", "w", "h"))).alias("items"))
    boxes = "array<struct<ord:int,x1:int,y1:int,x2:int,y2:int>>"
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("high"), F.array().cast(boxes).alias("out"))

    def step(s: Column, it: Column) -> Column:
        wrap = (s["x"] > 0) & (s["x"] + it["w"] > width)
        x, y = F.when(wrap, 0).otherwise(s["x"]), F.when(wrap, s["y"] + s["high"] + gap).otherwise(s["y"])
        high = F.when(wrap, it["h"]).otherwise(F.greatest(s["high"], it["h"]))
        box = F.struct(it["ord"].cast("int").alias("ord"), x.alias("x1"), y.alias("y1"), (x + it["w"]).cast("int").alias("x2"), (y + it["h"]).cast("int").alias("y2"))
        return F.struct((x + it["w"] + gap).cast("int").alias("x"), y.cast("int").alias("y"), high.cast("int").alias("high"), F.concat(s["out"], F.array(box)).cast(boxes).alias("out"))

    placed = F.aggregate("items", start, step, lambda s: s["out"])
    return packed.select("canvas", F.explode(placed).alias("b")).select("canvas", "b.*")


def early_stop(history: DataFrame, patience: int, epoch: str = "epoch", score: str = "score") -> DataFrame:
    """Training history with the best score so far, epochs since, and whether it would stop.

    One history's epochs are ordered in one task; histories are short.
    """
    w = Window.partitionBy("run").orderBy(epoch)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = history.withColumn("best", best).withColumn("_at", F.when(F.col(score) > F.coalesce(F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))), F.col(epoch)))
    rows = rows.withColumn("since", F.col(epoch) - F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("stop", F.col("since") >= patience).drop("_at")


def focal_loss(p_true: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """-(1 - p)^gamma ln p of the true class's probability, times a class weight."""
    loss = -F.pow(1 - p_true, F.lit(gamma)) * F.log(F.greatest(p_true, F.lit(1e-12)))
    return loss * weight if weight is not None else loss
