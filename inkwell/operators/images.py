"""Image statistics over pixel rows (img, row, col, v) and the rules that follow from them.

What needs more of an image than sums sees it gathered: one row (img, pixels), so pixels are
never joined to pixels, whose size Spark underestimates. An image's pixels lie within its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXELS = "array<struct<row:int,col:int,v:int>>"
#: Images looked at together.
TOGETHER = 256


def gather(pixels: DataFrame) -> DataFrame:
    """(img, pixels): one row per image, for images that have a number."""
    rows = pixels.where(F.col("img").isNotNull()).groupBy("img")
    return rows.agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("row", "col", "v")])).alias("pixels"))


def _some(array: pa.Array):
    """A few images at a time: sizes, and rows, columns and values one after the other."""
    for at in range(0, len(array), TOGETHER):
        part = array.slice(at, TOGETHER)
        sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield sizes, *(pc.fill_null(f, 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in part.flatten().flatten())


SUMS = ("pixels", "s_lap", "q_lap", "s_v", "q_v", "dark", "outer", "middle")


def _laplacians(sizes: np.ndarray, row: np.ndarray, col: np.ndarray, v: np.ndarray, size: int):
    """Image, value and 4-neighbour Laplacian of each pixel that has a neighbour. Copies of a
    pixel are one, whose neighbours count once for each."""
    cell = (np.repeat(np.arange(len(sizes)), sizes) * size + row) * size + col
    total = np.bincount(cell, v, len(sizes) * size * size).astype(np.int64).reshape(-1, size, size)
    there = np.bincount(cell, minlength=total.size).reshape(total.shape)
    near = lambda x: (lambda p: p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:])(np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect" if size > 1 else "edge"))
    around, known = near(total).ravel(), near(there).ravel()
    copies = 1
    if there.max(initial=0) > 1:
        (cell, v), copies = np.unique(np.stack([cell, v]), axis=1, return_counts=True)
    keep = known[cell] > 0
    lap = copies * around[cell] - 4 * v
    return cell[keep] // (size * size), v[keep], lap[keep]


def quality(pixels: DataFrame, size: int) -> DataFrame:
    """Per image: blur (variance of the 4-neighbour Laplacian, edges reflected), contrast,
    brightness, ink share, histogram shares and flags."""
    return quality_of(gather(pixels), size)


def quality_of(images: DataFrame, size: int) -> DataFrame:
    """``quality`` of gathered images."""

    @F.arrow_udf(", ".join(f"{n} long" for n in SUMS))
    def run(array: pa.Array) -> pa.Array:
        found = [[np.zeros(0, np.int64)] * len(SUMS)]
        for sizes, row, col, v in _some(array):
            of, v, lap = _laplacians(sizes, row, col, v, size)
            add = lambda x: np.bincount(of, x, len(sizes)).astype(np.int64)  # noqa: E731, B023
            found.append([np.bincount(of, minlength=len(sizes)), add(lap), add(lap * lap), add(v), add(v * v), add(v < 128), add((v < 30) | (v >= 230)), add((v >= 40) & (v < 220))])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], list(SUMS))

    n, c = F.col("pixels"), F.col
    var = lambda s, q: c(q).cast("double") / n - (c(s) / n) * (c(s) / n)
    return images.select("img", run("pixels").alias("s")).select("img", "s.*").where("pixels > 0").select(
        "img",
        n.alias("pixels"),
        var("s_lap", "q_lap").alias("blur"),
        F.sqrt(var("s_v", "q_v")).alias("contrast"),
        (c("s_v") / n).alias("brightness"),
        (c("dark") / n).alias("ink_ratio"),
        (c("outer") / n).alias("extremes"),
        (c("middle") / n).alias("midtones"),
    )


def _percentiles(v: np.ndarray, sizes: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Percentiles of each image's values, between two of them in proportion; NaN if there are none."""
    v = v[np.lexsort((v, np.repeat(np.arange(len(sizes)), sizes)))]
    start, out = np.cumsum(sizes) - sizes, np.full((len(shares), len(sizes)), np.nan)
    some = sizes > 0
    for k, share in enumerate(shares):
        at = (sizes[some] - 1) * share
        lower, upper = np.floor(at), np.ceil(at)
        low, high = (v[start[some] + i.astype(np.int64)].astype(float) for i in (lower, upper))
        out[k, some] = np.where(low == high, low, (upper - at) * low + (at - lower) * high)
    return out

def is_digital() -> Column:
    """Rendered rather than photographed, by blur, contrast and histogram."""
    c = F.col
    return (c("blur") >= 3000) & (((c("extremes") > 0.65) & (c("midtones") < 0.10)) | ((c("contrast") > 90) & (c("midtones") < 0.08)))


def odd(n: Column) -> Column:
    return F.greatest(F.lit(3), n + (1 - n % 2))


def pipeline_params(q: DataFrame, side: Column) -> DataFrame:
    """Adaptive parameters of each image from its flags; rendered images get the least."""
    c = F.col
    digital, shadow, dark = c("is_digital"), c("has_shadow"), c("is_dark")
    low, over, blurry = c("is_low_contrast"), c("is_overexposed"), c("is_blurry")
    base = F.greatest(F.lit(3), F.floor(side * 0.08).cast("int"))
    block = odd(F.when(shadow, F.floor(base * 1.5).cast("int")).otherwise(base))
    pick = lambda digital_value, other: F.when(digital, F.lit(digital_value)).otherwise(other)
    return q.withColumns(
        {
            "block_size": pick(11, block),
            "adaptive_c": pick(2, F.when(low | dark, 4).when(shadow, 3).otherwise(2)),
            "morph_k": pick(1, F.greatest(F.lit(1), F.floor(side * 0.018).cast("int"))),
            "clahe_clip": pick(1.0, F.when(dark | low, 5.0).when(over, 1.5).when(shadow, 4.0).otherwise(3.0)),
            "clahe_tile": pick(8, F.greatest(F.lit(2), F.least(F.lit(8), F.floor(side / 16).cast("int")))),
            "use_bg_division": pick(False, shadow | dark),
            "bg_blur_k": pick(31, odd(F.greatest(F.lit(31), F.floor(side / 3).cast("int")))),
            "use_otsu": pick(True, (c("contrast") >= 35.0) & ~shadow & ~dark & ~over),
            "canny_low": pick(30, F.when(blurry | low, 15).when(dark, 20).otherwise(30)),
            "canny_high": pick(120, F.when(blurry | low, 60).when(dark, 80).otherwise(120)),
            "skip_illumination": digital,
            "speck_min_area": pick(5, F.greatest(F.lit(10), F.floor(side * side * 0.0008).cast("int"))),
        }
    )


def otsu(pixels: DataFrame) -> DataFrame:
    """Threshold of the largest between-class variance per image, the smallest of equals."""
    w = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    h = pixels.groupBy("img", "v").agg(F.count("*").alias("n"))
    h = h.withColumn("n0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(w))
    h = h.withColumn("nn", F.sum("n").over(whole)).withColumn("ss", F.sum(F.col("n") * F.col("v")).over(whole))
    n1, c = F.col("nn") - F.col("n0"), F.col
    gap = (c("s0") * c("nn") - c("ss") * c("n0")).cast("double")
    between = F.when(n1 > 0, gap * gap / (c("n0").cast("double") * n1.cast("double"))).otherwise(-1.0)
    return h.withColumn("between", between).groupBy("img").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"), F.max("between").alias("between"))


def percentile_threshold(pixels: DataFrame, share: float = 0.45) -> DataFrame:
    """p10 + share x (p90 - p10) per image, and the pixels under it."""
    return percentile_threshold_of(gather(pixels), share)


def percentile_threshold_of(images: DataFrame, share: float = 0.45) -> DataFrame:
    """``percentile_threshold`` of gathered images."""
    names = ["p10", "p90", "threshold", "ink"]

    @F.arrow_udf("p10 double, p90 double, threshold double, ink long")
    def run(array: pa.Array) -> pa.Array:
        found = [[np.zeros(0)] * len(names)]
        for sizes, _, _, v in _some(array):
            low, high = _percentiles(v, sizes, (0.1, 0.9))
            threshold = low + share * (high - low)
            of = np.repeat(np.arange(len(sizes)), sizes)
            found.append([low, high, threshold, np.bincount(of[v < threshold[of]], minlength=len(sizes))])
        kinds = [pa.float64()] * 3 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return images.where(F.size("pixels") > 0).select("img", run("pixels").alias("s")).select("img", "s.*")


def polarity(pixels: DataFrame, size: int) -> DataFrame:
    """dark_on_light, light_on_dark or ambiguous, from border and overall means; a corner
    pixel counts once for each of the two edges it lies on."""
    edge = lambda c: ((F.col(c) < 2).cast("int") + (F.col(c) >= size - 2).cast("int"))
    times = edge("row") + edge("col")
    agg = pixels.groupBy("img").agg((F.sum(F.col("v") * times) / F.sum(times)).alias("border"), (F.sum("v") / F.count("*")).alias("overall"))
    b, o = F.col("border"), F.col("overall")
    rule = F.when((o > 170) & (b > 180), "dark_on_light").when((o < 80) & (b < 60), "light_on_dark").when((b > o + 30) & (b > 150), "dark_on_light").when((b < o - 30) & (b < 100), "light_on_dark").otherwise("ambiguous")
    return agg.withColumn("polarity", F.lit("ambiguous") if size < 8 else rule)


def whiten(pixels: DataFrame, target: float = 245.0) -> DataFrame:
    """Values scaled so that the 90th percentile meets ``target``; images with p90 - p10
    under 30 are left alone."""
    return whiten_of(gather(pixels), target)


def whiten_of(images: DataFrame, target: float = 245.0) -> DataFrame:
    """``whiten`` of gathered images: a row for each pixel."""

    @F.arrow_udf(PIXELS)
    def run(array: pa.Array) -> pa.Array:
        parts = [np.zeros(0, np.int64)]
        for sizes, _, _, v in _some(array):
            low, high = _percentiles(v, sizes, (0.1, 0.9))
            of = np.repeat(np.arange(len(sizes)), sizes)
            scaled = np.minimum(255, np.floor(v * target / np.maximum(high, 1.0)[of])).astype(np.int64)
            parts.append(np.where((high - low < 30)[of], v, scaled))
        sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        row, col, _ = array.flatten().flatten()
        rows = pa.StructArray.from_arrays([row, col, pa.array(np.concatenate(parts), pa.int32())], ["row", "col", "v"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows)

    return images.select("img", F.inline(run("pixels")))


def transpose_flip(pixels: DataFrame) -> DataFrame:
    """Orientation of scanned digits: rows and columns exchanged and values inverted."""
    return pixels.select("img", F.col("col").alias("row"), F.col("row").alias("col"), (255 - F.col("v")).alias("v"))


def degenerate(pixels: DataFrame, expected: DataFrame, least_spread: float = 5.0, least_mean: float = 5.0) -> DataFrame:
    """Images to leave out with the first reason that fits: unreadable (no pixels), flat, dark."""
    stats = pixels.groupBy("img").agg(F.stddev_pop("v").alias("spread"), F.avg("v").alias("mean"))
    rows = expected.join(stats, "img", "left")
    reason = F.when(F.col("mean").isNull(), "unreadable").when(F.col("spread") < least_spread, "flat").when(F.col("mean") < least_mean, "dark")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("img", "reason")
