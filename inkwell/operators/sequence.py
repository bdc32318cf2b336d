"""Ordered point sequences of glyphs: angular order, resampling, Procrustes, DTW, cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import batch


def angular_order(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with ``ord`` from 0 by the angle around the centroid, then row and column.

    The angle is taken between whole numbers, n x pixel less the sum, which has the same
    order as between the pixel and the mean but no rounding.
    """
    w = Window.partitionBy(*keys)
    n, sr, sc = F.count("*").over(w), F.sum("row").over(w), F.sum("col").over(w)
    angle = F.atan2((n * F.col("row") - sr).cast("double"), (n * F.col("col") - sc).cast("double"))
    rows = pixels.withColumn("angle", angle).withColumn("n", n)
    return rows.withColumn("ord", F.row_number().over(w.orderBy("angle", "row", "col")) - 1).drop("angle")


# Sequences of gathered glyphs (keys, a): a glyph's pixels lie in one row, so nothing is
# sorted, joined or shuffled by the pixel ------------------------------------------------


def ordered_column(pixels: Column | str = "a", most: int | None = None) -> Column:
    """An array's pixels in the order of ``angular_order``, those without place last; at most
    ``most`` of them, as ``subsample`` takes them."""

    @F.arrow_udf("array<struct<row:int,col:int>>")
    def run(a: pa.Array) -> pa.Array:
        (row, col), known, sizes = batch.listed(a)
        p = batch.Points(row, col, sizes)
        at = batch.angular(p, known)
        if most is not None:
            places, sizes = batch.even_places(sizes, most)
            at = at[places + np.repeat(p.starts, sizes)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), a.flatten().take(pa.array(at)))

    return run(pixels)


def ordered_rows(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """``angular_order`` of gathered glyphs: a row for each pixel."""
    rows = glyphs.select(*keys, F.size("a").cast("long").alias("n"), F.posexplode(ordered_column()).alias("ord", "q"))
    return rows.select(*keys, "q.row", "q.col", "n", "ord")


def subsampled_rows(glyphs: DataFrame, keys: list[str], most: int = K.TRAJECTORY_POINTS) -> DataFrame:
    """``subsample`` of gathered glyphs."""
    rows = glyphs.select(*keys, F.posexplode(ordered_column("a", most)).alias("ord", "q"))
    return rows.select(*keys, "ord", "q.row", "q.col")


def resampled_rows(glyphs: DataFrame, keys: list[str], n: int = K.PROCRUSTES_POINTS) -> DataFrame:
    """``resample`` of gathered glyphs."""

    @F.arrow_udf("array<struct<row:double,col:double>>")
    def run(a: pa.Array) -> pa.Array:
        at, usable = batch.along_curves(batch.by_angle(batch.points(a, canvas=False)), n)
        flat = at[usable].reshape(-1, 2)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["row", "col"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(usable * n)]), pa.int32()), rows)

    rows = glyphs.select(*keys, F.posexplode(run("a")).alias("ord", "q"))
    return rows.select(*keys, F.col("ord").cast("long").alias("ord"), "q.row", "q.col")


def disparity_column(a: Column | str = "a", p: Column | str = "p", n: int = K.PROCRUSTES_POINTS) -> Column:
    """``procrustes`` of gathered glyphs, null where one of them has no length."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        (u, one), (v, two) = (batch.along_curves(batch.by_angle(batch.points(z, canvas=False)), n) for z in (x, y))
        return pa.array(batch.disparities(u, v), pa.float64(), mask=~(one & two))

    return run(a, p)


def cosine_column(a: Column | str = "a", p: Column | str = "p") -> Column:
    """Mean cosine of paired segment vectors of gathered glyphs; null where there are none."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        mean = batch.mean_cosines(*(batch.by_angle(batch.points(z, canvas=False)) for z in (x, y)))
        return pa.array(mean, pa.float64(), mask=np.isnan(mean))

    return run(a, p)


def dtw_column(p: Column | str = "p", a: Column | str = "a", most: int = K.TRAJECTORY_POINTS) -> Column:
    """Banded DTW of gathered glyphs, ordered by angle and thinned out to ``most`` points."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (batch.evenly(batch.by_angle(batch.points(z, canvas=False)), most) for z in (x, y))
        return pa.array(batch.banded_dtw(left, right), pa.float64())

    return run(p, a)


# The same of rows of pixels --------------------------------------------------------------


def subsample(ordered: DataFrame, keys: list[str], most: int = K.TRAJECTORY_POINTS) -> DataFrame:
    """At most ``most`` points of each sequence, evenly by position, first and last included."""
    at = F.floor(F.col("i") * (F.col("n") - 1) / (most - 1))
    marks = ordered.where("ord = 0").select(*keys, "n", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most)).cast("int") - 1)).alias("i"))
    marks = marks.select(*keys, "i", F.when(F.col("n") <= most, F.col("i").cast("long")).otherwise(at).alias("ord"))
    return marks.join(ordered, [*keys, "ord"]).select(*keys, F.col("i").alias("ord"), "row", "col", F.least(F.col("n"), F.lit(most)).alias("n"))


def resample(ordered: DataFrame, keys: list[str], n: int = K.PROCRUSTES_POINTS) -> DataFrame:
    """``n`` points along each closed curve. The step is total x (n - 1) / n^2, so that the
    last point stands before the end of the curve."""
    w = Window.partitionBy(*keys).orderBy("ord")
    whole = Window.partitionBy(*keys)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)).cast("double")
    seg = ordered.withColumn("row2", nxt("row")).withColumn("col2", nxt("col"))
    step = F.sqrt((F.col("row2") - F.col("row")) * (F.col("row2") - F.col("row")) + (F.col("col2") - F.col("col")) * (F.col("col2") - F.col("col")))
    seg = seg.withColumn("step", step)
    seg = seg.withColumn("upto", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.coalesce(F.lag("upto").over(w), F.lit(0.0)))
    seg = seg.withColumn("total", F.max("upto").over(whole)).withColumn("unit", F.col("total") * (n - 1) / n / n)
    # Each segment makes the targets that lie on it: those of index in [start, upto) / unit.
    first, last = F.ceil(F.col("start") / F.col("unit")), F.ceil(F.col("upto") / F.col("unit")) - 1
    seg = seg.where("unit > 0").withColumn("first", first).withColumn("last", F.least(last, F.lit(n - 1).cast("long")))
    pts = seg.where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("k"))
    share = (F.col("k") * F.col("unit") - F.col("start")) / (F.col("step") + 1e-9)
    pts = pts.withColumn("share", share)
    return pts.select(*keys, F.col("k").alias("ord"), ((1 - F.col("share")) * F.col("row") + F.col("share") * F.col("row2")).alias("row"), ((1 - F.col("share")) * F.col("col") + F.col("share") * F.col("col2")).alias("col"))


def procrustes(a: DataFrame, b: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Disparity of two resampled sequences by the closed form of two dimensions.

    With centred sets of unit norm and M = A'B, the squared sum of the singular values is
    |M|^2 + 2 |det M|, and the disparity is 1 less that.
    """
    both = a.join(b.select(*on, "ord", F.col("row").alias("r2"), F.col("col").alias("c2")), [*on, "ord"])
    s = lambda e: F.sum(e)
    c = F.col
    agg = both.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[s(c(x)).alias(f"s_{x}") for x in ("row", "col", "r2", "c2")],
        *[s(c(x) * c(y)).alias(f"m_{x}_{y}") for x, y in (("row", "row"), ("col", "col"), ("r2", "r2"), ("c2", "c2"), ("row", "r2"), ("row", "c2"), ("col", "r2"), ("col", "c2"))],
    )
    cov = lambda x, y: c(f"m_{x}_{y}") - c(f"s_{x}") * c(f"s_{y}") / c("n")
    na, nb = cov("row", "row") + cov("col", "col"), cov("r2", "r2") + cov("c2", "c2")
    frob = cov("row", "r2") ** 2 + cov("row", "c2") ** 2 + cov("col", "r2") ** 2 + cov("col", "c2") ** 2
    det = cov("row", "r2") * cov("col", "c2") - cov("row", "c2") * cov("col", "r2")
    disparity = F.when((c("n") < 3) | (na <= 0) | (nb <= 0), K.UNDEFINED).otherwise(1.0 - (frob + 2 * F.abs(det)) / (na * nb))
    out = agg.select(*keys, disparity.alias("disparity"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 100.0 - 50.0 * F.col("disparity")))


def segment_vectors(ordered: DataFrame, keys: list[str], segments: int = K.SEGMENTS) -> DataFrame:
    """Unit vectors (vr, vc) from first to last point of each equal run, numbered by ``seq``.

    A run is floor(n / segments) points; the rest at the end isn't used; runs without
    direction are left out and the others numbered on.
    """
    size = F.greatest(F.lit(1), F.floor(F.col("n") / segments)).cast("int")
    runs = ordered.withColumn("run", F.floor(F.col("ord") / size)).where(F.col("run") < segments)
    ends = runs.groupBy(*keys, "run").agg(F.min_by(F.struct("row", "col"), "ord").alias("a"), F.max_by(F.struct("row", "col"), "ord").alias("b"))
    dr, dc = F.col("b.row") - F.col("a.row"), F.col("b.col") - F.col("a.col")
    norm = F.sqrt((dr * dr + dc * dc).cast("double"))
    out = ends.withColumn("norm", norm).where("norm > 1e-9").select(*keys, "run", (dr / F.col("norm")).alias("vr"), (dc / F.col("norm")).alias("vc"))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("run")))


def segment_cosine(glyphs: DataFrame, student: DataFrame, template: DataFrame) -> DataFrame:
    """Mean cosine of paired segment vectors and its score; (0, 50) where there are none."""
    both = student.join(template.select("t", "seq", F.col("vr").alias("pr"), F.col("vc").alias("pc")), ["t", "seq"])
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("vr") * F.col("pr") + F.col("vc") * F.col("pc")))
    agg = both.groupBy("g").agg(F.avg(dot).alias("mean"))
    return glyphs.join(agg, "g", "left").select("g", F.coalesce("mean", F.lit(0.0)).alias("mean_cosine"), F.coalesce((F.col("mean") + 1) / 2 * 100, F.lit(50.0)).alias("score"))


# The same of one glyph at a time, for kernels that have its pixels at hand -----------


def by_angle(points: np.ndarray) -> np.ndarray:
    """Points in the order of ``angular_order``."""
    if not len(points):
        return points
    turned = len(points) * points - points.sum(axis=0)
    return points[np.lexsort((points[:, 1], points[:, 0], np.arctan2(turned[:, 0].astype(float), turned[:, 1].astype(float))))]


def evenly(ordered: np.ndarray, most: int = K.TRAJECTORY_POINTS) -> np.ndarray:
    n = len(ordered)
    return ordered if n <= most else ordered[np.arange(most) * (n - 1) // (most - 1)]


def along_curve(ordered: np.ndarray, n: int = K.PROCRUSTES_POINTS) -> np.ndarray:
    """``n`` points of the closed curve; none where it has no length."""
    here, there = ordered.astype(float), np.roll(ordered, -1, axis=0).astype(float)
    step = np.sqrt(((there - here) ** 2).sum(axis=1))
    upto = np.cumsum(step)
    if not len(upto) or upto[-1] <= 0:
        return np.zeros((0, 2))
    want = np.arange(n) * (upto[-1] * (n - 1) / n / n)
    at = np.minimum(np.searchsorted(upto, want, side="right"), len(upto) - 1)
    share = ((want - (upto[at] - step[at])) / (step[at] + 1e-9))[:, None]
    return (1 - share) * here[at] + share * there[at]


def disparity(a: np.ndarray, b: np.ndarray) -> float:
    """Procrustes disparity of two ordered glyphs; undefined under three points."""
    if min(len(a), len(b)) < 3:
        return K.UNDEFINED
    x, y = (z - z.mean(axis=0) if len(z) else z for z in (along_curve(a), along_curve(b)))
    size = (x * x).sum() * (y * y).sum() if len(x) and len(y) else 0.0
    if size <= 0:
        return K.UNDEFINED
    m = x.T @ y
    return float(1.0 - ((m * m).sum() + 2 * abs(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])) / size)


def directions(ordered: np.ndarray, segments: int = K.SEGMENTS) -> np.ndarray:
    """Unit vectors of the equal runs that have a direction."""
    size = max(1, len(ordered) // segments)
    runs = [ordered[at : at + size] for at in range(0, min(len(ordered), size * segments), size)]
    ends = np.array([run[-1] - run[0] for run in runs], float).reshape(-1, 2)
    norm = np.sqrt((ends**2).sum(axis=1))
    return ends[norm > 1e-9] / norm[norm > 1e-9, None]


def mean_cosine(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean cosine of paired runs of two ordered glyphs, None where there are none."""
    x, y = directions(a), directions(b)
    k = min(len(x), len(y))
    return float(np.clip((x[:k] * y[:k]).sum(axis=1), -1, 1).mean()) if k else None


def banded_dtw(p: np.ndarray, a: np.ndarray, band_ratio: float = K.BAND_RATIO) -> float:
    """Sakoe-Chiba banded DTW over the longer length; 999 if either is empty or no path ends."""
    return float(banded_dtw_batch(np.asarray(p, float)[None], np.asarray(a, float)[None], band_ratio)[0])


def banded_dtw_batch(p: np.ndarray, a: np.ndarray, band_ratio: float = K.BAND_RATIO) -> np.ndarray:
    """Banded DTW of pairs of equal lengths at once: (pairs, n, 2) against (pairs, m, 2).

    The cells are filled in the order of a single pair's; each step works on all pairs.
    """
    pairs, n, m = len(p), p.shape[1], a.shape[1]
    if not n or not m:
        return np.full(pairs, K.UNDEFINED)
    band, inf = max(1, int(max(n, m) * band_ratio)), 1e9
    cost = np.sqrt(((p[:, :, None] - a[:, None]) ** 2).sum(-1)).transpose(1, 2, 0).copy()
    # A border of infinity stands for the cells that don't exist.
    d = np.full((n + 1, m + 1, pairs), np.inf)
    for i in range(n):
        for j in range(max(0, i - band), min(m, i + band + 1)):
            least = np.minimum(np.minimum(d[i, j + 1], d[i + 1, j]), d[i, j])
            d[i + 1, j + 1] = cost[i, j] + (0.0 if i == j == 0 else np.where(np.isinf(least), inf, least))
    end = d[n, m]
    if np.isinf(end).all():
        end = np.minimum(d[n, 1:].min(axis=0), d[1:, m].min(axis=0))
    return np.where(end >= inf, K.UNDEFINED, end / max(n, m))


def banded_dtw_many(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Banded DTW of each pair; pairs of the same lengths are computed together."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (u, v) in enumerate(zip(left, right, strict=True)):
        shapes.setdefault((len(u), len(v)), []).append(i)
    out = np.empty(len(left))
    for rows in shapes.values():
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            out[part] = banded_dtw_batch(np.stack([left[i] for i in part]).astype(float), np.stack([right[i] for i in part]).astype(float))
    return out


def trajectory_column(p: Column, a: Column) -> Column:
    """Banded DTW of two arrays of points already ordered, in Arrow batches; pairs of the
    same lengths are computed together."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        points = lambda s: np.array([(q["row"], q["col"]) for q in s], float).reshape(-1, 2) if s is not None else np.zeros((0, 2))
        left, right = [points(s) for s in x], [points(s) for s in y]
        return pd.Series(banded_dtw_many(left, right))

    return run(p, a)


def as_array(ordered: DataFrame, keys: list[str], name: str) -> DataFrame:
    rows = ordered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "row", "col"))).alias("s"))
    return rows.select(*keys, F.transform("s", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))).alias(name))
