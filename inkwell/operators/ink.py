"""Ink metrics over pixel rows.

A glyph is a set of rows (row, col) of one key. Distances are computed on one row per
pair that holds both pixel arrays: a glyph has at most 128 x 128 pixels, so a row is
bounded, and one shuffle by the key is all there is. Kernels work on whole Arrow batches
(``batch``). Nearest pixels come from pairwise differences of small glyphs, and from a
distance map of larger ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import batch


def gather(pixels: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per glyph with its distinct pixels as a sorted array of structs."""
    return pixels.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")))).alias(name))


def pairs(student: DataFrame, template: DataFrame) -> DataFrame:
    """(g, t, a, p): each student glyph with its template's pixels, empty arrays if absent.

    Templates have one row each; they are a fixed alphabet, so Spark may broadcast them.
    """
    return pairs_of(gather(student, ["g", "t"], "a"), template)


def pairs_of(glyphs: DataFrame, template: DataFrame) -> DataFrame:
    """``pairs`` of student glyphs that are gathered already."""
    empty = F.array().cast("array<struct<row:int,col:int>>")
    joined = glyphs.join(gather(template, ["t"], "p"), "t", "left")
    return joined.withColumn("p", F.coalesce("p", empty))


def codes(pixels: Column | str) -> Column:
    """Pixels within the canvas as flat numbers."""
    c = F.col(pixels) if isinstance(pixels, str) else pixels
    inside = F.filter(c, lambda x: x["row"].between(0, K.CANVAS - 1) & x["col"].between(0, K.CANVAS - 1))
    return F.transform(inside, lambda x: x["row"] * K.CANVAS + x["col"])


def decoded(flat: Column) -> Column:
    """Flat numbers as pixels."""
    return F.transform(flat, lambda x: F.struct(F.floor(x / K.CANVAS).cast("int").alias("row"), (x % K.CANVAS).cast("int").alias("col")))


def _points(flat) -> np.ndarray:
    flat = np.asarray(flat if flat is not None else [], np.int64)
    return np.stack([flat // K.CANVAS, flat % K.CANVAS], axis=1)


def distance_map(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of every cell to the nearest set one; -1 if none is set.

    Distances along each row first, then the least over all columns.
    """
    if not mask.any():
        return np.full(mask.shape, -1, np.int64)
    h, w = mask.shape
    at = np.arange(w)
    far = 4 * (h + w)
    left = np.maximum.accumulate(np.where(mask, at, -far), axis=1)
    right = np.minimum.accumulate(np.where(mask, at, far)[:, ::-1], axis=1)[:, ::-1]
    across = np.minimum(at - left, right - at).astype(np.int64) ** 2
    down = (np.arange(h)[:, None] - np.arange(h)[None]) ** 2
    return np.min(down[:, :, None] + across[None], axis=1)


#: Pairs of pixels up to which nearest ones are found pair by pair.
PAIRWISE = 1 << 16


class _Nearest:
    """Squared distances to the nearest pixel of glyphs, whose maps are kept for a batch."""

    def __init__(self):
        self.maps: dict[bytes, np.ndarray] = {}

    def __call__(self, a, b) -> np.ndarray:
        x, y = _points(a), _points(b)
        if len(x) * len(y) <= PAIRWISE:
            return ((x[:, None] - y[None]) ** 2).sum(axis=2).min(axis=1) if len(y) else np.full(len(x), -1)
        key = np.asarray(b, np.int64).tobytes()
        if key not in self.maps:
            self.maps[key] = distance_map(grid(b))
        return self.maps[key][x[:, 0], x[:, 1]]


def distances_column(a: Column | str, b: Column | str) -> Column:
    """``there``: for each pixel of ``a`` on the canvas the squared distance to the nearest of
    ``b``; null if b is empty."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        p = batch.points(x)
        d2, _ = batch.nearest(p, batch.points(y))
        return batch.lists(pa.array(d2, pa.int32(), mask=d2 < 0), p.sizes, pa.int32())

    return run(a, b)


def errors_column(a: Column | str, p: Column | str, tolerance: dict[str, float]) -> Column:
    """For each tolerance the mean of what pixels of ``a`` lie further than it from ``p``, null
    if a has none on the canvas, and how many pixels of ``p`` an ellipse of radius
    max(1, int(tolerance)) around one of ``a`` hits."""
    values = [float(v) for v in tolerance.values()]

    @F.arrow_udf("array<struct<error:double,hits:int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        u, v = batch.points(x), batch.points(y)
        d2, _ = batch.nearest(u, v)
        d = np.sqrt(np.maximum(d2, 0).astype(float))
        total = np.stack([u.sums(np.maximum(0.0, d - t)) for t in values], axis=1)
        empty = np.repeat(u.sizes == 0, len(values))
        mean = (total / np.maximum(u.sizes, 1)[:, None]).ravel()
        hits = batch.covered(u, v, [max(1, int(t)) for t in values]).T.ravel()
        rows = pa.StructArray.from_arrays([pa.array(mean, pa.float64(), mask=empty), pa.array(hits, pa.int32())], ["error", "hits"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(mean) + 1, len(values)), pa.int32()), rows)

    return run(a, p)


def _widened(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask with an ellipse of the radius around every set cell."""
    h, w = mask.shape
    wide = np.pad(mask, radius)
    out = np.zeros_like(mask)
    half = K.ellipse_half_widths(radius)
    for dr in range(-radius, radius + 1):
        for dc in range(-half[abs(dr)], half[abs(dr)] + 1):
            out |= wide[radius + dr : radius + dr + h, radius + dc : radius + dc + w]
    return out


def fidelity(glyphs: DataFrame, tolerance: dict[str, float] | None = None) -> DataFrame:
    """Per glyph and level: mean_error, precision, coverage and the combined fidelity.

    An empty student glyph, or one without a template, scores 0 throughout.
    """
    tolerance = tolerance or K.TOLERANCE
    entries = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(v)).alias("tol")) for k, v in tolerance.items()])
    rows = glyphs.withColumn("_l", F.explode(F.arrays_zip(entries.alias("l"), errors_column("a", "p", tolerance).alias("e"))))
    usable = (F.size("a") > 0) & (F.size("p") > 0)
    out = rows.select(*glyphs.columns, F.col("_l.l.level").alias("level"), F.col("_l.l.tol").alias("tol"), F.when(usable, F.col("_l.e.error")).alias("mean_error"), F.col("_l.e.hits").alias("_h"))
    share = F.when(usable, F.col("_h") / F.size("p"))
    out = out.withColumn("coverage", F.coalesce(share, F.lit(0.0))).drop("_h")
    out = out.withColumn("precision", F.when(usable, F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("mean_error") / K.MAX_MEAN_ERROR))).otherwise(0.0))
    return out.withColumn("fidelity", K.WEIGHT_PRECISION * F.col("precision") + K.WEIGHT_COVERAGE * F.col("coverage") * 100.0)


def zones_column(a: Column | str, p: Column | str, tolerance: dict[str, float]) -> Column:
    """For each tolerance the pixels of ``a`` within it, within twice it, and beyond."""
    values = [float(v) for v in tolerance.values()]

    @F.arrow_udf("array<struct<inside:int,warning:int,outside:int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        u = batch.points(x)
        d2, _ = batch.nearest(u, batch.points(y))
        counts = []
        for t in values:
            zones = (d2 >= 0) & (d2 <= t * t), (d2 > t * t) & (d2 <= 4 * t * t), d2 > 4 * t * t
            counts.append([np.bincount(u.of[z], minlength=len(u)) for z in zones])
        fields = [pa.array(np.stack([c[k] for c in counts], axis=1).ravel(), pa.int32()) for k in range(3)]
        rows = pa.StructArray.from_arrays(fields, ["inside", "warning", "outside"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, len(values)), pa.int32()), rows)

    return run(a, p)


def heat_zones(glyphs: DataFrame) -> DataFrame:
    """Per glyph and level the student pixels within the tolerance, within twice it, beyond."""
    names = F.array(*[F.lit(k) for k in K.TOLERANCE])
    rows = glyphs.select("g", F.explode(F.arrays_zip(names.alias("level"), zones_column("a", "p", K.TOLERANCE).alias("z"))).alias("l"))
    return rows.select("g", "l.level", "l.z.*")


def hausdorff(glyphs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Symmetric Hausdorff distance (999 if either glyph is empty), its score, the older
    prototype's score and the mean nearest distance."""

    @F.arrow_udf("struct<far:int,mean:double>")
    def run(a: pa.Array, p: pa.Array) -> pa.Array:
        u, v = batch.points(a), batch.points(p)
        there, back = batch.nearest(u, v, back=True)
        far = np.maximum(batch.furthest(u, there), batch.furthest(v, back))
        mean = u.sums(np.sqrt(np.maximum(there, 0).astype(float))) / np.maximum(u.sizes, 1)
        none = (u.sizes == 0) | (v.sizes == 0)
        return pa.StructArray.from_arrays([pa.array(far, pa.int32(), mask=far < 0), pa.array(mean, pa.float64(), mask=none)], ["far", "mean"])

    usable = (F.size("a") > 0) & (F.size("p") > 0)
    rows = glyphs.withColumn("_d", run("a", "p"))
    rows = rows.withColumn("hausdorff", F.when(usable, F.sqrt(F.col("_d.far").cast("double"))).otherwise(K.UNDEFINED))
    score = F.greatest(F.lit(0.0), 100.0 - K.HAUSDORFF_FACTOR * F.greatest(F.lit(0.0), F.col("hausdorff") - K.HAUSDORFF_TOLERANCE))
    old = F.greatest(F.lit(0.0), 100.0 - 1.5 * F.col("hausdorff"))
    return rows.select("g", "t", "hausdorff", score.alias("score"), old.alias("prototype_score"), F.when(usable, F.col("_d.mean")).alias("mean_min_distance"), *(keep or []))


def overlay(glyphs: DataFrame) -> DataFrame:
    """Pixel counts only in the template, only in the student's ink, in both, and IoU x 100."""
    both = F.size(F.array_intersect("a", "p"))
    either = F.size(F.array_union("a", "p"))
    return glyphs.select("g", "t", (F.size("p") - both).alias("only_p"), (F.size("a") - both).alias("only_a"), both.alias("both"), F.when(either > 0, both * 100.0 / either).otherwise(0.0).alias("iou"))


def neighbours_column(pixels: Column | str = "a") -> Column:
    """Number of 8-neighbours of each pixel of an array; a pixel without place has none."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        (row, col), known, sizes = batch.listed(a)
        out = np.zeros(len(row), np.int32)
        out[known] = batch.neighbours(batch.Points(row, col, sizes).where(known))
        return batch.lists(out, sizes, pa.int32())

    return run(pixels)


def neighbours_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel of gathered glyphs with its number of 8-neighbours."""
    rows = glyphs.select(*keys, F.explode(F.arrays_zip(F.col("a").alias("q"), neighbours_column().alias("n"))).alias("z"))
    return rows.select(*keys, "z.q.row", "z.q.col", F.col("z.n").alias("neighbours"))


def neighbours(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel with its number of 8-neighbours, counted where its glyph is gathered."""
    return neighbours_of(gather(pixels, keys, "a"), keys)


def _of_glyph(kinds: dict[str, str], function) -> Column:
    """Struct of figures of each glyph of column a, from its pixels that have a place, and
    their neighbour counts; a pixel without place counts, as one without neighbours."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in kinds.items()))
    def run(a: pa.Array) -> pa.Array:
        (row, col), known, sizes = batch.listed(a)
        every = batch.Points(row, col, sizes)
        values = function(every.where(known), sizes)
        return pa.StructArray.from_arrays([pa.array(v, types[k]) for v, k in zip(values, kinds.values(), strict=True)], list(kinds))

    return run("a")


def endpoints_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Per gathered glyph: endpoints (one neighbour), junctions (three or more), isolated pixels, size."""

    def figures(p: batch.Points, sizes: np.ndarray):
        n = batch.neighbours(p)
        one, many, none = (np.bincount(p.of[f], minlength=len(p)) for f in (n == 1, n >= 3, n == 0))
        return one, many, none + sizes - p.sizes, sizes

    kinds = dict.fromkeys(("endpoints", "junctions", "isolated", "pixels"), "long")
    return glyphs.select(*keys, _of_glyph(kinds, figures).alias("s")).select(*keys, "s.*")


def endpoints_junctions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return endpoints_of(gather(pixels, keys, "a"), keys)


def _with_fill(box: DataFrame) -> DataFrame:
    area = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    return box.withColumn("density", F.col("pixels") / float(K.CANVAS**2)).withColumn("fill", F.col("pixels") / area)


def density_and_box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per glyph: stroke density of the canvas, bounding box and its fill."""
    return _with_fill(pixels.groupBy(*keys).agg(F.count("*").alias("pixels"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right")))


def density_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """``density_and_box`` of gathered glyphs."""

    @F.arrow_udf("pixels long, top int, bottom int, left int, right int")
    def run(a: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = [pa.array(sizes, pa.int64())]
        for values in a.flatten().flatten():
            known = values.is_valid().to_numpy(zero_copy_only=False)
            v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
            p = batch.Points(v, v, sizes).where(known)
            some = p.sizes > 0
            for least in (np.minimum, np.maximum):
                end = np.zeros(len(p), np.int64)
                if some.any():
                    end[some] = least.reduceat(p.row, p.starts[some])
                out.append(pa.array(end, pa.int32(), mask=~some))
        return pa.StructArray.from_arrays(out, ["pixels", "top", "bottom", "left", "right"])

    return _with_fill(glyphs.select(*keys, run("a").alias("s")).select(*keys, "s.*"))


def smoothness_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """4 pi area / perimeter squared, at most 1; 0 under four pixels, 1 without perimeter.

    The perimeter is the pixels that a 3x3 erosion takes; the canvas' edge takes none.
    """

    def figures(p: batch.Points, sizes: np.ndarray):
        sides = [3 - (v == 0).astype(int) - (v == K.CANVAS - 1) for v in (p.row, p.col)]
        outer = batch.neighbours(p) < sides[0] * sides[1] - 1
        return sizes, np.bincount(p.of[outer], minlength=len(p)) + sizes - p.sizes

    agg = glyphs.select(*keys, _of_glyph({"area": "long", "perimeter": "long"}, figures).alias("s")).select(*keys, "s.*")
    value = F.least(F.lit(1.0), 4.0 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    return agg.withColumn("smoothness", F.when(F.col("area") < 4, 0.0).when(F.col("perimeter") == 0, 1.0).otherwise(value))


def smoothness(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return smoothness_of(gather(pixels, keys, "a"), keys)


def second_moments(n, sx, sy, sxx, syy, sxy):
    """Central second moments (mu20, mu02, mu11) of sums, given as columns or numbers."""
    return sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n


MOMENTS = ("sx", "sy", "sxx", "syy", "sxy")


def deskew_angle(pixels: DataFrame, keys: list[str], most: float = 30.0) -> DataFrame:
    """Deskew angle in degrees from second central moments, and whether it is applied."""
    x, y = F.col("col"), F.col("row")
    return _angle(pixels.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).cast("double").alias(k) for k, v in zip(MOMENTS, (x, y, x * x, y * y, x * y), strict=True)]), keys, most)


def deskew_of(glyphs: DataFrame, keys: list[str], most: float = 30.0) -> DataFrame:
    """``deskew_angle`` of gathered glyphs."""

    @F.arrow_udf(", ".join(f"{k} double" for k in MOMENTS))
    def run(a: pa.Array) -> pa.Array:
        p = batch.points(a, canvas=False)
        x, y = p.col, p.row
        return pa.StructArray.from_arrays([pa.array(p.sums(v), pa.float64(), mask=p.sizes == 0) for v in (x, y, x * x, y * y, x * y)], list(MOMENTS))

    sums = glyphs.select(*keys, F.size("a").cast("long").alias("n"), run("a").alias("s"))
    return _angle(sums.select(*keys, "n", "s.*"), keys, most)


def _angle(sums: DataFrame, keys: list[str], most: float) -> DataFrame:
    mu20, mu02, mu11 = second_moments(F.col("n"), *[F.col(k) for k in MOMENTS])
    angle = F.degrees(0.5 * F.atan2(2 * mu11, mu20 - mu02))
    out = sums.withColumn("raw", F.when((F.col("n") < 10) | (F.abs(mu20 - mu02) < 1e-5), 0.0).otherwise(angle))
    return out.withColumn("angle", F.when(F.abs("raw") > most, 0.0).otherwise(F.col("raw"))).select(*keys, "n", "raw", "angle")


def align(student: DataFrame, template: DataFrame) -> DataFrame:
    """Student pixels moved so that the centroids meet; shifts under one pixel aren't applied.

    A pixel moves by the shift rounded to the nearest whole number (halves up) and is
    dropped if it leaves the canvas. What is joined is a row for each template, so no pixels
    are joined to pixels, whose size Spark underestimates.
    """
    moved = pairs(student, template).where(F.size("p") > 0)
    return moved.select("g", "t", F.inline(aligned_column("a", "p")))


def aligned_column(a: Column | str = "a", p: Column | str = "p") -> Column:
    """``align`` of gathered glyphs."""

    @F.arrow_udf("array<struct<row:int,col:int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        every = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        moved = batch.centred(batch.points(x, canvas=False), batch.points(y, canvas=False), every)
        rows = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (moved.row, moved.col)], ["row", "col"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, moved.ends), pa.int32()), rows)

    return run(a, p)


def totals_column(pixels: Column | str = "a") -> Column:
    """Number of pixels and sums of their rows and columns."""

    @F.arrow_udf("pixels long, row_sum long, col_sum long")
    def run(a: pa.Array) -> pa.Array:
        p = batch.points(a, canvas=False)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (p.sizes, *(p.sums(v).astype(np.int64) for v in (p.row, p.col)))], ["pixels", "row_sum", "col_sum"])

    return run(pixels)


# Grid kernels: sequential by nature, one glyph at a time in Arrow batches ---------


def grid(pixels) -> np.ndarray:
    """The canvas of pixels given as flat numbers, or as rows and columns."""
    out = np.zeros((K.CANVAS, K.CANVAS), bool)
    if pixels is None or not len(pixels):
        return out
    if isinstance(pixels[0], dict):
        at = np.array([(p["row"], p["col"]) for p in pixels])
        at = at[((at >= 0) & (at < K.CANVAS)).all(axis=1)]
        out[at[:, 0], at[:, 1]] = True
    else:
        out.ravel()[np.asarray(pixels, np.int64)] = True
    return out


def component_sizes(mask: np.ndarray) -> list[int]:
    """Sizes of the 8-connected components, largest first, by a search over the ink alone."""
    return sorted(map(len, _search(mask, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])), reverse=True)


def _search(mask: np.ndarray, steps: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Components of the ink under the given steps, in order of their first pixel."""
    todo = dict.fromkeys(map(tuple, np.argwhere(mask).tolist()))
    out = []
    while todo:
        edge, part = [todo.popitem()[0]], []
        while edge:
            r, c = edge.pop()
            part.append((r, c))
            for a, b in steps:
                if (near := (r + a, c + b)) in todo:
                    del todo[near]
                    edge.append(near)
        out.append(part)
    return out


def loops(mask: np.ndarray) -> int:
    """Background components, 8-connected, that don't touch a corner, after dilation by a cross.

    Counted by Euler's number: with 4-connected ink and 8-connected background it is the
    components less the holes, and a sum over all 2x2 squares of the padded grid.
    """
    wide = np.pad(mask, 2)
    wide = wide | np.roll(wide, 1, 0) | np.roll(wide, -1, 0) | np.roll(wide, 1, 1) | np.roll(wide, -1, 1)
    wide = np.pad(wide[2:-2, 2:-2], 1)
    q = wide.astype(np.int8)
    total = q[:-1, :-1] + q[1:, :-1] + q[:-1, 1:] + q[1:, 1:]
    diagonal = (total == 2) & (q[:-1, :-1] == q[1:, 1:])
    euler = (np.count_nonzero(total == 1) - np.count_nonzero(total == 3) + 2 * np.count_nonzero(diagonal)) // 4
    return len(_search(wide, [(0, 1), (0, -1), (1, 0), (-1, 0)])) - euler


def background_distance(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each ink pixel to the nearest background pixel; none: 0.

    Rings of growing radius are tried for the pixels that still have none nearer.
    """
    ink = np.argwhere(mask)
    best = np.full(len(ink), np.inf)
    h, w = mask.shape
    for r in range(1, h + w):
        todo = np.flatnonzero(best > r * r)
        if not len(todo):
            break
        for a in range(-r, r + 1):
            for b in {-r, r} if abs(a) < r else range(-r, r + 1):
                y, x = ink[todo, 0] + a, ink[todo, 1] + b
                inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                free = inside & ~mask[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
                best[todo[free]] = np.minimum(best[todo[free]], a * a + b * b)
    return np.where(np.isinf(best), 0.0, np.sqrt(best))


def structural_similarity(x: np.ndarray, y: np.ndarray, window: int = 7) -> float:
    """Mean SSIM over uniform windows with sample covariance, a border of half a window cut."""
    x, y = x.astype(float), y.astype(float)
    n = window * window

    def mean(z):
        s = np.pad(np.cumsum(np.cumsum(z, axis=0), axis=1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / n

    ux, uy = mean(x), mean(y)
    scale = n / (n - 1)
    vx, vy, vxy = (scale * (mean(p * q) - a * b) for p, q, a, b in ((x, x, ux, ux), (y, y, uy, uy), (x, y, ux, uy)))
    c1, c2 = 0.01**2, 0.03**2
    return float(((2 * ux * uy + c1) * (2 * vxy + c2) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))).mean())


def prune_spurs(mask: np.ndarray, rounds: int) -> np.ndarray:
    """Endpoints taken off, as often as ``rounds`` says or until nothing changes."""
    out = mask.copy()
    for _ in range(rounds):
        p = np.pad(out, 1).astype(int)
        h, w = out.shape
        around = sum(p[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1)) - out
        ends = out & (around == 1)
        if not ends.any():
            break
        out &= ~ends
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning to strokes one pixel wide."""
    img = np.pad(mask, 1).astype(np.uint8)
    while True:
        changed = False
        for first in (True, False):
            n = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(x.astype(int) for x in n)
            turns = sum(((n[i] == 0) & (n[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            if first:
                rule = (n[0] * n[2] * n[4] == 0) & (n[2] * n[4] * n[6] == 0)
            else:
                rule = (n[0] * n[2] * n[6] == 0) & (n[0] * n[4] * n[6] == 0)
            gone = (img == 1) & (count >= 2) & (count <= 6) & (turns == 1) & rule
            if gone.any():
                img[gone] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def _kernel(function, kind: str):
    @F.pandas_udf(kind)
    def run(pixels: pd.Series) -> pd.Series:
        return pd.Series([function(grid(p)) for p in pixels])

    return lambda pixels: run(codes(pixels))


def components_column(pixels: str = "a") -> Column:
    """Sizes of the 8-connected components, largest first."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        return batch.lists(*batch.component_sizes(batch.points(a)), pa.int32())

    return run(pixels)


def loops_column(pixels: str = "a") -> Column:
    @F.arrow_udf("int")
    def run(a: pa.Array) -> pa.Array:
        found = [batch.loops(masks) for _, masks in batch.points(a).canvases()]
        return pa.array(np.concatenate(found) if found else [], pa.int32())

    return run(pixels)


def thickness_column(pixels: str = "a") -> Column:
    """[mean, population deviation] of the ink's distance to the background; zeros if empty."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array) -> pa.Array:
        found = []
        for _, masks in batch.points(a).canvases():
            p, d = batch.background_distances(masks)
            n = np.maximum(p.sizes, 1)
            mean = p.sums(d) / n
            found.append(np.stack([mean, np.sqrt(p.sums((d - mean[p.of]) ** 2) / n)], axis=1))
        values = np.concatenate(found).ravel() if found else np.zeros(0)
        return batch.lists(values, np.full(len(values) // 2, 2), pa.float64())

    return run(pixels)


def thinned_column(pixels: str = "a") -> Column:
    return decoded(_kernel(lambda m: np.flatnonzero(thin(m)).tolist(), "array<int>")(pixels))


def pruned_column(pixels: str = "a", rounds: int = 5) -> Column:
    return decoded(_kernel(lambda m: np.flatnonzero(prune_spurs(m, rounds)).tolist(), "array<int>")(pixels))


def ssim_column(a: str = "a", p: str = "p") -> Column:
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [batch.structural_similarities(i, j) for (_, i), (_, j) in zip(batch.points(x).canvases(), batch.points(y).canvases(), strict=True)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return run(a, p)


def dilate(pixels: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Pixels of a level's lane: an elliptic kernel around every pixel, within the canvas."""
    radius = K.LANE_KERNEL[level] // 2
    wide = K.ellipse_half_widths(radius)
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-radius, radius + 1) for dc in range(-wide[abs(dr)], wide[abs(dr)] + 1)])
    out = pixels.select(*keys, "row", "col", F.explode(steps).alias("s")).select(*keys, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    return out.where(F.col("row").between(0, K.CANVAS - 1) & F.col("col").between(0, K.CANVAS - 1)).distinct()


def kept_column(pixels: str = "a", share: float = 0.3) -> Column:
    """Pixels of the components with at least ``share`` of the largest one's pixels."""

    def kept(mask: np.ndarray) -> list[int]:
        parts = _search(mask, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        least = share * max(map(len, parts), default=0)
        return [r * K.CANVAS + c for part in parts if len(part) >= least for r, c in part]

    return decoded(_kernel(kept, "array<int>")(pixels))


def largest_fragments(pixels: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """Pixels of the components with at least ``share`` of the largest one's pixels."""
    return gather(pixels, keys, "a").select(*keys, F.inline(kept_column("a", share)))


def first_glyph_pairs(glyphs: DataFrame, page: Column, order: Column) -> DataFrame:
    """Each page's first glyph as the template ``p`` of the page's other glyphs."""
    w = Window.partitionBy("page").orderBy("ord")
    rows = glyphs.withColumn("page", page).withColumn("ord", order)
    return rows.withColumn("p", F.first("a").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
