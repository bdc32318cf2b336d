"""The weighted score, its bands and its feedback."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import batch, ink


RAW = "same_loops boolean, ssim double, disparity double, hausdorff double, trajectory double, cosine double"


def centred(mask: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The mask moved so that the centroids meet; shifts under one pixel aren't applied, and
    what leaves the canvas is dropped."""
    a, p = np.argwhere(mask), np.argwhere(on)
    if not len(a) or not len(p):
        return mask
    shift = p.mean(axis=0) - a.mean(axis=0)
    if np.sqrt((shift**2).sum()) < 1.0:
        return mask
    a = a + np.floor(shift + 0.5).astype(int)
    a = a[((a >= 0) & (a < mask.shape)).all(axis=1)]
    out = np.zeros_like(mask)
    out[a[:, 0], a[:, 1]] = True
    return out


def glyph_metrics(student: Column | str, skeleton: Column | str) -> Column:
    """What the score needs of a student's ink beside the template's skeleton, unrounded.

    The ink is thinned first. Similarity, Procrustes and Hausdorff are of the thinned ink
    moved onto the template's centroid; loops, trajectory and cosine of it where it lies.
    ``cosine`` is null where no run has a direction; Hausdorff and trajectory of an empty
    glyph, and the disparity of one under three pixels, are undefined (999).
    """

    names = [part.split()[0] for part in RAW.split(", ")]

    @F.arrow_udf(RAW)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        every, found = (batch.points(z) for z in (x, y)), []
        for (_, masks), (_, templates) in zip(*(z.canvases(128) for z in every), strict=True):
            found.append(_metrics(masks, templates))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * len(names)
        kinds = [pa.bool_()] + [pa.float64()] * (len(names) - 1)
        return pa.StructArray.from_arrays([pa.array(c, k, mask=np.isnan(c.astype(float))) for c, k in zip(columns, kinds, strict=True)], names)

    return run(student, skeleton)


def _metrics(masks: np.ndarray, templates: np.ndarray) -> tuple[np.ndarray, ...]:
    """The fields of RAW for some glyphs' canvases; NaN stands for null."""
    thin = batch.thin(masks)
    first, which = batch.distinct(templates)
    few = batch.of_masks(templates[first])
    p, on = batch.of_masks(thin), few.take(which)
    moved = batch.centred(p, on)
    canvas = np.zeros_like(masks)
    canvas[moved.of, moved.row, moved.col] = True
    there, back = batch.nearest(moved, on, back=True)
    far = np.maximum(batch.furthest(moved, there), batch.furthest(on, back))
    far = np.where((moved.sizes > 0) & (on.sizes > 0), np.sqrt(np.maximum(far, 0).astype(float)), K.UNDEFINED)
    curve, path, shifted = (batch.by_angle(z) for z in (few, p, moved))
    disparity = batch.disparities(batch.along_curves(curve)[0][which], batch.along_curves(shifted)[0])
    disparity = np.where(np.minimum(on.sizes, moved.sizes) < 3, K.UNDEFINED, disparity)
    curve = curve.take(which)
    trajectory = batch.banded_dtw(batch.evenly(curve), batch.evenly(path))
    return batch.loops(thin) == batch.loops(templates[first])[which], batch.structural_similarities(canvas, templates), disparity, far, trajectory, batch.mean_cosines(path, curve)


def scored(glyphs: DataFrame, level: str = "intermedio") -> DataFrame:
    """g, t, level, the eight components and score_final of (g, t, a, p): a student's ink and
    its template's skeleton. Each figure is rounded where a user sees it: precision and
    distances to two places, coverage to four, then components and score to two."""
    near = ink.fidelity(glyphs, {level: K.TOLERANCE[level]})
    r = F.bround
    precision, coverage = r("precision", 2), r("coverage", 4)
    fidelity = r(K.WEIGHT_PRECISION * precision + K.WEIGHT_COVERAGE * coverage * 100.0, 2)
    rows = near.select("g", "t", "level", fidelity.alias("fidelity"), coverage.alias("coverage"), glyph_metrics("a", "p").alias("m"))
    ssim = r((F.coalesce("m.ssim", F.lit(0.0)) + 1) / 2 * 100, 2)
    procrustes = r(F.greatest(F.lit(0.0), 100.0 - 50.0 * F.col("m.disparity")), 2)
    cosine = r(F.coalesce((F.col("m.cosine") + 1) / 2 * 100, F.lit(50.0)), 2)
    parts = component_scores(F.col("fidelity"), F.col("coverage"), F.col("m.same_loops"), ssim, procrustes, r("m.hausdorff", 2), r("m.trajectory", 2), cosine)
    rows = rows.select("g", "t", "level", *[v.alias(k) for k, v in parts.items()])
    final = r(final_score({k: F.col(k) for k in parts}), 2).alias("score_final")
    return rows.select("g", "t", "level", *[r(k, 2).alias(k) for k in parts], final)


def clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def component_scores(precision: Column, coverage: Column, same_loops: Column, ssim: Column, procrustes: Column, hausdorff: Column, trajectory: Column, cosine: Column) -> dict[str, Column]:
    """The eight components, each 0 to 100; a missing one counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "dt_precision": clamp(zero(precision)),
        "dt_coverage": clamp(zero(coverage) * 100.0),
        "topology": F.when(same_loops, K.TOPOLOGY_HIT).otherwise(K.TOPOLOGY_MISS),
        "ssim": clamp(zero(ssim)),
        "procrustes": clamp(zero(procrustes)),
        "hausdorff": F.greatest(F.lit(0.0), 100.0 - K.HAUSDORFF_FACTOR * F.greatest(F.lit(0.0), F.coalesce(hausdorff, F.lit(K.UNDEFINED)) - K.HAUSDORFF_TOLERANCE)),
        "trajectory": F.greatest(F.lit(0.0), 100.0 - K.TRAJECTORY_FACTOR * F.coalesce(trajectory, F.lit(K.UNDEFINED))),
        "cosine": clamp(F.coalesce(cosine, F.lit(50.0))),
    }


def final_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum in the fixed order of the weights."""
    total = F.lit(0.0)
    for name, weight in (weights or K.WEIGHTS).items():
        total = total + components[name] * weight
    return total


def feedback(score: Column, coverage: Column, precision: Column, topology: Column, hausdorff: Column) -> Column:
    band = F.when(score >= 85, K.FEEDBACK_GOOD).when(score >= 65, K.FEEDBACK_FAIR).otherwise(K.FEEDBACK_POOR)
    return F.concat_ws(
        " ",
        band,
        F.when(coverage < 50, K.FEEDBACK_COVERAGE),
        F.when(precision < 50, K.FEEDBACK_PRECISION),
        F.when(topology < 50, K.FEEDBACK_TOPOLOGY),
        F.when(hausdorff < 40, K.FEEDBACK_HAUSDORFF),
    )


def band(score: Column, edges: tuple = ((85, "excelente"), (65, "bueno"), (0, "practicar"))) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(edges):
        out = F.when(score >= least, name).otherwise(out)
    return out


def page_average(rows: DataFrame, page: str, score: str) -> DataFrame:
    """Mean of the positive scores of each page, 0 if there are none, and the counts."""
    return rows.groupBy(page).agg(F.count("*").alias("n_detected"), F.count_if(F.col(score) > 0).alias("n_evaluated"), F.coalesce(F.avg(F.when(F.col(score) > 0, F.col(score))), F.lit(0.0)).alias("avg_score"))


def legacy_breakdown(metrics: Column) -> dict[str, Column]:
    """Components from an older response's map of raw metrics; missing ones count as 0."""
    get = lambda k: F.coalesce(F.element_at(metrics, k), F.lit(0.0))
    return {
        "dt_precision": clamp(get("dt_precision")),
        "dt_coverage": clamp(get("dt_coverage") * 100.0),
        "ssim": clamp(get("ssim_score")),
        "procrustes": clamp(get("procrustes_score")),
        "hausdorff": F.greatest(F.lit(0.0), 100.0 - K.HAUSDORFF_FACTOR * F.greatest(F.lit(0.0), F.coalesce(F.element_at(metrics, "hausdorff"), F.lit(K.UNDEFINED)) - K.HAUSDORFF_TOLERANCE)),
        "trajectory": F.greatest(F.lit(0.0), 100.0 - K.TRAJECTORY_FACTOR * F.coalesce(F.element_at(metrics, "trajectory_dist"), F.lit(K.UNDEFINED))),
    }


def response(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A projection with a default for every missing or null field."""
    return df.select(*[F.coalesce(F.col(name), value).alias(name) if name in df.columns else value.alias(name) for name, value in defaults.items()])
