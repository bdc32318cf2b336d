"""Quality by ordinal cumulative-link regression on graded ratings.

A text's features are hashed counts of its byte triples and of its words' relation to
the word before (equal or not) and shape. One weight vector is shared by all grades;
ordered thresholds turn its score into the probability of each grade, hence the
expected grade and the probability of a grade of at least k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, mix64, small_batches, text_slices

DIMENSIONS = 4096
#: The last dimensions are kept for word relations and shapes.
RELATIONS = 64
#: Bytes hashed at once; bounds memory for texts of any length.
SLICE = 1 << 20

_KIND = np.zeros(256, np.int64)
for _bytes, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (range(128, 256), 4)):
    _KIND[list(_bytes)] = _kind
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def _triples(raw: np.ndarray) -> np.ndarray:
    tally = np.zeros(DIMENSIONS)
    for at in range(0, max(len(raw) - 2, 0), SLICE):
        b = raw[at : at + SLICE + 2].astype(np.uint64)
        code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        tally += np.bincount((mix64(code) % np.uint64(DIMENSIONS - RELATIONS)).astype(np.int64), minlength=DIMENSIONS)
    return tally


def features(text: str | None) -> np.ndarray:
    """Square roots of the features' shares of the whole text; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    out = _triples(raw)
    out /= max(out.sum(), 1)
    kinds = np.bincount(_KIND[raw], minlength=6)[:6] / max(len(raw), 1)
    words = data.split()
    lines = data.split(b"\n")
    n = max(len(words), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words) / n
    extra = [*kinds, repeats, marked, len(set(words)) / n, len(set(lines)) / len(lines), min(n, 1000) / 1000, float(not words)]
    at = DIMENSIONS - RELATIONS
    out[at : at + len(extra)] = extra
    return np.sqrt(out).astype(np.float32)


@dataclass
class OrdinalModel:
    """Shared weights, ordered thresholds, and the grades that they part, one more of them."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, x: np.ndarray) -> np.ndarray:
        """(n, grades - 1): the probability of a grade over the first, the second, ..."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None], -30, 30)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        """Expected grade; 0 where no grade is known."""
        return np.full(len(tails), float(self.grades[0] if self.grades else 0)) + tails @ np.diff(self.grades)[: tails.shape[1]]

    def at_least(self, tails: np.ndarray, least: int) -> np.ndarray:
        """Probability of a grade of at least ``least``; 1 where no grade is known."""
        under = sum(g < least for g in self.grades)
        if under and under == len(self.grades):
            return np.zeros(len(tails))
        return tails[:, under - 1] if under else np.ones(len(tails))


def fit(x: np.ndarray, grades: np.ndarray, levels: int, values: list[int] | None = None, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by Adam; thresholds stay ordered as sums of positive steps."""
    n, width = x.shape
    share = np.array([(grades > k).mean() for k in range(levels - 1)]).clip(0.01, 0.99)
    first = -np.log(share / (1 - share))
    p = {"w": np.zeros(width, np.float32), "first": first[:1].astype(float), "gaps": np.log(np.maximum(np.diff(first), 0.05))}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    rows = np.arange(n)

    def thresholds():
        return np.concatenate([p["first"], p["first"] + np.cumsum(np.exp(p["gaps"]))])

    for t in range(1, steps + 1):
        s = x @ p["w"]
        below = 1 / (1 + np.exp(-np.clip(thresholds()[None] - s[:, None], -30, 30)))
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        upper, lower = slope[rows, grades + 1], slope[rows, grades]
        mass = np.maximum(edge[rows, grades + 1] - edge[rows, grades], 1e-9)
        ds = (upper - lower) / mass / n
        dt = np.zeros(levels + 1)
        np.add.at(dt, grades + 1, -upper / mass / n)
        np.add.at(dt, grades, lower / mass / n)
        dt = dt[1:-1]
        g = {"w": (x.T @ ds.astype(np.float32)) + ridge * p["w"], "first": np.array([dt.sum()]), "gaps": np.cumsum(dt[::-1])[::-1][1:] * np.exp(p["gaps"])}
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(p["w"].astype(np.float32), thresholds(), list(values or range(levels)))


#: Grades that a rating may have at most; more of them aren't ratings.
MOST_GRADES = 100


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", rows_per_grade: int = 1500, longest: int = 50_000) -> OrdinalModel:
    """Fit on the rated rows with the smallest hashes of their ids: at most
    ``rows_per_grade`` of each grade, none over ``longest`` bytes.

    Ratings are whole numbers, also below 0; the model's levels are the distinct ones in
    order, at most ``MOST_GRADES``, else it is an error. A document with several ratings
    has the lowest; null ratings don't count. Where one grade alone is known, every text
    has it; where none is, every text's tail probability is 1, so that none is rejected.
    """
    known = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(grade_col).cast("long").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).limit(MOST_GRADES + 1).collect()}
    values = sorted(counts)
    if len(values) > MOST_GRADES:
        raise ValueError(f"over {MOST_GRADES} distinct grades in {grade_col}")
    levels = len(values)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 31))
    # A hash thins each grade to little more than is wanted before any of it is sorted.
    shares = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.5 * rows_per_grade / n))]) if counts else None
    thinned = known.where(draw < F.element_at(shares, F.col("_y")) * float(1 << 31)) if counts else known
    first = Window.partitionBy("_y").orderBy(draw, "_id")
    picked = thinned.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= rows_per_grade).drop("_k")
    # At most rows_per_grade ids of each grade.
    joined = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
    rows = joined.where(F.octet_length("_t") <= longest).select(draw.alias("h"), F.xxhash64("_t").alias("h2"), "_t", "_y").orderBy("h", "h2").limit(2 * max(levels, 1) * rows_per_grade).collect()
    rows.sort(key=lambda r: (r["h"], r["_t"]))
    grades = np.searchsorted(np.array(values, np.int64), np.array([r["_y"] for r in rows], np.int64))
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(DIMENSIONS, np.float32), np.zeros(0), values[-1:] if not len(grades) else [values[grades[0]]])
    return fit(np.stack([features(r["_t"]) for r in rows]), grades, levels, values)


def grade(docs: DataFrame, model: OrdinalModel, least: int = 1, keep: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, selected.

    ``tail_probability`` is that of a grade of at least ``least``; a row is selected
    unless it is under ``keep``. Whole texts are read; a null text counts as empty. Repeated
    rows are graded like any others, an empty table gives no rows, other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column(1).to_pylist()
            tails = np.concatenate([model.tails(np.stack([features(t) for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)]) if texts else np.zeros((0, len(model.thresholds)))
            tail = model.at_least(tails, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.expected(tails)), pa.array(tail), pa.array(tail >= keep)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean")


def keep_selected(docs: DataFrame, model: OrdinalModel, least: int = 1, keep: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``grade`` selects, repeated ones too, all columns as they were."""
    kinds = docs.schema
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, whole.schema.get_field_index(text_col))):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ok = [model.at_least(model.tails(features(t)[None]), least)[0] >= keep for t in texts]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(lean(run), kinds)
