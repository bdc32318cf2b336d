"""Toxicity by compression distance.

One zstandard dictionary is trained on toxic text, another on ordinary text. Short
overlapping windows of a document are compressed with each; where the toxic dictionary
gives the shorter result, the window shares passages with toxic text. The largest
differences of a document's windows become a probability by a logistic calibration on
rows that the dictionaries weren't trained on, with the decision threshold at the best F1
there.

Most of a toxic document is ordinary text, which both dictionaries would learn alike. So
toxic rows are first parsed against the ordinary ones: a run of byte strings that ordinary
rows hardly ever have, but several toxic rows share, is a passage, and the toxic dictionary
is trained on passages. The dictionaries are used as raw content of equal length, and a
fixed primer that both hold opens each window, so that the frame of a compressed block is
paid for in any case and each further match shows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices

PRIMER = bytes(range(1, 25))
TOP = 4
#: Bytes of a string by which texts are compared, and of a dictionary at most.
SPAN, SIZE = 6, 1500


def windows_of(text: str | bytes | None, width: int = 24, step: int = 16) -> list[bytes]:
    """Windows that cover the whole lower-cased text; an empty text has none."""
    raw = text if isinstance(text, bytes) else (text or "").lower().encode("utf-8", "surrogatepass")
    return [raw[i : i + width] for i in range(0, max(len(raw) - width + step, 1), step)] if raw else []


def _spans(raw: bytes) -> np.ndarray:
    """Every string of ``SPAN`` bytes as a number, one for each place."""
    data = np.frombuffer(raw, np.uint8)
    n = max(len(data) - SPAN + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(SPAN):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


class _Rows:
    """How many of some texts have each string of ``SPAN`` bytes."""

    def __init__(self, texts: list[bytes]):
        self.size = len(texts)
        self.names, self.counts = np.unique(np.concatenate([np.unique(_spans(t)) for t in texts]), return_counts=True)

    def of(self, spans: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(spans), np.int64)
        at = np.minimum(np.searchsorted(self.names, spans), len(self.names) - 1)
        return np.where(self.names[at] == spans, self.counts[at], 0)


def passages(texts: list[bytes], toxic: _Rows, ordinary: _Rows, share: float, times: float = 20.0, run: int = 3) -> list[bytes]:
    """The parts of toxic ``texts`` that ordinary text can't explain.

    A string counts if at least ``share`` of the toxic rows (three at least) have it and
    its rate there is over ``times`` the ordinary one; ``run`` such strings in a row are a
    passage, of any length.
    """
    least, scale = max(3.0, share * toxic.size), times * toxic.size / max(ordinary.size, 1)
    out = []
    for raw in texts:
        spans = _spans(raw)
        shared = toxic.of(spans)
        new = shared >= least
        some = np.flatnonzero(new)
        new[some] = shared[some] > scale * (ordinary.of(spans[some]) + 0.5)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], new.astype(np.int8), [0]])))
        out += [raw[a : b + SPAN - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= run]
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=48, d=SPAN, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class ToxicityModel:
    """Dictionaries and calibration; scores texts of any length."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    cut: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_coders"}

    def _pair(self):
        if "_coders" not in self.__dict__:
            coders = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=3)
                coders.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.__dict__["_coders"] = coders
        return self.__dict__["_coders"]

    def differences(self, text: str | None) -> np.ndarray:
        """The TOP largest differences in compressed length, ordinary less toxic."""
        ordinary, toxic = self._pair()
        a, b = ordinary.compress, toxic.compress
        found = sorted((len(a(w)) - len(b(w)) for w in (PRIMER + x for x in windows_of(text))), reverse=True)[:TOP]
        return np.array(found + [-4] * (TOP - len(found)), float)

    def features(self, texts) -> np.ndarray:
        """1, the largest difference, the next ones' sum, and the log of the windows' count."""
        out = np.empty((len(texts), 4))
        for i, text in enumerate(texts):
            d = self.differences(text)
            out[i] = 1.0, d[0], d[1:].sum(), np.log1p(len(text or "") / 1000)
        return out

    def score(self, texts) -> np.ndarray:
        """Between 0 and 1; 0.7 and over where the calibrated threshold is reached."""
        if not len(texts):
            return np.zeros(0)
        logit = self.features(texts) @ self.weights - self.cut + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _best_cut(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Threshold with the best F1 and that F1; halfway between neighbouring values."""
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    ends = np.r_[logit[order][1:] < logit[order][:-1], True]
    best = int(np.argmax(np.where(ends, f1, -1)))
    after = logit[order][best + 1] if best + 1 < len(order) else logit[order][best] - 1
    return float((logit[order][best] + after) / 2), float(f1[best])


def train(rows: list[tuple[str, int]], size: int = SIZE, seed: int = 3) -> ToxicityModel:
    """A model of (text, label) rows; two thirds train dictionaries, the rest calibrates."""
    rows = [(t or "", int(y)) for t, y in rows]
    fit = [r for i, r in enumerate(rows) if i % 3]
    check = rows[::3]
    if not any(y for _, y in fit) or all(y for _, y in fit) or not any(y for _, y in check):
        rate = float(np.mean([y for _, y in rows])) if rows else 0.0
        return ToxicityModel(b"", b"", np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3)), 0, 0, 0]), np.log(0.7 / 0.3))
    bad, good = ([(t.lower().encode("utf-8", "surrogatepass")) for t, label in fit if label == y] for y in (1, 0))
    rng = random.Random(seed)
    plain = [w for t in good for w in rng.choices(windows_of(t) or [b" "], k=20)]
    rng.shuffle(plain)
    whole = _dictionary(plain, 4 * size)
    toxic_rows, ordinary_rows = _Rows(bad), _Rows(good)
    labels = np.array([y for _, y in check], float)
    best = None
    for share in (0.005, 0.015, 0.04):
        samples = passages(bad, toxic_rows, ordinary_rows, share)
        if len(samples) < 8:
            continue
        rng.shuffle(samples)
        toxic = _dictionary(samples, size)
        model = ToxicityModel(toxic, whole[-len(toxic) :], np.zeros(4), 0.0)
        x = model.features([t for t, _ in check])
        model.weights = _logistic(x, labels)
        model.cut, f1 = _best_cut(x @ model.weights, labels)
        if best is None or f1 > best[0]:
            best = (f1, model)
    return best[1] if best else train([(t, 0) for t, _ in rows])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 1500, ordinary_rows: int = 3000, longest: int = 30_000) -> ToxicityModel:
    """Train on the labelled rows with the smallest hashes of their ids, at most
    ``toxic_rows`` and ``ordinary_rows``, none over ``longest`` bytes; a document with
    several labels has the largest."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) >= 1).cast("int").alias("_y"))
    draw = F.xxhash64("_id")
    picked = known.where("_y = 1").orderBy(draw).limit(toxic_rows).unionByName(known.where("_y = 0").orderBy(draw).limit(ordinary_rows))
    # At most toxic_rows + ordinary_rows ids.
    joined = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
    rows = joined.where(F.octet_length("_t") <= longest).select(F.xxhash64("_id").alias("h"), F.xxhash64("_t").alias("h2"), "_t", "_y").orderBy("h", "h2").limit(toxic_rows + ordinary_rows).collect()
    return train([(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: (r["h"], r["_t"]))])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 if score >= 0.7).

    Whole texts are scored, in windows; a null or empty text scores as one without a
    toxic window. Only the text is used; repeated rows score like any others, an empty table
    gives no rows, other columns may have any names. Labels only from one class give a
    constant score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            score = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
