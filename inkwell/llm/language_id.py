"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position with
probabilities of the languages, and a document's probabilities are the mean over all
its positions. It is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices

UNKNOWN = "und"


class ByteGRU:
    """Two gated recurrent layers, one in each direction, and a softmax at every byte."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.hidden, self.classes = hidden, classes
        self.p = {"out": f(classes, 2 * hidden, scale=0.3), "bias": np.zeros((classes, 1), np.float32)}
        for d in "fb":
            # Input weights of a byte: its row holds update, reset and candidate gates.
            self.p |= {f"in_{d}": f(256, 3 * hidden, scale=0.3), f"gate_{d}": f(2 * hidden, hidden, scale=0.4), f"cand_{d}": f(hidden, hidden, scale=0.4)}

    def _layer(self, x: np.ndarray, d: str, keep: bool):
        """States (steps, hidden, windows) of one direction; x is (steps, windows)."""
        n, h = self.hidden, np.zeros((self.hidden, x.shape[1]), np.float32)
        given, gate, cand = self.p[f"in_{d}"], self.p[f"gate_{d}"], self.p[f"cand_{d}"]
        states, trace = np.empty((len(x), n, x.shape[1]), np.float32), []
        half = np.float32(0.5)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            e = given[x[t]].T
            zr = gate @ h
            zr += e[: 2 * n]
            zr *= half
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            z, r = zr[:n], zr[n:]
            c = cand @ (r * h)
            c += e[2 * n :]
            np.tanh(c, out=c)
            if keep:
                trace.append((t, h, z, r, c))
            h = c + z * (h - c)
            states[t] = h
        return states, trace

    def _softmax(self, both: np.ndarray) -> np.ndarray:
        logits = self.p["out"] @ both + self.p["bias"]
        logits -= logits.max(axis=0, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=0, keepdims=True)

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(classes, windows): sums of the probabilities at a window's own positions."""
        forward, backward = self._layer(x, "f", False)[0], self._layer(x, "b", False)[0]
        total = np.zeros((self.classes, x.shape[1]), np.float32)
        for t in range(len(x)):
            probability = self._softmax(np.concatenate([forward[t], backward[t]]))
            total += np.where(lengths > t, probability, 0)
        return total

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the positions, and its gradients by backpropagation through time."""
        n, steps, width = self.hidden, *x.shape
        layers = {d: self._layer(x, d, True) for d in "fb"}
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        own = np.arange(steps)[:, None] < lengths
        count, loss = max(int(own.sum()), 1), 0.0
        into = {d: np.empty((steps, n, width), np.float32) for d in "fb"}
        for t in range(steps):
            both = np.concatenate([layers["f"][0][t], layers["b"][0][t]])
            probability = self._softmax(both)
            loss -= float((np.log(probability[y, np.arange(width)] + 1e-9) * own[t]).sum())
            probability[y, np.arange(width)] -= 1
            error = (probability * own[t] / count).astype(np.float32)
            g["out"] += error @ both.T
            g["bias"] += error.sum(axis=1, keepdims=True)
            back = self.p["out"].T @ error
            into["f"][t], into["b"][t] = back[:n], back[n:]
        for d, (_, trace) in layers.items():
            gate, cand = self.p[f"gate_{d}"], self.p[f"cand_{d}"]
            dh = np.zeros((n, width), np.float32)
            for t, h, z, r, c in reversed(trace):
                dh = dh + into[d][t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                drh = cand.T @ dc
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr])
                g[f"cand_{d}"] += dc @ (r * h).T
                g[f"gate_{d}"] += dzr @ h.T
                np.add.at(g[f"in_{d}"], x[t], np.concatenate([dzr, dc]).T)
                dh = dh * z + drh * r + gate.T @ dzr
        return loss / count, g

    def train(self, windows: list[bytes], labels: np.ndarray, steps: int, epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        x, lengths = to_grid(windows, steps)
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, at, total = [], 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order, sums = rng.permutation(len(windows)), []
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                loss, g = self.gradients(x[:, pick], lengths[pick], labels[pick])
                sums.append(loss)
                at += 1
                speed = rate * (1 - at / (total + 1))
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.01 * (v * v - square[k])
                    self.p[k] -= (speed * mean[k] / (1 - 0.9**at) / (np.sqrt(square[k] / (1 - 0.99**at)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses


def to_grid(windows: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, windows), zero after a window's end, and the windows' lengths."""
    lengths = np.fromiter(map(len, windows), np.int64, len(windows))
    grid = np.zeros((len(windows), steps), np.uint8)
    grid[np.arange(steps)[None] < lengths[:, None]] = np.frombuffer(b"".join(windows), np.uint8)
    return np.ascontiguousarray(grid.T), lengths


class LanguageModel:
    """A trained network with its languages; predicts whole texts."""

    def __init__(self, network: ByteGRU | None, languages: list[str], steps: int):
        self.network, self.languages, self.steps = network, languages, steps

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in blocks of windows whatever the texts' lengths."""
        sums = np.zeros((len(texts), max(1, len(self.languages))))
        readable = [bool(t) and self.network is not None for t in texts]
        held, owners, size = [], [], 0

        def flush():
            windows = [w for raw in held for w in (raw[i : i + self.steps] for i in range(0, len(raw), self.steps))]
            owner = np.repeat(owners, [-(-len(raw) // self.steps) for raw in held])
            for at in range(0, len(windows), 4096):
                x, lengths = to_grid(windows[at : at + 4096], self.steps)
                np.add.at(sums, owner[at : at + 4096], self.network.pooled(x, lengths).T)

        for i, text in enumerate(texts):
            if not readable[i]:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            held.append(raw)
            owners.append(i)
            size += len(raw)
            if size >= 1 << 20:
                flush()
                held, owners, size = [], [], 0
        if held:
            flush()
        whole = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        score = np.where(whole > 0, sums[np.arange(len(texts)), best] / np.maximum(whole, 1e-9), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, readable, strict=True)], np.clip(score, 0.0, 1.0)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, windows: int, steps: int) -> list[tuple[str, bytes]]:
    """Windows of the rows with the smallest hashes of their ids: at most
    2 * per_language rows of a language, ``windows`` of each."""
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_language / n))])
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    picked = labelled.where(draw < share[F.col(lang_col)] * (1 << 20)).select(lang_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                starts = np.unique(np.linspace(0, max(0, len(raw) - steps), windows).astype(int))
                rows += [(lang, raw[s : s + steps]) for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "w"])

    cap = 2 * per_language * windows * len(counts)
    found = picked.mapInArrow(cut, "lang string, w binary").orderBy(F.xxhash64("w"), "w", "lang").limit(cap)
    return sorted((r[0], bytes(r[1])) for r in found.collect())


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, windows: int = 10, steps: int = 64, hidden: int = 8, epochs: int = 6) -> LanguageModel:
    """A model of the languages in ``labelled``; rows without text or language are left out.

    The bound on what is learned from: about ``per_language`` rows of each language,
    ``windows`` windows of ``steps`` bytes from each, spread over the whole text.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sample = _sample(usable, id_col, text_col, lang_col, per_language, windows, steps)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return LanguageModel(None, [], steps)
    network = ByteGRU(len(languages), hidden)
    number = {lang: i for i, lang in enumerate(languages)}
    network.train([w for _, w in sample], np.array([number[lang] for lang, _ in sample]), steps, epochs)
    return LanguageModel(network, languages, steps)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Whole texts are read. A null text, one without a letter, or a model that has learned
    nothing gives ``und`` with score 0. Only the text is used; repeated rows are labelled
    like any others, an empty table gives no rows, other columns may have any names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            lang, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    return docs.select(F.col(id_col), text.alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
