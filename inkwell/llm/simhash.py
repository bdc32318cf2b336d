"""Vectorised SimHash kernels: term hashes vote on signed bits."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles whose bits are spread out at once; bounds memory for texts of any length.
SLICE = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words if fewer."""
    parts = words_of(text)
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


#: Row v holds the eight bits of the byte v, the least significant first.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def bit_votes(hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each document the weight of set bits, (documents, 64); hashes lie end to end.

    Each of a hash's eight bytes is counted by value first; the 256 counts then vote for
    eight bits at once. Without weights the votes are whole numbers, exactly.
    """
    votes = np.zeros((len(counts), 64))
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[at : at + SLICE]).view(np.uint8).reshape(-1, 8)
        who = owner[at : at + SLICE]
        low = int(who[0])
        base = (who - low) * 256
        n = int(who[-1]) - low + 1
        w = None if weights is None else weights[at : at + SLICE]
        for k in range(8):
            tally = np.bincount(base + part[:, k], weights=w, minlength=n * 256).reshape(n, 256)
            votes[low : low + n, 8 * k : 8 * k + 8] += tally @ _BITS_OF_BYTE
    return votes


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(n, 64) booleans to n uint64, column j being bit j."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def majority_fingerprints(texts, words: int) -> np.ndarray:
    """A bit is 1 if set in over half of the hashes; a text without words gives zero."""
    hashes, counts = [], []
    out, held = [], 0

    def flush():
        if counts:
            n = np.array(counts, np.int64)
            out.append(pack_bits(2 * bit_votes(np.concatenate(hashes), n) > n[:, None]))

    for text in texts:
        h = shingle_hashes(text, words)
        hashes.append(h)
        counts.append(len(h))
        held += len(h)
        if held >= 4 * SLICE:
            flush()
            hashes, counts, held = [], [], 0
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
