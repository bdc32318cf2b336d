"""PNG and PGM/PPM bytes to arrays and back, without an imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes | None) -> np.ndarray | None:
    """(h, w) or (h, w, 3) uint8 of an 8-bit, non-interlaced PNG; transparency over white.

    None for anything else, so that another decoder may be tried.
    """
    if not data or data[:8] != SIGNATURE:
        return None
    try:
        at, chunks, palette, alpha = 8, [], None, None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                if depth != 8 or interlace:
                    return None
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS" and colour == 3:
                alpha = np.frombuffer(body, np.uint8)
            elif kind == b"IDAT":
                chunks.append(body)
            elif kind == b"IEND":
                break
        n = _CHANNELS[colour]
        raw = np.frombuffer(zlib.decompress(b"".join(chunks)), np.uint8).reshape(h, 1 + w * n)
        rows = _unfilter(raw[:, 0], raw[:, 1:].copy(), n).reshape(h, w, n)
    except (KeyError, ValueError, struct.error, zlib.error, UnboundLocalError):
        return None
    if colour == 3:
        rgb = palette[rows[..., 0]]
        if alpha is None:
            return rgb
        a = np.full(256, 255)
        a[: len(alpha)] = alpha
        return _over_white(rgb, a[rows[..., 0]])
    if colour in (4, 6):
        flat = _over_white(rows[..., :-1], rows[..., -1])
        return flat[..., 0] if colour == 4 else flat
    return rows[..., 0] if n == 1 else rows


def _over_white(rgb: np.ndarray, a: np.ndarray) -> np.ndarray:
    a = a[..., None].astype(np.float32) / 255
    return np.rint(rgb * a + 255 * (1 - a)).astype(np.uint8)


def _unfilter(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    if not kinds.any():
        return rows
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), rows, strict=True):
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            up, out = above.tolist(), row.tolist()
            for i in range(len(out)):
                left, b = out[i - n] if i >= n else 0, up[i]
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    corner = up[i - n] if i >= n else 0
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if da <= db and da <= dc else b if db <= dc else corner
                out[i] = (out[i] + guess) & 255
            row[:] = out
        elif kind:
            raise ValueError("unknown filter")
        above = row
    return rows


def encode_png(image: np.ndarray) -> bytes:
    """PNG of an (h, w) or (h, w, 3) uint8 array."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_pnm(data: bytes | None) -> np.ndarray | None:
    """Binary PGM or PPM of 8 bits; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        if data[at : at + 1].isspace():
            at += 1
        elif data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            fields.append(data[at:end])
            at = end
    try:
        w, h, most = map(int, fields)
        n = 3 if data[:2] == b"P6" else 1
        out = np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape((h, w, 3) if n == 3 else (h, w))
    except ValueError:
        return None
    return out if most == 255 else None


def read_npy(data: bytes | None) -> np.ndarray | None:
    """A stored template array; None if the bytes aren't one. Pickles are refused."""
    import io

    try:
        return np.load(io.BytesIO(data), allow_pickle=False) if data else None
    except (ValueError, EOFError, OSError):
        return None


def decode_image(data: bytes | None) -> np.ndarray | None:
    """The first decoder's result: PNG, then PGM/PPM."""
    out = decode_png(data)
    return decode_pnm(data) if out is None else out
