"""Glyph kernels over all rows of an Arrow batch at once.

The same definitions as the plain versions of one glyph in ``ink`` and ``sequence``. Pixels
of a batch lie in flat arrays with the size of each glyph beside them; what needs a canvas
sees a few dozen at a time, so memory is bounded by the batch.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import constants as K

#: Canvases looked at together, and cells of pixel pairs looked at together.
CANVASES, CELLS = 64, 1 << 18
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


class Points:
    """Pixels of glyphs one after the other, and how many each glyph has."""

    def __init__(self, row: np.ndarray, col: np.ndarray, sizes: np.ndarray):
        self.row, self.col, self.sizes = row, col, sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def __len__(self) -> int:
        return len(self.sizes)

    @functools.cached_property
    def of(self) -> np.ndarray:
        """The glyph of each pixel."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each glyph's pixels, added in their order."""
        return np.bincount(self.of, values, len(self))

    def where(self, keep: np.ndarray) -> Points:
        return Points(self.row[keep], self.col[keep], np.bincount(self.of[keep], minlength=len(self)))

    def take(self, glyphs: np.ndarray) -> Points:
        """Some glyphs, in the order asked for."""
        at = spread(self.starts[glyphs], self.sizes[glyphs])
        return Points(self.row[at], self.col[at], self.sizes[glyphs])

    def groups(self, most: int = 256):
        """Glyphs of equal size, some at a time: their numbers and the places of their pixels."""
        order = np.argsort(self.sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.sizes[order])) + 1):
            size = int(self.sizes[part[0]]) if len(part) else 0
            for at in range(0, len(part) if size else 0, most):
                some = part[at : at + most]
                yield some, self.starts[some][:, None] + np.arange(size)

    def canvases(self, most: int = CANVASES):
        """Some glyphs at a time: their first number and their canvases."""
        side = K.CANVAS
        for at in range(0, len(self), most):
            n = min(most, len(self) - at)
            own = slice(self.starts[at], self.ends[at + n - 1])
            masks = np.zeros((n, side, side), bool)
            masks[self.of[own] - at, self.row[own], self.col[own]] = True
            yield at, masks


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def listed(array: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(row, col), which are not null, and sizes of a column of arrays of pixels."""
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = array.flatten().flatten()
    known = np.ones(len(parts[0]), bool)
    for p in parts:
        if p.null_count:
            known &= p.is_valid().to_numpy(zero_copy_only=False)
    return [pc.fill_null(p, 0).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], known, sizes


def points(array: pa.Array, canvas: bool = True) -> Points:
    """Pixels of a column of arrays that have both numbers; of those on the canvas alone, if asked."""
    (row, col), known, sizes = listed(array)
    if canvas:
        known &= (row >= 0) & (row < K.CANVAS) & (col >= 0) & (col < K.CANVAS)
    all_ = Points(row, col, sizes)
    return all_ if known.all() else all_.where(known)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each different canvas, and for every canvas which of those it is."""
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(np.packbits(m).tobytes(), len(seen)) for m in masks], np.int64)
    return np.unique(which, return_index=True)[1], which


def of_masks(masks: np.ndarray) -> Points:
    """Set cells of canvases, row by row."""
    n, h, w = masks.shape
    at = np.flatnonzero(masks)
    return Points(at // w % h, at % w, np.bincount(at // (h * w), minlength=n))


# Nearest pixels ----------------------------------------------------------------------


def _padded(p: Points, glyphs: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and whether there is a pixel; what is missing lies far away."""
    sizes = p.sizes[glyphs]
    there = np.arange(sizes.max()) < sizes[:, None]
    at = np.minimum(p.starts[glyphs][:, None] + np.arange(sizes.max()), max(0, len(p.row) - 1))
    return *(np.where(there, v[at], far).astype(np.int32) for v in (p.row, p.col)), there


def pairs(a: Points, b: Points, pairwise: int):
    """Glyphs of ``a`` and ``b`` of like sizes at a time: numbers, and padded pixels of both.

    Those with over ``pairwise`` pairs of pixels come one by one, with None for the pixels.
    """
    steps = lambda n: np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    both = np.flatnonzero((a.sizes > 0) & (b.sizes > 0))
    large = a.sizes[both] * b.sizes[both] > pairwise
    for g in both[large]:
        yield np.array([g]), None, None
    both = both[~large]
    kind = steps(a.sizes[both]) * 64 + steps(b.sizes[both])
    both = both[np.argsort(kind, kind="stable")]
    kind.sort()
    for part in np.split(both, np.flatnonzero(np.diff(kind)) + 1):
        at = 0
        while at < len(part):
            some = part[at : at + max(1, CELLS // int(a.sizes[part].max() * b.sizes[part].max()))]
            at += len(some)
            yield some, _padded(a, some, -10_000), _padded(b, some, 20_000)


def _put(out: np.ndarray, p: Points, glyphs: np.ndarray, values: np.ndarray, there: np.ndarray) -> None:
    out[spread(p.starts[glyphs], p.sizes[glyphs])] = values[there]


def nearest(a: Points, b: Points, back: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Squared distance of each pixel of ``a`` to the nearest of ``b``'s glyph, -1 if it has
    none; the same of ``b`` if asked."""
    from . import ink

    there, here = np.full(len(a.row), -1, np.int64), np.full(len(b.row), -1, np.int64) if back else None
    for some, u, v in pairs(a, b, ink.PAIRWISE):
        if u is None:
            for x, y, out in ((a, b, there), (b, a, here)):
                if out is not None:
                    i, j = (slice(z.starts[some[0]], z.ends[some[0]]) for z in (x, y))
                    mask = np.zeros((K.CANVAS, K.CANVAS), bool)
                    mask[y.row[j], y.col[j]] = True
                    out[i] = ink.distance_map(mask)[x.row[i], x.col[i]]
            continue
        d2 = (u[0][:, :, None] - v[0][:, None]) ** 2 + (u[1][:, :, None] - v[1][:, None]) ** 2
        _put(there, a, some, d2.min(axis=2), u[2])
        if back:
            _put(here, b, some, d2.min(axis=1), v[2])
    return there, here


def furthest(p: Points, values: np.ndarray) -> np.ndarray:
    """Largest value of each glyph's pixels, -1 where it has none."""
    out = np.full(len(p), -1, np.int64)
    some = p.sizes > 0
    if some.any():
        out[some] = np.maximum.reduceat(values, p.starts[some])
    return out


def covered(a: Points, b: Points, radii: list[int]) -> np.ndarray:
    """For each radius, pixels of ``b``'s glyphs that an ellipse around one of ``a``'s hits."""
    from . import ink

    out = np.zeros((len(radii), len(a)), np.int32)
    for some, u, v in pairs(a, b, ink.PAIRWISE):
        if u is None:
            i, j = (slice(z.starts[some[0]], z.ends[some[0]]) for z in (a, b))
            mask = np.zeros((K.CANVAS, K.CANVAS), bool)
            mask[a.row[i], a.col[i]] = True
            for k, radius in enumerate(radii):
                out[k, some[0]] = ink._widened(mask, radius)[b.row[j], b.col[j]].sum()
            continue
        dr, dc = (np.abs(x[:, :, None] - y[:, None]) for x, y in zip(u[:2], v[:2], strict=True))
        for k, radius in enumerate(radii):
            r = np.arange(radius + 1)
            half = np.append(np.rint(radius * np.sqrt((radius * radius - r**2) / float(radius * radius))), -1).astype(np.int32)
            out[k, some] = (dc <= half[np.minimum(dr, radius + 1)]).any(axis=1).sum(axis=1)
    return out


# Neighbours and components -------------------------------------------------------------


def neighbours(p: Points) -> np.ndarray:
    """Number of 8-neighbours of each pixel, anywhere in the plane; glyphs' pixels are distinct."""
    if not len(p.row):
        return np.zeros(0, np.int32)
    # Rows and columns are numbered with gaps of at most two, so that codes stay small.
    row, col = (_numbered(v) for v in (p.row, p.col))
    w, h = int(col.max()) + 3, int(row.max()) + 3
    code = (p.of * h + row + 1) * w + col + 1
    order = np.argsort(code, kind="stable")
    code = code[order]
    count = np.zeros(len(code), np.int32)
    for a, b in EIGHT:
        want = code + a * w + b
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        count += code[at] == want
    out = np.empty_like(count)
    out[order] = count
    return out


def _numbered(values: np.ndarray) -> np.ndarray:
    """Values moved together, where neighbours stay neighbours and others stay apart."""
    known, at = np.unique(values, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(known), 2))])[at]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (u, v) join it to."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        live = a != b
        if not live.any():
            return root
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def linked(masks: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Component of each set cell of canvases, in row order, under the steps in either direction."""
    pad = max(max(abs(a), abs(b)) for a, b in steps)
    wide = np.pad(masks, ((0, 0), (pad, pad), (pad, pad)))
    at = np.flatnonzero(wide)
    number = np.full(wide.size, -1, np.int32)
    number[at] = np.arange(len(at))
    found = [(np.flatnonzero(to >= 0), to) for a, b in steps if (a, b) > (0, 0) for to in [number[np.minimum(at + a * wide.shape[2] + b, wide.size - 1)]]]
    return roots(len(at), np.concatenate([i for i, _ in found]), np.concatenate([to[i] for i, to in found]))


def component_sizes(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of each glyph's 8-connected components, largest first, and how many there are."""
    sizes, counts = [], np.zeros(len(p), np.int64)
    for at, masks in p.canvases():
        of = of_masks(masks).of
        n = np.bincount(linked(masks, EIGHT), minlength=len(of))
        first = np.flatnonzero(n)
        order = np.lexsort((-n[first], of[first]))
        sizes.append(n[first][order])
        counts[at : at + len(masks)] = np.bincount(of[first], minlength=len(masks))
    return np.concatenate(sizes) if sizes else np.zeros(0, np.int64), counts


#: Crosses of pixels this near to each other touch.
NEAR = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if 0 < abs(a) + abs(b) <= 3]


def loops(masks: np.ndarray) -> np.ndarray:
    """As ``ink.loops``: components of the ink dilated by a cross, less its Euler number."""
    of, root = of_masks(masks).of, linked(masks, NEAR)
    parts = np.bincount(of[np.unique(root)], minlength=len(masks))
    wide = masks.copy()
    wide[:, 1:] |= masks[:, :-1]
    wide[:, :-1] |= masks[:, 1:]
    wide[:, :, 1:] |= masks[:, :, :-1]
    wide[:, :, :-1] |= masks[:, :, 1:]
    # Of 4-connected ink: cells less their links, and squares of four cells.
    euler = wide.astype(np.int8)
    down, right = wide[:, :-1] & wide[:, 1:], wide[:, :, :-1] & wide[:, :, 1:]
    euler[:, :-1] -= down
    euler[:, :, :-1] -= right
    euler[:, :-1, :-1] += down[:, :, :-1] & down[:, :, 1:]
    return parts - euler.sum(axis=(1, 2), dtype=np.int64)


# Canvases ------------------------------------------------------------------------------

#: Neighbours in the order of the thinning rules, from above and clockwise.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


@functools.cache
def _thinning_rules() -> tuple[np.ndarray, np.ndarray]:
    """Of the 256 neighbourhoods, those whose middle goes in either half of a round."""
    n = [(np.arange(256) >> k) & 1 for k in range(8)]
    count = sum(n)
    turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
    either = (count >= 2) & (count <= 6) & (turns == 1)
    return either & (n[0] * n[2] * n[4] == 0) & (n[2] * n[4] * n[6] == 0), either & (n[0] * n[2] * n[6] == 0) & (n[0] * n[4] * n[6] == 0)


def thin(masks: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of canvases, which looks at the ink alone."""
    img = np.pad(masks, ((0, 0), (1, 1), (1, 1))).astype(np.uint8)
    flat, w = img.reshape(-1), img.shape[2]
    size = img[0].size if len(img) else 1
    at = np.flatnonzero(flat)
    while len(at):
        changed = np.zeros(len(img), bool)
        for rule in _thinning_rules():
            around = np.zeros(len(at), np.uint8)
            for k, (a, b) in enumerate(AROUND):
                around |= flat[at + a * w + b] << k
            gone = rule[around]
            flat[at[gone]] = 0
            changed[at[gone] // size] = True
            at = at[~gone]
        at = at[changed[at // size]]
    return img[:, 1:-1, 1:-1].astype(bool)


def background_distances(masks: np.ndarray) -> tuple[Points, np.ndarray]:
    """As ``ink.background_distance`` for the ink of canvases."""
    p = of_masks(masks)
    h, w = masks.shape[1:]
    best = np.full(len(p.row), np.inf)
    for r in range(1, h + w):
        todo = np.flatnonzero(best > r * r)
        if not len(todo):
            break
        row, col, of = p.row[todo], p.col[todo], p.of[todo]
        least = best[todo]
        for a in range(-r, r + 1):
            for b in {-r, r} if abs(a) < r else range(-r, r + 1):
                y, x = row + a, col + b
                inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                free = inside & ~masks[of, np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
                least[free] = np.minimum(least[free], a * a + b * b)
        best[todo] = least
    return p, np.where(np.isinf(best), 0.0, np.sqrt(best))


WINDOW = 7


@functools.cache
def _similarities() -> np.ndarray:
    """Similarity of two windows by x + 64 y + 4096 xy, their ink and the ink they share."""
    n = WINDOW * WINDOW
    key = np.arange(64**3)
    ux, uy, uxy = (((key >> shift) & 63).astype(float) / n for shift in (0, 6, 12))
    scale = n / (n - 1)
    vx, vy, vxy = (scale * (m - a * b) for m, a, b in ((ux, ux, ux), (uy, uy, uy), (uxy, ux, uy)))
    c1, c2 = 0.01**2, 0.03**2
    return (2 * ux * uy + c1) * (2 * vxy + c2) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))


def structural_similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``ink.structural_similarity`` of canvases: a window's value follows from three counts."""
    table, out = _similarities(), np.empty(len(x))
    for at in range(0, len(x), 8):
        i, j = x[at : at + 8], y[at : at + 8]
        z = i.astype(np.int32) + (j.astype(np.int32) << 6) + ((i & j).astype(np.int32) << 12)
        for axis in (1, 2):
            s = np.cumsum(z, axis=axis, dtype=np.int32)
            z = np.swapaxes(s, 1, axis)[:, WINDOW - 1 :].copy()
            z[:, 1:] -= np.swapaxes(s, 1, axis)[:, :-WINDOW]
            z = np.swapaxes(z, 1, axis)
        for k in range(len(i)):
            out[at + k] = table[np.ascontiguousarray(z[k])].mean()
    return out


def centred(p: Points, on: Points, every: np.ndarray | None = None) -> Points:
    """Glyphs moved so that the centroids meet; shifts under one pixel aren't applied, and
    what leaves the canvas is dropped. ``every`` counts pixels without place too."""
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = [on.sums(y) / on.sizes - p.sums(x) / (p.sizes if every is None else every) for x, y in ((p.row, on.row), (p.col, on.col))]
        far = np.sqrt(shift[0] ** 2 + shift[1] ** 2) >= 1.0
    step = [np.where(far, np.floor(s + 0.5), 0).astype(np.int64)[p.of] for s in shift]
    moved = Points(p.row + step[0], p.col + step[1], p.sizes)
    return moved.where((moved.row >= 0) & (moved.row < K.CANVAS) & (moved.col >= 0) & (moved.col < K.CANVAS))


# Sequences -------------------------------------------------------------------------------


def angular(p: Points, known: np.ndarray | None = None) -> np.ndarray:
    """Places of pixels by glyph, then by the angle around the centroid, row and column.

    Directions are reduced to lowest terms, so that equal ones have equal angles. Pixels that
    aren't known come last.
    """
    known = np.ones(len(p.row), bool) if known is None else known
    y, x = (p.sizes[p.of] * v - p.sums(np.where(known, v, 0)).astype(np.int64)[p.of] for v in (p.row, p.col))
    common = np.maximum(np.gcd(y, x), 1)
    angle = np.where(known, np.arctan2((y // common).astype(float), (x // common).astype(float)), np.inf)
    return np.lexsort((p.col, p.row, angle, p.of))


def by_angle(p: Points) -> Points:
    at = angular(p)
    return Points(p.row[at], p.col[at], p.sizes)


def even_places(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places within their sequences of at most ``most`` points spread evenly, and how many."""
    count = np.minimum(sizes, most)
    i = spread(np.zeros(len(sizes), np.int64), count)
    n = np.repeat(sizes, count)
    return np.where(n <= most, i, i * (n - 1) // (most - 1)), count


def evenly(p: Points, most: int = K.TRAJECTORY_POINTS) -> Points:
    at, count = even_places(p.sizes, most)
    at = at + np.repeat(p.starts, count)
    return Points(p.row[at], p.col[at], count)


def along_curves(p: Points, n: int = K.PROCRUSTES_POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(glyphs, n, 2) points of the closed curves, and which have a length."""
    out, usable = np.zeros((len(p), n, 2)), np.zeros(len(p), bool)
    k = np.arange(n)
    for some, at in p.groups():
        for i in range(0, len(some), max(1, CELLS // (n * at.shape[1]))):
            own, here = some[i : i + max(1, CELLS // (n * at.shape[1]))], at[i : i + max(1, CELLS // (n * at.shape[1]))]
            row, col = p.row[here].astype(float), p.col[here].astype(float)
            row2, col2 = np.roll(row, -1, axis=1), np.roll(col, -1, axis=1)
            step = np.sqrt((row2 - row) * (row2 - row) + (col2 - col) * (col2 - col))
            upto = np.cumsum(step, axis=1)
            start = np.concatenate([np.zeros((len(own), 1)), upto[:, :-1]], axis=1)
            unit = upto[:, -1] * (n - 1) / n / n
            usable[own] = unit > 0
            ends = np.ceil(upto / np.where(unit > 0, unit, 1.0)[:, None])
            seg = np.minimum((ends[:, None] <= k[:, None]).sum(axis=2), step.shape[1] - 1)
            pick = lambda v: np.take_along_axis(v, seg, 1)  # noqa: E731, B023
            share = (k * unit[:, None] - pick(start)) / (pick(step) + 1e-9)
            for axis, (a, b) in enumerate(((row, row2), (col, col2))):
                out[own, :, axis] = (1 - share) * pick(a) + share * pick(b)
    return out, usable


def disparities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Procrustes disparity of sets of points (glyphs, n, 2); undefined for sets in one place."""
    x, y = (z - z.mean(axis=1, keepdims=True) for z in (x, y))
    size = (x * x).sum(axis=(1, 2)) * (y * y).sum(axis=(1, 2))
    m = np.einsum("gki,gkj->gij", x, y)
    det = np.abs(m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, 1.0 - ((m * m).sum(axis=(1, 2)) + 2 * det) / size, K.UNDEFINED)


def directions(p: Points, segments: int = K.SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(glyphs, segments, 2) unit vectors of the equal runs that have a direction, in front,
    and their number."""
    size = np.maximum(1, p.sizes // segments)
    run = np.arange(segments)
    first = run * size[:, None]
    last = np.minimum(first + size[:, None], p.sizes[:, None]) - 1
    there = first < p.sizes[:, None]
    if not len(p.row):
        return np.zeros((len(p), segments, 2)), np.zeros(len(p), np.int64)
    at = [np.where(there, p.starts[:, None] + v, 0) for v in (first, last)]
    ends = np.stack([np.where(there, v[at[1]] - v[at[0]], 0) for v in (p.row, p.col)], axis=2).astype(float)
    norm = np.sqrt((ends**2).sum(axis=2))
    known = norm > 1e-9
    order = np.argsort(~known, axis=1, kind="stable")
    unit = ends / np.where(known, norm, 1.0)[:, :, None]
    return np.take_along_axis(unit, order[:, :, None], 1), known.sum(axis=1)


def mean_cosines(a: Points, b: Points) -> np.ndarray:
    """Mean cosine of paired runs of ordered glyphs, NaN where there are none."""
    (x, n), (y, m) = directions(a), directions(b)
    k = np.minimum(n, m)
    dot = np.clip((x * y).sum(axis=2), -1, 1)
    total = np.where(np.arange(dot.shape[1]) < k[:, None], dot, 0.0).sum(axis=1)
    return np.where(k > 0, total / np.maximum(k, 1), np.nan)


def banded_dtw(p: Points, a: Points, band_ratio: float = K.BAND_RATIO, most: int = 256) -> np.ndarray:
    """As ``sequence.banded_dtw`` for each pair of ordered glyphs; cells that don't depend on
    each other, of all pairs, are filled together."""
    out = np.full(len(p), K.UNDEFINED)
    both = np.flatnonzero((p.sizes > 0) & (a.sizes > 0))
    both = both[np.argsort(np.maximum(p.sizes, a.sizes)[both], kind="stable")]
    at = 0
    while at < len(both):
        some = both[at : at + max(1, min(most, CELLS * 16 // int(max(p.sizes[both[at:]].max(), a.sizes[both[at:]].max())) ** 2))]
        at += len(some)
        out[some] = _dtw(_padded(p, some, 0), _padded(a, some, 0), p.sizes[some], a.sizes[some], band_ratio)
    return out


def _dtw(p, a, n: np.ndarray, m: np.ndarray, band_ratio: float) -> np.ndarray:
    pr, pc_, ar, ac = (np.ascontiguousarray(v.T, dtype=float) for v in (*p[:2], *a[:2]))
    rows, cols, count = len(pr), len(ar), len(n)
    band = np.maximum(1, (np.maximum(n, m) * band_ratio).astype(np.int64))
    wide, each = int(band.max()), np.arange(count)
    unreached = 1e9
    end, edge = np.full(count, np.inf), np.full(count, np.inf)
    open_ended = (np.abs(n - m) > band).any()
    # Row i + 1 of a diagonal is the cell (i, k - i); row 0 stands for the cells that don't exist.
    before = last = np.full((rows + 1, count), np.inf)
    for k in range(rows + cols - 1):
        lo, hi = max(0, k - cols + 1, -((wide - k) // 2)), min(rows - 1, k, (k + wide) // 2)
        now = np.full((rows + 1, count), np.inf)
        if lo <= hi:
            i = np.arange(lo, hi + 1)[:, None]
            j = k - i
            cost = np.sqrt((pr[lo : hi + 1] - ar[k - hi : k - lo + 1][::-1]) ** 2 + (pc_[lo : hi + 1] - ac[k - hi : k - lo + 1][::-1]) ** 2)
            least = np.minimum(np.minimum(last[lo : hi + 1], last[lo + 1 : hi + 2]), before[lo : hi + 1])
            least = np.where(np.isinf(least), unreached, least) if k else np.zeros_like(least)
            now[lo + 1 : hi + 2] = np.where((i < n) & (j < m) & (np.abs(i - j) <= band), cost + least, np.inf)
        done = np.flatnonzero(n + m - 2 == k)
        end[done] = now[n[done], done]
        if open_ended:
            edge = np.minimum(edge, now[n, each])
            on = k - m + 2
            edge = np.minimum(edge, np.where((on >= 1) & (on <= n), now[np.clip(on, 0, rows), each], np.inf))
        before, last = last, now
    end = np.where(np.isinf(end), edge, end)
    return np.where(end >= unreached, K.UNDEFINED, end / np.maximum(n, m))
