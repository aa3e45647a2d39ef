"""Kernels over the pixels of one page, in numpy; they run in Python functions over binary columns.

Pages come as raw grey or colour arrays (height, width[, 3]) of bytes. Decoding pictures, fonts and
inpainting need libraries that are not here and are left out.
"""

from __future__ import annotations

import numpy as np

# Limits of cleaning and of the proof that artwork stayed.
FLAT_SPREAD, LEAST_SAMPLE, GRID = 9.0, 24, 8


def otsu(grey: np.ndarray) -> int:
    """The threshold that parts two classes of grey best; values above it are the lighter class."""
    count = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, weight = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (weight[-1] * below / below[-1] - weight) ** 2 / (below * above)
    return int(np.nanargmax(np.where(below * above > 0, between, -1.0)))


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 of connected set pixels, and how many there are.

    Runs of each row are joined with the runs that they touch in the row above, so the work is in
    the number of runs, not of pixels.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(parent))], dtype=np.int64)
    names, numbers = np.unique(roots, return_inverse=True)
    labels = np.zeros((h, w), dtype=np.int32)
    for y, a, b, n in zip(rows, starts, ends, numbers):
        labels[y, a:b] = n + 1
    return labels, len(names)


def component_boxes(labels: np.ndarray, many: int) -> np.ndarray:
    """x, y, w, h and area of each label."""
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs] - 1
    lo = np.full((many, 2), np.iinfo(np.int64).max)
    hi = np.zeros((many, 2), dtype=np.int64)
    np.minimum.at(lo, own, np.stack([xs, ys], axis=1))
    np.maximum.at(hi, own, np.stack([xs, ys], axis=1))
    return np.concatenate([lo, hi - lo + 1, np.bincount(own, minlength=many)[:, None]], axis=1)


def enclosed(mask: np.ndarray) -> np.ndarray:
    """Pixels that are not set and cannot reach the border without crossing set ones."""
    labels, many = components(~mask.astype(bool), diagonal=False)
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    open_ = np.zeros(many + 1, dtype=bool)
    open_[edge] = True
    open_[0] = True
    return ~open_[labels]


def filled(mask: np.ndarray, longest_side: int) -> np.ndarray:
    """The mask with holes filled whose boxes have no side above ``longest_side``."""
    labels, many = components(enclosed(mask), diagonal=False)
    if not many:
        return mask.astype(bool)
    boxes = component_boxes(labels, many)
    small = np.concatenate([[False], boxes[:, 2:4].max(axis=1) <= longest_side])
    return mask.astype(bool) | small[labels]


def grown(mask: np.ndarray, by: int) -> np.ndarray:
    """The mask spread by a square of side 2 * by + 1."""
    out = np.pad(mask.astype(bool), by)
    for axis in (0, 1):
        total = np.cumsum(np.insert(out.astype(np.int32), 0, 0, axis=axis), axis=axis)
        span = 2 * by + 1
        lead = [slice(None)] * 2
        lag = [slice(None)] * 2
        lead[axis], lag[axis] = slice(span, None), slice(None, -span)
        out = (total[tuple(lead)] - total[tuple(lag)]) > 0
    return out


def run_lengths(mask: np.ndarray) -> np.ndarray:
    """Length of the row run through each set pixel, from nearest gaps on either side."""
    h, w = mask.shape
    at = np.broadcast_to(np.arange(w), (h, w))
    left = np.maximum.accumulate(np.where(mask, -1, at), axis=1)
    right = np.minimum.accumulate(np.where(mask, w, at)[:, ::-1], axis=1)[:, ::-1]
    return np.where(mask, right - left - 1, 0)


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """Longest run of set pixels of each row."""
    return run_lengths(mask.astype(bool)).max(axis=1, initial=0)


def band_span(mask: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest run of columns set in all rows."""
    full = mask.astype(bool).all(axis=0, keepdims=True)
    runs = run_lengths(full)[0]
    if not runs.max(initial=0):
        return 0, 0
    return int(runs.argmax()), int(runs.max())


def cuts(ink: np.ndarray, axis: int, most_ink: float, span: int) -> list[tuple[int, int]]:
    """Runs of near-empty rows (axis 0) or columns (axis 1), ``span`` or longer."""
    empty = (ink.mean(axis=1 - axis) <= most_ink)[None, :]
    runs = run_lengths(empty)[0]
    starts = np.flatnonzero(empty[0] & ~np.concatenate(([False], empty[0, :-1])))
    return [(int(s), int(runs[s])) for s in starts if runs[s] >= span]


def panels(ink: np.ndarray, most_ink: float = 0.008, span: int = 6, depth: int = 6) -> list[tuple[int, int, int, int]]:
    """Boxes left by cutting along gutters, rows first, again and again."""
    rows = np.flatnonzero(ink.any(axis=1))
    cols = np.flatnonzero(ink.any(axis=0))
    if not len(rows):
        return []
    y, x = int(rows[0]), int(cols[0])
    inner = ink[y : rows[-1] + 1, x : cols[-1] + 1]
    if depth:
        for axis in (0, 1):
            gaps = cuts(inner, axis, most_ink, span)
            if gaps:
                out, start = [], 0
                for s, n in [*gaps, (inner.shape[axis], 0)]:
                    part = inner[start:s] if axis == 0 else inner[:, start:s]
                    dy, dx = (start, 0) if axis == 0 else (0, start)
                    out += [(x + dx + a, y + dy + b, w, h) for a, b, w, h in panels(part, most_ink, span, depth - 1)]
                    start = s + n
                return out
    return [(x, y, inner.shape[1], inner.shape[0])]


def appearance(grey: np.ndarray) -> np.ndarray:
    """Means of an 8x8 grid of boxes: a small picture to compare by eye-size differences."""
    h, w = grey.shape
    ys, xs = (np.linspace(0, n, GRID + 1).astype(int) for n in (h, w))
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(grey.astype(np.float64), axis=0), axis=1)
    sums = total[np.ix_(ys[1:], xs[1:])] - total[np.ix_(ys[:-1], xs[1:])] - total[np.ix_(ys[1:], xs[:-1])] + total[np.ix_(ys[:-1], xs[:-1])]
    return np.rint(sums / np.maximum(1, np.outer(np.diff(ys), np.diff(xs)))).astype(np.uint8)


def difference(one: np.ndarray, other: np.ndarray) -> float:
    """Mean absolute difference of two grids."""
    return float(np.abs(one.astype(np.int16) - other.astype(np.int16)).mean())


def strategy(window: np.ndarray, mask: np.ndarray) -> tuple[str, list[float]]:
    """`flat` with its colour if what is not masked varies little, else `inpaint`; `refuse` with too little to go by."""
    sample = window[~mask.astype(bool)]
    if len(sample) < LEAST_SAMPLE:
        return "refuse", []
    sample = sample.reshape(len(sample), -1).astype(np.float64)
    return ("flat" if sample.std(axis=0).max() <= FLAT_SPREAD else "inpaint"), [float(v) for v in sample.mean(axis=0)]


def composite(base: np.ndarray, repaired: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``repaired`` where the mask is, by its weight of 0 to 255; elsewhere not a byte changes."""
    weight = mask.astype(np.float64) / 255
    if base.ndim == 3:
        weight = weight[..., None]
    return np.rint(base * (1 - weight) + repaired * weight).astype(np.uint8)


def changed_outside(before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> tuple[int, int, int]:
    """Pixels that changed outside the mask, pixels outside, and the worst change."""
    out = ~mask.astype(bool)
    delta = np.abs(before.astype(np.int16) - after.astype(np.int16))
    worst = delta if delta.ndim == 2 else delta.max(axis=2)
    return int((worst[out] > 0).sum()), int(out.sum()), int(worst[out].max(initial=0))


def surviving_ink(before: np.ndarray, after: np.ndarray, mask: np.ndarray, threshold: int = 128) -> float:
    """Share of the dark pixels outside the mask that are still dark."""
    ink = (before < threshold) & ~mask.astype(bool)
    return float((ink & (after < threshold)).sum() / ink.sum()) if ink.any() else 0.0


def union_mask(masks: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The larger value at every place, and the share of it that is set."""
    whole = np.maximum.reduce(masks)
    return whole, float((whole > 0).mean())


def tilt(mask: np.ndarray) -> tuple[float, float]:
    """Angle in degrees of the main axis of the set pixels and the ratio of the axes."""
    ys, xs = np.nonzero(mask)
    if len(xs) < 2:
        return 0.0, 1.0
    values, vectors = np.linalg.eigh(np.cov(np.stack([xs, ys]).astype(np.float64)))
    vx, vy = vectors[:, 1]
    return float(np.degrees(np.arctan2(vy, vx)) % 180), float(np.sqrt(max(values[0], 0) / values[1])) if values[1] else 1.0
