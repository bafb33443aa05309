"""Numpy kernels that the operators run inside Spark tasks, one group or batch at a time."""

from __future__ import annotations

import numpy as np

EPS = 1e-12


def rows(column) -> np.ndarray:
    """A column of arrays as a matrix; arrays of different lengths are an error."""
    sizes = {len(v) for v in column}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    return np.array([np.asarray(v, np.float64) for v in column]).reshape(len(column), sizes.pop() if sizes else 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), EPS)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def self_correlate(x: np.ndarray, scaling: float, center: bool, block: int = 1024) -> np.ndarray:
    """Weighted sums of rows by their cosine to each row, in row blocks; negatives (under -1e-12) weigh nothing.

    The mean of the whole cosine matrix is |sum of unit rows|^2 / n^2, so it needs no matrix.
    """
    u = unit(x)
    mean = float((u.sum(0) ** 2).sum()) / len(u) ** 2 if center else 0.0
    out = np.empty_like(x)
    for lo in range(0, len(u), block):
        s = (u[lo : lo + block] @ u.T - mean) * scaling
        s = np.where(s < -1e-12, -np.inf, np.maximum(s, 0))
        out[lo : lo + block] = softmax(s) @ x
    return out


def recursive_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, scaling: float) -> np.ndarray:
    """Multi-head attention output, whose cosine self-similarity (no mean taken off) then weighs the original v."""
    d = q.shape[1] // heads
    cut = lambda m, h: m[:, h * d : (h + 1) * d]
    mixed = np.concatenate([softmax(cut(q, h) @ cut(k, h).T * d**-0.5) @ cut(v, h) for h in range(heads)], 1)
    u = unit(mixed)
    out = np.empty_like(v)
    for lo in range(0, len(u), 1024):
        s = u[lo : lo + 1024] @ u.T * scaling
        out[lo : lo + 1024] = softmax(np.where(s < -1e-12, -np.inf, np.maximum(s, 0))) @ v
    return out


def _axis(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target place along an axis the two source places and the second's weight."""
    src = np.maximum((np.arange(out) + 0.5) * n / out - 0.5, 0)
    low = np.minimum(np.floor(src).astype(int), n - 1)
    return low, np.minimum(low + 1, n - 1), src - low


def bilinear(maps: np.ndarray, h: int, w: int) -> np.ndarray:
    """Maps (k, y, x) on an h x w grid."""
    y0, y1, fy = _axis(maps.shape[1], h)
    x0, x1, fx = _axis(maps.shape[2], w)
    top, low = maps[:, y0], maps[:, y1]
    across = lambda m: m[:, :, x0] * (1 - fx) + m[:, :, x1] * fx
    return across(top) * (1 - fy)[:, None] + across(low) * fy[:, None]


def all_corners(there: np.ndarray, h: int, w: int) -> np.ndarray:
    """For maps (k, y, x) of the places that are there: which cells of bilinear's h x w grid have all four of their source places."""
    (y0, y1, _), (x0, x1, _) = _axis(there.shape[1], h), _axis(there.shape[2], w)
    both = there[:, y0] & there[:, y1]
    return both[:, :, x0] & both[:, :, x1]


def bilinear_rows(strip: np.ndarray, top: int, n: int, h: int, w: int, rows: np.ndarray) -> np.ndarray:
    """Some rows of what bilinear gives for maps of n rows, from a strip (k, y, x) that begins at row `top` of the maps."""
    y0, y1, fy = (a[rows] for a in _axis(n, h))
    x0, x1, fx = _axis(strip.shape[2], w)
    across = lambda m: m[:, :, x0] * (1 - fx) + m[:, :, x1] * fx
    return across(strip[:, y0 - top]) * (1 - fy)[:, None] + across(strip[:, y1 - top]) * fy[:, None]


def range_max(grid: np.ndarray, y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Greatest value in each box of cells y1 <= y < y2, x1 <= x < x2 (none empty), by four reads of a table of maxima.

    Level (a, b) of the table holds the maxima of 2^a x 2^b cells. Levels follow from each other by one doubling and are kept only while boxes of their
    size are answered, so memory is a few grids.
    """
    out = np.empty(len(y1))
    up, along = (np.frexp(n)[1] - 1 for n in (y2 - y1, x2 - x1))
    tall = grid
    for a in range(int(up.max(initial=0)) + 1):
        if a:
            tall = np.maximum(tall[: -(1 << (a - 1))], tall[1 << (a - 1) :])
        wide, left = tall, np.flatnonzero(up == a)
        for b in range(int(along[left].max(initial=-1)) + 1):
            if b:
                wide = np.maximum(wide[:, : -(1 << (b - 1))], wide[:, 1 << (b - 1) :])
            i = left[along[left] == b]
            if len(i):
                ya, yb, xa, xb = y1[i], y2[i] - (1 << a), x1[i], x2[i] - (1 << b)
                out[i] = np.maximum(np.maximum(wide[ya, xa], wide[ya, xb]), np.maximum(wide[yb, xa], wide[yb, xb]))
    return out


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Region numbers from 1 in raster order of the first cell, 0 outside; cells touching at corners join if asked."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    a, b = [], []
    for dy, dx in steps:
        p = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        q = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = mask[p] & mask[q]
        a.append(label[p][both])
        b.append(label[q][both])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(h * w + 1)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    top = root[label]
    top[~mask] = -1
    found = np.unique(top[mask])
    return np.where(mask, np.searchsorted(found, top) + 1, 0)


def place_keys(own: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each place (own, y, x), in their order, and the step of a row; own are group numbers in order.

    Groups and rows lie apart, so numbers that differ by 1, or by a row and 1 at most, are places that touch.
    """
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    y, x = (c - np.repeat(np.minimum.reduceat(c, begin), np.diff(np.append(begin, len(own)))) for c in (y.astype(np.int64), x.astype(np.int64)))
    height, width = int(y.max()) + 2, int(x.max()) + 2
    if len(begin) * height * width >= 1 << 62:
        raise ValueError(f"groups that span {height - 1} x {width - 1} places are too wide")
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(own))))
    return (number * height + y) * width + x, width


def touching(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indexes) of places that touch, also at corners, of sorted distinct keys of place_keys."""
    right = np.flatnonzero(keys[1:] == keys[:-1] + 1)
    a, b = [right], [right + 1]
    below, own = np.searchsorted(keys, keys + (width - 1)), np.arange(len(keys))
    for step in range(3):
        at = own[below + step < len(keys)]
        at = at[keys[below[at] + step] <= keys[at] + (width + 1)]
        a.append(at)
        b.append(below[at] + step)
    return np.concatenate(a), np.concatenate(b)


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        p, q = root[a], root[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up
    return root


def outer_components(mask: np.ndarray) -> np.ndarray:
    """Like components, but regions that lie in a hole of another one are left out (0)."""
    label = components(mask)
    around = components(~np.pad(mask, 1), corners=False)
    outside = around == around[0, 0]
    touch = np.zeros_like(outside)
    touch[1:] |= outside[:-1]
    touch[:-1] |= outside[1:]
    touch[:, 1:] |= outside[:, :-1]
    touch[:, :-1] |= outside[:, 1:]
    seen = np.unique(label[touch[1:-1, 1:-1]])
    return np.where(np.isin(label, seen), label, 0)


def nms(boxes: np.ndarray, score: np.ndarray, order: np.ndarray, iou: float) -> np.ndarray:
    """Which boxes (x1, y1, x2, y2) stay: by score, then order; one is dropped if its IoU with a kept one is greater than iou."""
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    keep = np.zeros(len(boxes), bool)
    alive = np.ones(len(boxes), bool)
    for i in np.lexsort((order, -score)):
        if not alive[i]:
            continue
        keep[i] = True
        w = np.minimum(boxes[i, 2], boxes[:, 2]) - np.maximum(boxes[i, 0], boxes[:, 0])
        h = np.minimum(boxes[i, 3], boxes[:, 3]) - np.maximum(boxes[i, 1], boxes[:, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        whole = area + area[i] - both
        alive &= ~(np.divide(both, whole, out=np.zeros_like(both), where=whole > 0) > iou)
    return keep


def kmeans(x: np.ndarray, centers: np.ndarray, iters: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: last centers, and the labels of the assignment made before the last update."""
    u, c = unit(x), unit(centers)
    label = np.zeros(len(u), np.int64)
    for _ in range(iters):
        label = (u @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, u)
        new = unit(sums)
        shift = 1 - (c * new).sum(1).mean()
        c = new
        if shift < tol:
            break
    return c, label
