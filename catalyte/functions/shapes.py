"""Shapes in binary masks: morphology, regions, their outer borders, and exact distances.

Everything works on one image inside a task, in time linear in its pixels, and depends on
numpy alone. Masks are boolean arrays (height, width); what lies outside counts as False.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _nearby(mask: np.ndarray, combine, outside: bool) -> np.ndarray:
    """Combine each pixel with its eight neighbours: rows first, then columns."""
    p = np.pad(mask, 1, constant_values=outside)
    rows = combine(combine(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    return combine(combine(rows[:-2], rows[1:-1]), rows[2:])


def dilated(mask: np.ndarray) -> np.ndarray:
    return _nearby(mask, np.logical_or, False)


def eroded(mask: np.ndarray) -> np.ndarray:
    """The image's edge does not eat into a mask that reaches it."""
    return _nearby(mask, np.logical_and, True)


def closed(mask: np.ndarray) -> np.ndarray:
    """Gaps narrower than the 3 x 3 square are filled."""
    return eroded(dilated(mask))


def opened(mask: np.ndarray) -> np.ndarray:
    """Parts that do not hold the 3 x 3 square go."""
    return dilated(eroded(mask))


def regions(mask: np.ndarray, *, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """(labels, count): the connected regions numbered from 1 in the order of their first pixel, 0 elsewhere.

    Runs of a row are joined with those they touch in the row above.
    """
    reach = int(diagonal)
    parent: list[int] = [0]
    runs: list[tuple[int, int, int, int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            own = len(parent)
            parent.append(own)
            while at < len(above) and above[at][1] + reach <= a:
                at += 1
            k = at
            while k < len(above) and above[k][0] < b + reach:
                r, m = root(above[k][2]), root(own)
                if r != m:
                    parent[max(r, m)] = min(r, m)
                k += 1
            here.append((a, b, own))
            runs.append((y, a, b, own))
        above = here
    labels, numbers = np.zeros(mask.shape, np.int32), {}
    for y, a, b, own in runs:
        labels[y, a:b] = numbers.setdefault(root(own), len(numbers) + 1)
    return labels, len(numbers)


#: Steps to the eight neighbours, clockwise from the right.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def border(region: np.ndarray) -> np.ndarray:
    """The outer border of one 8-connected region as (row, column) of its pixels, once around clockwise.

    From the topmost leftmost pixel the border is followed with the outside to the left. It
    is back when it is about to repeat its first step; thin parts are passed on both sides.
    """
    padded = np.pad(region, 1)
    width, flat = padded.shape[1], padded.ravel()
    start = int(flat.argmax())
    if not flat[start]:
        return np.zeros((0, 2), np.int64)
    steps, cells = [dy * width + dx for dy, dx in STEPS], flat.tobytes()
    path, here, way, first = [start], start, 0, None
    while True:
        for k in range(8):
            turn = (way + 5 + k) % 8  # the first after the one it came from
            if cells[here + steps[turn]]:
                break
        else:
            break  # a single pixel
        move = (here, turn)
        if first is None:
            first = move
        elif move == first:
            path.pop()
            break
        here, way = here + steps[turn], turn
        path.append(here)
    at = np.array(path)
    return np.stack([at // width - 1, at % width - 1], 1)


def enclosed_area(path: np.ndarray) -> float:
    """The area inside a closed path through pixel centres."""
    y, x = path[:, 0].astype(np.float64), path[:, 1].astype(np.float64)
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def path_length(path: np.ndarray) -> float:
    """The length of a closed path."""
    return float(np.hypot(*(np.roll(path, -1, 0) - path).T).sum())


@dataclass
class Shape:
    """A region: its place, filled mask within that, and the measures of its outer border."""

    rows: slice
    columns: slice
    filled: np.ndarray
    area: float
    perimeter: float

    @property
    def aspect(self) -> float:
        h, w = self.filled.shape
        return max(h, w) / min(h, w)

    @property
    def circularity(self) -> float:
        """1 for a disc, small for what is long or ragged."""
        return 4 * np.pi * self.area / (self.perimeter**2 + 1e-6)


def filled(region: np.ndarray) -> np.ndarray:
    """The region with its holes: all that its outside cannot reach, four ways."""
    outside, _ = regions(~np.pad(region, 1), diagonal=False)
    return (outside != outside[0, 0])[1:-1, 1:-1] if region.size else region


def shapes(mask: np.ndarray, least: float = 0.0) -> list[Shape]:
    """The outermost regions whose borders enclose an area of ``least`` or more.

    A region inside a hole of another is part of that one's filled mask and no shape of its own.
    """
    labels, count = regions(mask)
    sizes = np.bincount(labels.ravel(), minlength=count + 1)
    y, x = np.nonzero(labels)
    own = labels[y, x]
    low, high = np.full((count + 1, 2), np.iinfo(np.int64).max), np.full((count + 1, 2), -1)
    for axis, at in enumerate((y, x)):
        np.minimum.at(low[:, axis], own, at)
        np.maximum.at(high[:, axis], own, at)
    inside = np.zeros(mask.shape, bool)
    out = []
    # the outer one of two nested regions has the smaller first row, so it comes first
    for k in range(1, count + 1):
        rows, columns = slice(low[k, 0], high[k, 0] + 1), slice(low[k, 1], high[k, 1] + 1)
        box = labels[rows, columns] == k
        if inside[rows, columns][box][0]:
            continue
        # a border encloses less than the box does
        if sizes[k] < 2 or (box.shape[0] - 1) * (box.shape[1] - 1) < least:
            continue
        whole = filled(box)
        inside[rows, columns] |= whole
        path = border(box)
        area = enclosed_area(path)
        if area >= least:
            out.append(Shape(rows, columns, whole, area, path_length(path)))
    return out


def distances(mask: np.ndarray) -> np.ndarray:
    """For every pixel the exact Euclidean distance to the nearest False one.

    Distances along columns first, then the lower envelope of one parabola a column, kept
    for all rows at once; each parabola enters and leaves once. Where nothing is False the
    distance is the sum of the sides.
    """
    h, w = mask.shape
    if not mask.size:
        return np.zeros(mask.shape)
    far = h + w
    g = np.where(mask, far, 0).astype(np.int64)
    for y in range(1, h):
        np.minimum(g[y], g[y - 1] + 1, out=g[y])
    for y in range(h - 2, -1, -1):
        np.minimum(g[y], g[y + 1] + 1, out=g[y])
    g = np.minimum(g, far)
    square = g * g
    every = np.arange(h)
    place, since, top = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64), np.zeros(h, np.int64)
    for u in range(1, w):
        live = every
        while len(live):
            q = top[live]
            s, t = place[live, q], since[live, q]
            worse = (t - s) ** 2 + square[live, s] > (t - u) ** 2 + square[live, u]
            live = live[worse]
            top[live] -= 1
            live = live[top[live] >= 0]
        none = top < 0
        top[none], place[none, 0] = 0, u
        rest = every[~none]
        s = place[rest, top[rest]]
        w_at = 1 + (u * u - s * s + square[rest, u] - square[rest, s]) // (2 * (u - s))
        on = rest[w_at < w]
        top[on] += 1
        place[on, top[on]], since[on, top[on]] = u, w_at[w_at < w]
    out = np.empty((h, w))
    for u in range(w - 1, -1, -1):
        s = place[every, top]
        out[:, u] = (u - s) ** 2 + square[every, s]
        top = np.where((since[every, top] == u) & (top > 0), top - 1, top)
    return np.minimum(np.sqrt(out), far)


def ridge(distance: np.ndarray) -> np.ndarray:
    """Where the distance is as large as anywhere beside it: the middle line of what is long."""
    p = np.pad(distance, 1, constant_values=-1.0)
    rows = np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:])
    return (distance > 0) & (distance >= np.maximum(np.maximum(rows[:-2], rows[1:-1]), rows[2:]))


def smoothed(x: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean over a square of ``size`` (odd), edges reflected; its spread follows from the size."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        n = x.shape[axis]
        p = np.pad(x, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if n > half else "edge")
        x = sum(k * (p[j : j + n] if axis == 0 else p[:, j : j + n]) for j, k in enumerate(kernel))
    return x
