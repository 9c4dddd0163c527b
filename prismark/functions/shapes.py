"""Shape descriptors of one mask (numpy): contours, hulls, moments, Fourier, shape context, silhouettes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


RING = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))  # clockwise from the west


def regions(on: np.ndarray) -> list[list[tuple[int, int]]]:
    """The 8-connected regions of a mask that has a margin of background."""
    left, out = on.copy(), []
    for y, x in np.argwhere(on):
        if not left[y, x]:
            continue
        left[y, x] = False
        todo, region = [(int(y), int(x))], []
        while todo:
            at = todo.pop()
            region.append(at)
            for dy, dx in RING:
                to = at[0] + dy, at[1] + dx
                if left[to]:
                    left[to] = False
                    todo.append(to)
        out.append(region)
    return out


def _border(on: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """The outer border from its topmost, leftmost pixel, clockwise; ends when the first move is about to come again."""
    path, at, towards, first = [start], start, 1, None
    while True:
        turn = next((k for k in range(8) if on[at[0] + RING[(towards + k) % 8][0], at[1] + RING[(towards + k) % 8][1]]), None)
        if turn is None:
            break  # a single pixel
        d = (towards + turn) % 8
        if at == start and d == first:
            path.pop()
            break
        first = d if first is None else first
        at = at[0] + RING[d][0], at[1] + RING[d][1]
        path.append(at)
        towards = (d + 6) % 8
    return np.array([(x - 1, y - 1) for y, x in path], dtype=float)


def contour(mask: np.ndarray) -> np.ndarray:
    """(n, 2) x, y points of the outer border that encloses the most; empty without foreground."""
    on = np.pad(mask > 0, 1)
    borders = [_border(on, min(r)) for r in regions(on)]
    return max(borders, key=area, default=np.zeros((0, 2)))


def area(points: np.ndarray) -> float:
    """Shoelace area of a closed polygon."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def arc_length(points: np.ndarray) -> float:
    return float(np.linalg.norm(points - np.roll(points, -1, axis=0), axis=1).sum()) if len(points) > 1 else 0.0


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, by monotone chains."""
    todo = sorted(set(map(tuple, points)))
    if len(todo) < 3:
        return np.array(todo, dtype=float).reshape(-1, 2)

    def chain(seq):
        out: list[tuple] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(todo) + chain(todo[::-1]), dtype=float)


def completeness(mask: np.ndarray) -> tuple[float, float, float, float] | None:
    """(solidity, extent, convexity, 0.4 / 0.3 / 0.3 mean); None without a contour or with no area."""
    c = contour(mask)
    a = area(c)
    if a <= 0:
        return None
    h = hull(c)
    w, t = c.max(axis=0) - c.min(axis=0) + 1
    solidity = a / area(h) if area(h) > 0 else 0.0
    extent = a / (w * t)
    convexity = min(max(arc_length(h) / arc_length(c), 0.0), 1.0) if arc_length(c) > 0 else 0.0
    return solidity, extent, convexity, 0.4 * solidity + 0.3 * extent + 0.3 * convexity


def hu_moments(mask: np.ndarray) -> np.ndarray:
    """Seven invariants of the binary mask as -sign(h) ln(|h| + 1e-10)."""
    on = (mask > 0).astype(float)
    m00 = on.sum()
    if m00 == 0:
        return -np.sign(np.zeros(7)) * np.log(1e-10)
    y, x = np.mgrid[: on.shape[0], : on.shape[1]]
    dx, dy = x - (on * x).sum() / m00, y - (on * y).sum() / m00
    n = lambda p, q: (on * dx**p * dy**q).sum() / m00 ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n21, n12, n03 = n(2, 0), n(0, 2), n(1, 1), n(3, 0), n(2, 1), n(1, 2), n(0, 3)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = np.array([n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)])
    return -np.sign(h) * np.log(np.abs(h) + 1e-10)


def _square(mask: np.ndarray, size: int) -> np.ndarray:
    """The mask on a size x size grid, each cell the mean of what it covers."""
    h, w = mask.shape

    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, size + 1)
        lo, hi = np.arange(n), np.arange(1, n + 1)
        cover = np.clip(np.minimum(edges[1:, None], hi) - np.maximum(edges[:-1, None], lo), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(h) @ mask.astype(float) @ weights(w).T


def _shorter_square(mask: np.ndarray) -> np.ndarray:
    """The whole mask on a square of its shorter side, by bilinear samples at cell middles."""
    on = (mask > 0).astype(float)
    s = min(on.shape)

    def weights(n: int) -> np.ndarray:
        at = np.clip((np.arange(s) + 0.5) * n / s - 0.5, 0, n - 1)
        return np.clip(1 - np.abs(at[:, None] - np.arange(n)[None, :]), 0, None)

    return weights(on.shape[0]) @ on @ weights(on.shape[1]).T


@lru_cache(maxsize=8)
def _zernike_basis(side: int, degree: int) -> np.ndarray:
    """(moments, side * side): radial polynomials times cosines (m >= 0) or sines (m < 0) on the unit disc, times (n + 1) / pi; without the first."""
    axis = np.linspace(-1, 1, side)
    rho, theta = np.hypot(axis[None, :], axis[:, None]).ravel(), np.arctan2(axis[:, None], axis[None, :]).ravel()
    powers = rho[None, :] ** np.arange(degree + 1)[:, None]
    rows = []
    for n in range(degree + 1):
        for m in range(-n, n + 1, 2):
            k = abs(m)
            radial = sum((-1) ** j * math.comb(n - j, j) * math.comb(n - 2 * j, (n - k) // 2 - j) * powers[n - 2 * j] for j in range((n - k) // 2 + 1))
            rows.append(radial * (np.cos(k * theta) if m >= 0 else np.sin(k * theta)) * (n + 1) / math.pi * (rho <= 1))
    return np.array(rows[1:])


def zernike(mask: np.ndarray, degree: int = 10) -> np.ndarray:
    """Absolute real Zernike moments of all (n, m) up to degree but the first, of the mask on a square of its shorter side."""
    return zernike_all(mask[None], degree)[0]


def zernike_all(masks: np.ndarray, degree: int = 10) -> np.ndarray:
    """Moments of a stack of equal masks, as one matrix product."""
    side = min(masks.shape[1:])
    squares = (masks > 0).astype(float) if masks.shape[1] == masks.shape[2] else np.stack([_shorter_square(m) for m in masks])
    return np.abs(squares.reshape(len(masks), -1) @ _zernike_basis(side, degree).T)


def fourier_descriptor(mask: np.ndarray, terms: int = 32) -> np.ndarray:
    """Magnitudes 1 to `terms` of the contour's transform, zero-padded, over their sum."""
    c = contour(mask)
    out = np.zeros(terms)
    if len(c):
        z = c[:, 0] + 1j * c[:, 1]
        part = np.abs(np.fft.fft(z - z.mean()))[1 : terms + 1]
        out[: len(part)] = part
    return out / out.sum() if out.sum() > 0 else out


def shape_context(mask: np.ndarray, samples: int = 64, radial: int = 5, angular: int = 12) -> np.ndarray:
    """Histogram of where contour points lie from their centroid, by distance (rings of equal width up to 1.05 times the largest)
    and angle, over its sum; shorter contours give fewer points. Zeros without a contour, or where all points are one."""
    c = contour(mask)
    if len(c) > samples:
        c = c[np.linspace(0, len(c) - 1, samples, dtype=int)]
    out = np.zeros((radial, angular))
    d = c - c.mean(axis=0) if len(c) else c
    far = np.linalg.norm(d, axis=1) if len(c) else np.zeros(0)
    if not len(c) or far.max() == 0:
        return out.ravel()
    ring = np.searchsorted(np.linspace(0, far.max(), radial + 1)[1:] * 1.05, far)
    wedge = np.searchsorted(np.linspace(-math.pi, math.pi, angular + 1)[1:], np.arctan2(d[:, 1], d[:, 0]))
    inside = (ring < radial) & (wedge < angular)
    np.add.at(out, (ring[inside], wedge[inside]), 1.0)
    return out.ravel() / (out.sum() + 1e-10)


def silhouette(mask: np.ndarray, size: int = 64) -> np.ndarray:
    """The cropped, square-padded mask on a size x size grid, flat and of length one; zeros without foreground."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros(size * size)
    crop = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] > 0
    s = max(crop.shape)
    padded = np.zeros((s, s))
    padded[(s - crop.shape[0]) // 2 :, (s - crop.shape[1]) // 2 :][: crop.shape[0], : crop.shape[1]] = crop
    flat = _square(padded, size).ravel()
    return flat / np.linalg.norm(flat)


#: Descriptors of whole stacks of equal masks.
STACKED = {"zernike": zernike_all}
DESCRIPTORS = {"hu": hu_moments, "zernike": zernike, "fourier": fourier_descriptor, "shape_context": shape_context, "silhouette": silhouette}


def describe(mask: np.ndarray, name: str) -> np.ndarray:
    if name not in DESCRIPTORS:
        raise ValueError(f"unknown descriptor {name!r}; known: {', '.join(DESCRIPTORS)}")
    return DESCRIPTORS[name](mask)


def describe_all(masks: np.ndarray, name: str) -> np.ndarray:
    return STACKED[name](masks) if name in STACKED else np.stack([describe(m, name) for m in masks])
