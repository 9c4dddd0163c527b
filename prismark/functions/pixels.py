"""Pixel kernels over stacks of equal frames: numpy arrays of shape (frames, height, width)."""

from __future__ import annotations

import math

import numpy as np


def foreground(mask: np.ndarray) -> np.ndarray:
    """Boolean foreground: above zero, in any channel where there are channels last."""
    on = mask > 0
    return on.any(axis=-1) if on.ndim == 4 else on


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey of RGB, 0 to 255: 0.299 R + 0.587 G + 0.114 B, rounded."""
    return np.floor(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]) + 0.5)


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) from the anchor of an elliptical element; size 3 is a plus."""
    r = size // 2
    out = []
    for i in range(size):
        dy = i - r
        if abs(dy) <= r:
            reach = round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
            out += [(dy, j - r) for j in range(max(r - reach, 0), min(r + reach + 1, size))]
    return out


def box(grow: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-grow, grow + 1) for dx in range(-grow, grow + 1)]


def _over(stack: np.ndarray, element: list[tuple[int, int]], outside, fold) -> np.ndarray:
    """fold of each pixel's neighbours; those beyond the frame count as outside."""
    n, h, w = stack.shape
    reach = max(max(abs(dy), abs(dx)) for dy, dx in element)
    wide = np.full((n, h + 2 * reach, w + 2 * reach), outside, dtype=stack.dtype)
    wide[:, reach : reach + h, reach : reach + w] = stack
    out = np.full_like(stack, outside)
    for dy, dx in element:
        out = fold(out, wide[:, reach + dy : reach + dy + h, reach + dx : reach + dx + w])
    return out


def dilate(on: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return _over(on, element, False, np.logical_or)


def erode(on: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return _over(on, element, True, np.logical_and)


def opened(on: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return dilate(erode(on, element), element)


def closed(on: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return erode(dilate(on, element), element)


def artifacts(on: np.ndarray, size: int) -> np.ndarray:
    return opened(on, ellipse(size)) ^ closed(on, ellipse(size))


def band(on: np.ndarray, size: int) -> np.ndarray:
    return dilate(on, ellipse(size)) ^ erode(on, ellipse(size))


def grow(on: np.ndarray, by: int) -> np.ndarray:
    return on if by <= 0 else dilate(on, box(by))


LAPLACE_4 = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
LAPLACE_8 = ((2, 0, 2), (0, -8, 0), (2, 0, 2))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def convolve3(gray: np.ndarray, kernel) -> np.ndarray:
    """3 x 3 correlation; beyond the frame it is mirrored about its outermost pixels."""
    wide = np.pad(gray.astype(float), ((0, 0), (1, 1), (1, 1)), mode="reflect")
    h, w = gray.shape[1:]
    return sum(kernel[dy][dx] * wide[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3) if kernel[dy][dx])


def gradient(gray: np.ndarray) -> np.ndarray:
    return np.sqrt(convolve3(gray, SOBEL_X) ** 2 + convolve3(gray, SOBEL_Y) ** 2)


def mean_in(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Mean of each frame's values inside, 0 where nothing is inside."""
    n = where.sum(axis=(1, 2))
    return np.where(n > 0, (values * where).sum(axis=(1, 2)) / np.maximum(n, 1), 0.0)


def variance_in(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Population variance of each frame's values inside, 0 where nothing is inside."""
    return mean_in((values - mean_in(values, where)[:, None, None]) ** 2, where)


def frame_stats(mask: np.ndarray, gray: np.ndarray, hand: np.ndarray, stroke: int, kernel: int, ring: int) -> dict[str, np.ndarray]:
    """All scalar statistics of each frame, in one pass."""
    on, other = foreground(mask), foreground(hand)
    n, h, w = on.shape
    total = on.sum(axis=(1, 2)).astype(float)
    part = lambda x, y: np.where(y > 0, x / np.maximum(y, 1), 0.0)
    rim = np.zeros((h, w), dtype=bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    edge = band(on, stroke)
    slope = gradient(gray)
    flat = np.ones_like(on)
    rows, cols = np.maximum(on.any(axis=2).sum(axis=1), 1), np.maximum(on.any(axis=1).sum(axis=1), 1)
    contact = {"top": on[:, 0, :].sum(axis=1) / cols, "bottom": on[:, -1, :].sum(axis=1) / cols, "left": on[:, :, 0].sum(axis=1) / rows, "right": on[:, :, -1].sum(axis=1) / rows}
    ys, xs = np.arange(h)[None, :, None], np.arange(w)[None, None, :]
    some = total > 0
    low = lambda at, far: np.where(some, np.where(on, at, far).min(axis=(1, 2)), 0)
    high = lambda at: np.where(some, np.where(on, at, -1).max(axis=(1, 2)), 0)
    inner = on & ~erode(on, box(ring))
    return {
        "pixel_count": total, "area_fraction": total / (h * w) if h * w else np.zeros(n), "touches_border": (on & rim).any(axis=(1, 2)).astype(float),
        "artifact_pixels": artifacts(on, kernel).sum(axis=(1, 2)).astype(float), "artifact_fraction": part(artifacts(on, kernel).sum(axis=(1, 2)), total),
        "band_pixels": edge.sum(axis=(1, 2)).astype(float), "laplacian": variance_in(convolve3(gray, LAPLACE_8), edge), "tenengrad": mean_in(slope, edge),
        "global_laplacian": variance_in(convolve3(gray, LAPLACE_4), flat), "global_tenengrad": mean_in(slope, flat),
        "border_ratio": part((on & rim).sum(axis=(1, 2)), total), **{f"edge_{k}_ratio": np.where(some, v, 0.0) for k, v in contact.items()}, "edge_ratio": np.where(some, np.max(list(contact.values()), axis=0), 0.0),
        "hand_overlap": part((on & other).sum(axis=(1, 2)), total),
        "y0": low(ys, h).astype(float), "x0": low(xs, w).astype(float), "y1": high(ys).astype(float), "x1": high(xs).astype(float),
        "cy": part((on * ys).sum(axis=(1, 2)), total), "cx": part((on * xs).sum(axis=(1, 2)), total),
        "rim_pixels": inner.sum(axis=(1, 2)).astype(float), "rim_brightness": mean_in(gray, inner),
    }


STATS = ("pixel_count", "area_fraction", "touches_border", "artifact_pixels", "artifact_fraction", "band_pixels", "laplacian", "tenengrad", "global_laplacian", "global_tenengrad", "border_ratio", "edge_top_ratio", "edge_bottom_ratio", "edge_left_ratio", "edge_right_ratio", "edge_ratio", "hand_overlap", "y0", "x0", "y1", "x1", "cy", "cx", "rim_pixels", "rim_brightness")


def bbox_crop(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The frame cut to the foreground's bounding box; without foreground the whole frame."""
    ys, xs = np.nonzero(mask)
    return image if not len(ys) else image[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]


def masked_crop(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    on = bbox_crop(mask, mask) > 0
    crop = bbox_crop(image, mask)
    return crop * (on[..., None] if crop.ndim == 3 else on)


def _lanczos(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """(size, n) weights of a separable Lanczos resize, widened when it shrinks."""
    scale = n / size
    wide = max(scale, 1.0)
    at = (np.arange(size) + 0.5) * scale
    d = (np.arange(n)[None, :] + 0.5 - at[:, None]) / wide
    weight = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def resize(square: np.ndarray, size: int) -> np.ndarray:
    """Lanczos resize of an (s, s[, channels]) image of bytes."""
    w = _lanczos(square.shape[0], size)
    out = np.tensordot(w, np.tensordot(w, square.astype(float), axes=(1, 1)), axes=(1, 1))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def square_pad(image: np.ndarray, fill: float) -> np.ndarray:
    h, w = image.shape[:2]
    s = max(h, w)
    out = np.full((s, s, *image.shape[2:]), fill, dtype=image.dtype)
    out[(s - h) // 2 : (s - h) // 2 + h, (s - w) // 2 : (s - w) // 2 + w] = image
    return out


def contrast_input(image: np.ndarray, mask: np.ndarray, background: int | None, by: int = 5, size: int = 224) -> np.ndarray:
    """The object (height, width, channels) on a plain background, square and resized. No background: the raw crop on zeros."""
    on, channels = mask > 0, image.shape[2]
    if background is None:
        return np.zeros((size, size, channels), np.uint8) if not on.any() else resize(square_pad(bbox_crop(image, on), 0), size)
    wide = grow(on[None], by)[0]
    if not wide.any():
        return np.full((size, size, channels), background, np.uint8)
    cut = np.where(wide[..., None], image, background).astype(np.uint8)
    return resize(square_pad(bbox_crop(cut, wide), background), size)


#: Alpha over the object, over the grown margin, and elsewhere (fixed values, of 255).
ALPHA = (1.0, 0.8, 0.66)


def region_alpha(mask: np.ndarray, by: int = 5, size: int = 224) -> np.ndarray:
    """Alpha that goes with contrast_input: object, grown margin and the rest, resized between neighbours so that values stay between them."""
    on = mask > 0
    wide = grow(on[None], by)[0]
    if not wide.any():
        return np.full((size, size), int(255 * ALPHA[2]), np.uint8)
    alpha = np.where(on, ALPHA[0], np.where(wide, ALPHA[1], ALPHA[2]))
    square = square_pad(bbox_crop(alpha, wide), ALPHA[2])
    w = _triangle(square.shape[0], size)
    return np.round(w @ square @ w.T * 255).astype(np.uint8)


def contrast_mask(mask: np.ndarray, by: int = 5, size: int = 224) -> np.ndarray:
    """The mask itself, not grown, in the geometry of contrast_input: 0 or 255."""
    on = mask > 0
    wide = grow(on[None], by)[0]
    if not wide.any():
        return np.zeros((size, size), np.uint8)
    square = square_pad(bbox_crop(np.where(on, 255, 0), wide), 0)
    return np.where(resize(square, size) > 127, 255, 0).astype(np.uint8)


def _triangle(n: int, size: int) -> np.ndarray:
    """(size, n) weights of a separable bilinear resize, widened when it shrinks."""
    scale = n / size
    at = (np.arange(size) + 0.5) * scale
    weight = np.clip(1 - np.abs(np.arange(n)[None, :] + 0.5 - at[:, None]) / max(scale, 1.0), 0, None)
    return weight / weight.sum(axis=1, keepdims=True)


def thumbnail_distance(a: np.ndarray, b: np.ndarray, size: int = 48) -> float:
    """Mean absolute difference of small grey pictures of two square frames."""
    return float(np.abs(resize(a, size).astype(float) - resize(b, size).astype(float)).mean())
