"""Pictures of a frame with its mask, as byte arrays and PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from prismark.functions import pixels

GREEN, RED, FRAME = (0, 255, 0), (200, 60, 60), (220, 60, 60)


def mix(image: np.ndarray, where: np.ndarray, color: tuple[int, int, int], share: float) -> np.ndarray:
    """image with `share` of a colour where the mask is on."""
    tinted = (1 - share) * image + share * np.array(color, dtype=float)
    return np.clip(np.where(where[..., None], tinted, image), 0, 255).astype(np.uint8)


def composite(image: np.ndarray, mask: np.ndarray, tint: float = 0.75, dim: float = 0.66) -> np.ndarray:
    """The object under a strong green tint, the background dimmed."""
    on = mask > 0
    faded = np.where(on[..., None], image, image * dim)
    return mix(faded, on, GREEN, tint)


def blend(image: np.ndarray, mask: np.ndarray, share: float = 0.5) -> np.ndarray:
    return mix(image, mask > 0, GREEN, share)


def feature(image: np.ndarray, mask: np.ndarray, stat: str) -> np.ndarray:
    """What a statistic looks at: artifacts in red, the boundary band lit on a dark frame, or a frame two pixels wide."""
    on = pixels.foreground(mask)
    if stat == "laplacian":
        lit = pixels.band(on[None], 9)[0]
        return np.where(lit[..., None], image, (image * 0.5).astype(np.uint8)).astype(np.uint8)
    out = blend(image, on, 0.45)
    if stat == "artifact_fraction":
        out[pixels.artifacts(on[None], 3)[0]] = RED
    elif stat in ("border_ratio", "edge_ratio"):
        inner = np.zeros_like(on)
        inner[2:-2, 2:-2] = True
        out[~inner] = FRAME
    return out


def png(image: np.ndarray) -> bytes:
    """A PNG file of (h, w) grey, (h, w, 3) RGB or (h, w, 4) RGBA bytes."""
    h, w = image.shape[:2]
    kind = 0 if image.ndim == 2 else {1: 0, 3: 2, 4: 6}[image.shape[2]]
    rows = image.astype(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tick(value: float | None, digits: int = 6) -> str:
    """A number written out, without an exponent or trailing zeros."""
    if value is None:
        return ""
    return f"{value:.{digits}f}".rstrip("0").rstrip(".") if value else "0"
