"""Facts about decoded images with numpy: perceptual hashes, sharpness, exposure, thumbnails, model input.

Rasters are arrays (height, width, 3) of bytes in RGB. Scaling uses tent and cubic filters whose support grows when
an image shrinks, in double precision; results may differ by a grey level from other libraries that round between
passes.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

SIDE = 256  # sharpness and exposure are measured on at most so many pixels a side; thumbnails have as many
MODEL_SIDE = 224

#: The model's means and deviations of the three channels.
MODEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
MODEL_STD = (0.26862954, 0.26130258, 0.27577711)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma by the weights of Rec. 709, rounded down."""
    return (rgb[..., 0] * 2126.0 + rgb[..., 1] * 7152.0 + rgb[..., 2] * 722.0) // 10000.0


def _tent(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _cubic(x: np.ndarray) -> np.ndarray:
    """The Catmull-Rom spline."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


@lru_cache(256)
def _weights(old: int, new: int, kind: str) -> np.ndarray:
    """A matrix that scales ``old`` samples to ``new``."""
    kernel, reach = (_tent, 1.0) if kind == "tent" else (_cubic, 2.0)
    ratio = old / new
    wide = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    at = np.arange(old) + 0.5
    w = kernel((at[None, :] - centre[:, None]) / wide) * (np.abs(at[None, :] - centre[:, None]) <= reach * wide)
    return w / w.sum(1, keepdims=True)


def scaled(image: np.ndarray, height: int, width: int, kind: str = "tent") -> np.ndarray:
    """The image in another size, as bytes in doubles."""
    rows, cols = _weights(image.shape[0], height, kind), _weights(image.shape[1], width, kind)
    out = np.tensordot(rows, image.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(cols, out, (1, 1)), 0, 1)
    return np.clip(np.floor(out + 0.5), 0, 255)


def within(height: int, width: int, side: int) -> tuple[int, int]:
    """The size that fits into a square of ``side`` with the same shape."""
    ratio = min(side / height, side / width)
    return max(1, round(height * ratio)), max(1, round(width * ratio))


def _packed(flags: np.ndarray) -> int:
    """64 flags as a signed number, the first the lowest bit."""
    return int.from_bytes(np.packbits(flags.ravel(), bitorder="little").tobytes(), "little", signed=True)


def dhash(rgb: np.ndarray) -> int:
    """A bit for each of 8 x 8 places where the image gets darker to the right."""
    g = grey(scaled(rgb, 8, 9))
    return _packed(g[:, :-1] > g[:, 1:])


@lru_cache(1)
def _cosines(n: int = 32) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(n)[:, None])


def phash(rgb: np.ndarray) -> int:
    """A bit for each of the 8 x 8 lowest frequencies, the constant one included, that is above their median."""
    c = _cosines()
    low = (c @ grey(scaled(rgb, 32, 32)) @ c.T)[:8, :8]
    order = np.sort(low.ravel())
    return _packed(low > (order[31] + order[32]) / 2)


def sharpness(rgb: np.ndarray) -> float:
    """The variance of the Laplacian; 0 for images of less than three pixels a side."""
    h, w = rgb.shape[:2]
    g = grey(scaled(rgb, *within(h, w, SIDE)) if max(h, w) > SIDE else rgb) / 255.0
    if min(g.shape) < 3:
        return 0.0
    lap = g[1:-1, 2:] + g[1:-1, :-2] + g[2:, 1:-1] + g[:-2, 1:-1] - 4 * g[1:-1, 1:-1]
    return max(0.0, float((lap * lap).mean() - lap.mean() ** 2))


def exposure(rgb: np.ndarray) -> float:
    """The share of pixels that are neither crushed nor blown."""
    h, w = rgb.shape[:2]
    if h == 0 or w == 0:
        return 0.0
    g = grey(scaled(rgb, *within(h, w, SIDE)) if max(h, w) > SIDE else rgb)
    return float(1 - ((g <= 2) | (g >= 253)).mean())


def thumbnail(rgb: np.ndarray) -> np.ndarray:
    """The image with at most SIDE pixels a side; never larger than it was."""
    h, w = rgb.shape[:2]
    return rgb if max(h, w) <= SIDE else scaled(rgb, *within(h, w, SIDE)).astype(np.uint8)


def model_input(rgb: np.ndarray) -> np.ndarray:
    """Channels x 224 x 224: the short side scaled by a cubic filter, the middle cut out, normalised."""
    h, w = rgb.shape[:2]
    ratio = MODEL_SIDE / min(h, w)
    big = scaled(rgb, max(MODEL_SIDE, round(h * ratio)), max(MODEL_SIDE, round(w * ratio)), "cubic")
    top, left = (big.shape[0] - MODEL_SIDE) // 2, (big.shape[1] - MODEL_SIDE) // 2
    cut = big[top : top + MODEL_SIDE, left : left + MODEL_SIDE] / 255.0
    return np.moveaxis((cut - np.array(MODEL_MEAN)) / np.array(MODEL_STD), 2, 0).astype(np.float32)


def png(rgb: np.ndarray) -> bytes:
    """The image as a PNG file."""
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb, np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
