"""Image kernels over numpy planes of any size: what Column expressions hold for 8 x 8 planes, for decoded files.

``gray`` is height x width in 0..1, ``rgb`` height x width x 3. All run inside ``mapInPandas``.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import cache

import numpy as np


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.2126, 0.7152, 0.0722])


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = (a + 2) * x**3 - (a + 3) * x**2 + 1, a * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: How far from its centre a filter reaches, in cells of the coarser of the two sides.
SUPPORT = {triangle: 1.0, cubic: 2.0, lanczos: 3.0}


def filter_matrix(before: int, after: int, kernel=triangle) -> np.ndarray:
    """``(after, before)`` weights of a resampling in one direction: the filter around each new cell's centre, stretched on the way down; rows sum to 1."""
    step = before / after
    stretch = max(1.0, step)
    centre = (np.arange(after) + 0.5) * step
    reach = SUPPORT[kernel] * stretch
    first, last = np.maximum(0, np.floor(centre - reach + 0.5)), np.minimum(before, np.floor(centre + reach + 0.5))
    cell = np.arange(before)[None, :]
    weight = kernel((cell + 0.5 - centre[:, None]) / stretch) * ((cell >= first[:, None]) & (cell < last[:, None]))
    return weight / weight.sum(axis=1, keepdims=True)


def resample(plane: np.ndarray, height: int, width: int, kernel=triangle) -> np.ndarray:
    """A plane (or several, last axis) at another size: rows first, then columns. Planes of bytes are rounded after each, as pictures are."""
    bytes_ = plane.dtype == np.uint8
    kept = lambda x: np.clip(np.floor(x + 0.5), 0, 255) if bytes_ else x
    across, down = filter_matrix(plane.shape[1], width, kernel), filter_matrix(plane.shape[0], height, kernel)
    out = kept(np.moveaxis(np.tensordot(plane.astype(np.float64), across, axes=(1, 1)), -1, 1)) if width != plane.shape[1] else plane
    out = kept(np.tensordot(down, out.astype(np.float64), axes=(1, 0))) if height != plane.shape[0] else out
    return out.astype(np.uint8) if bytes_ else out


def scaled(rgb: np.ndarray, edge: int = 512) -> np.ndarray:
    """The picture with its long edge at ``edge``: triangle filter on the way down, cubic on the way up."""
    h, w = rgb.shape[:2]
    factor = edge / max(h, w)
    if factor == 1:
        return rgb
    return resample(rgb, max(1, round(h * factor)), max(1, round(w * factor)), triangle if factor < 1 else cubic)


def within(rgb: np.ndarray, edge: int) -> np.ndarray:
    """The picture with no edge over ``edge``, shrunk by a Lanczos filter; never enlarged."""
    h, w = rgb.shape[:2]
    if max(h, w) <= edge:
        return rgb
    factor = edge / max(h, w)
    return resample(rgb, max(1, round(h * factor)), max(1, round(w * factor)), lanczos)


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of 8-bit red, green and blue; each line is stored as differences from the one above."""
    h, w = rgb.shape[:2]
    lines = np.ascontiguousarray(rgb, np.uint8).reshape(h, 3 * w)
    up = np.diff(lines, axis=0, prepend=np.zeros((1, 3 * w), np.uint8))
    body = np.concatenate([np.full((h, 1), 2, np.uint8), up], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means; the nearest cell in both directions if either grows; the plane itself at its own size."""
    h, w = plane.shape[:2]
    if (h, w) == (height, width):
        return plane
    if height > h or width > w:
        return plane[(np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None, :]]
    rows, cols = np.linspace(0, h, height + 1).astype(int), np.linspace(0, w, width + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(plane, rows[:-1], axis=0), cols[:-1], axis=1)
    cells = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    return sums / cells.reshape(cells.shape + (1,) * (plane.ndim - 2))


@cache
def cosine_matrix(n: int = 32) -> np.ndarray:
    k, x = np.mgrid[0:n, 0:n]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * math.sqrt(2 / n)
    m[0] = math.sqrt(1 / n)
    return m


def to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(bool)).tobytes().hex()


def ahash(gray: np.ndarray) -> str:
    small = area_resize(gray, 8, 8)
    return to_hex(small > small.mean())


def dhash(gray: np.ndarray) -> str:
    small = area_resize(gray, 8, 9)
    return to_hex(small[:, 1:] > small[:, :-1])


def phash(gray: np.ndarray) -> str:
    m = cosine_matrix()
    low = (m @ area_resize(gray, 32, 32) @ m.T)[:8, :8].ravel()
    middle = np.median(np.concatenate([[0.0], low[1:]]))
    return to_hex(low > middle)


def rotations(gray: np.ndarray) -> list[str]:
    return [phash(np.rot90(gray, q)) for q in range(4)]


def color_signature(rgb: np.ndarray) -> list[int]:
    return np.clip(area_resize(rgb, 4, 4) * 255, 0, 255).astype(int).ravel().tolist()


def laplacian(gray: np.ndarray) -> np.ndarray:
    if min(gray.shape) < 3:
        return np.zeros(0)
    return gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]


def _variance(values: np.ndarray) -> float:
    return float(values.var()) if values.size else 0.0


def _quads(gray: np.ndarray) -> tuple[np.ndarray, ...]:
    even = gray[: gray.shape[0] // 2 * 2, : gray.shape[1] // 2 * 2]
    return even[::2, ::2], even[::2, 1::2], even[1::2, ::2], even[1::2, 1::2]


def noise_sigma(gray: np.ndarray) -> float:
    a, b, c, d = _quads(gray)
    return float(np.median(np.abs(a - b - c + d) / 2) / 0.6745) if a.size else 0.0


def grain_ratio(gray: np.ndarray) -> float:
    fine = noise_sigma(gray)
    small = sum(_quads(gray)) / 4 if min(gray.shape) >= 2 else gray
    structure = math.sqrt(_variance(laplacian(small)))
    return fine / structure if fine > 0 and structure > 1e-5 else 0.0


def colorfulness(rgb: np.ndarray) -> float:
    r, g, b = (rgb[..., i] * 255.0 for i in range(3))
    rg, yb = r - g, 0.5 * (r + g) - b
    return math.hypot(rg.std(), yb.std()) + 0.3 * math.hypot(rg.mean(), yb.mean())


def entropy(gray: np.ndarray, bins: int = 64) -> float:
    inside = gray[(gray >= 0) & (gray <= 1)]
    if not inside.size:
        return 0.0
    p = np.bincount(np.minimum((inside * bins).astype(int), bins - 1)) / inside.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def measure(gray: np.ndarray, rgb: np.ndarray, megapixels: float) -> dict[str, float]:
    """The raw measures, as ``functions.quality.raw_metrics``."""
    energy, spread = _variance(laplacian(gray)), float(gray.std())
    return {
        "edge_strength": math.sqrt(energy) / max(spread, 0.06) if energy > 0 else 0.0,
        "laplacian_variance": energy,
        "mean_luma": float(gray.mean()),
        "shadow_clip": float((gray < 0.02).mean()),
        "highlight_clip": float((gray > 0.98).mean()),
        "contrast_std": spread,
        "colorfulness": colorfulness(rgb),
        "noise_sigma": noise_sigma(gray),
        "grain_ratio": grain_ratio(gray),
        "megapixels": megapixels,
        "entropy": entropy(gray),
    }


def fingerprint(gray: np.ndarray, rgb: np.ndarray) -> dict:
    turned = rotations(gray)
    return {"phash": turned[0], "dhash": dhash(gray), "ahash": ahash(gray), "color_sig": color_signature(rgb), "rotations": turned}


