"""Darkness of marked choices on grayscale crops, in numpy on Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pixel counts by its darkness beyond the printed template to this power.
POWER = 3.0
FILLED = 0.15
# Labels of choices, and how the weight of a pixel grows from the middle of a region to its edge.
LABELS = "abcdefgh"
MIDDLE, EDGE, REACH, FALLOFF = 0.0, 1.0, 0.3, 2.0


def image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8)[: width * height].reshape(height, width)


def extra_darkness(crop: np.ndarray, template: np.ndarray | None, power: float = POWER, suppress: float = 1.0) -> float:
    """Mean of (darkness of the crop minus the template's) to the power, in 0..1."""
    dark = (255.0 - crop) / 255.0
    if template is not None and template.shape == crop.shape:
        dark = np.maximum(0.0, dark - suppress * (255.0 - template) / 255.0)
    return float((dark**power).mean()) if dark.size else 0.0


def radial_weights(height: int, width: int, power: float = 2.0) -> np.ndarray:
    """1 in the middle, falling to 0 at the corners."""
    y, x = np.linspace(-1, 1, height)[:, None], np.linspace(-1, 1, width)[None]
    return np.maximum(0.0, 1 - np.sqrt((x**2 + y**2) / 2)) ** power


@F.pandas_udf(T.DoubleType())
def mark_score(crop: pd.Series, template: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else extra_darkness(image(c, w, h), None if t is None else image(t, w, h)) for c, t, w, h in zip(crop, template, width, height, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mean_darkness(crop: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else 0.0 if not len(c) else 1 - np.frombuffer(c, dtype=np.uint8).mean() / 255 for c in crop], dtype=float)


@F.pandas_udf(T.DoubleType())
def radial_darkness(crop: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else float((radial_weights(h, w) * (255.0 - image(c, w, h)) / 255).mean()) for c, w, h in zip(crop, width, height, strict=True)], dtype=float)


def stretch(crop: np.ndarray, power: float = 1.0) -> np.ndarray:
    """Contrast stretched to the full range, then to a power."""
    low, high = float(crop.min()), float(crop.max())
    return crop if high <= low else np.rint(255 * ((crop - low) / (high - low)) ** power).astype(np.uint8)


def adaptive_threshold(crop: np.ndarray, radius: int = 7, offset: float = 10.0) -> np.ndarray:
    """White where a pixel is lighter than its neighbourhood's mean less the offset."""
    p = np.pad(crop.astype(float), radius, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * radius + 1
    mean = (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2
    return np.where(crop > mean - offset, 255, 0).astype(np.uint8)


def darkness(crop: np.ndarray) -> np.ndarray:
    """0 for white to 1 for black."""
    return 1.0 - crop.astype(np.float64) / 255.0


def convolved(field: np.ndarray, kernel: np.ndarray, border: str) -> np.ndarray:
    """The same odd kernel along both axes; beyond its borders the field is mirrored without them ("reflect") or goes on ("edge")."""
    r = len(kernel) // 2
    for axis in (0, 1):
        n = field.shape[axis]
        p = np.pad(field, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode=border if n > 1 else "edge")
        cut = [slice(None), slice(None)]
        out = np.zeros_like(field)
        for k, weight in enumerate(kernel):
            cut[axis] = slice(k, k + n)
            out += weight * p[tuple(cut)]
        field = out
    return field


def gaussian(width: int, sigma: float) -> np.ndarray:
    kernel = np.exp(-((np.arange(width) - width // 2) ** 2) / (2 * sigma**2))
    return kernel / kernel.sum()


def blurred(field: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, six sigmas wide, with the field mirrored at its borders (which are not repeated)."""
    return convolved(field, gaussian(round(sigma * 6) | 1, sigma), "reflect") if sigma > 0 and field.size else field


def resized(crop: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with the middles of pixels as places and whole levels as values."""
    h, w = crop.shape
    if (h, w) == (height, width):
        return crop
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    c = crop.astype(np.float64)
    top, low = (c[r][:, x0] * (1 - fx) + c[r][:, x1] * fx for r in (y0, y1))
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def edge_weights(height: int, width: int) -> np.ndarray:
    """0 in the middle of a region, 1 from REACH of the way to its corners on."""
    y, x = (np.arange(n) - (n - 1) / 2 for n in (height, width))
    far = np.hypot(*((n - 1) / 2 for n in (height, width))) or 1.0
    near = np.clip(np.hypot(y[:, None], x[None]) / far / REACH, 0, 1)
    return MIDDLE + (EDGE - MIDDLE) * near**FALLOFF


@lru_cache(maxsize=8)
def _printed(pixels: bytes, width: int, height: int, to_width: int, to_height: int, sigma: float, suppress: float) -> tuple[np.ndarray, np.ndarray]:
    """Darkness of a template at a page's size, and the weight that printed pixels leave to what is drawn on them."""
    dark = blurred(darkness(resized(image(pixels, width, height), to_height, to_width)), sigma)
    return dark, np.exp(-suppress * dark)


def whole(data: bytes | None, width, height) -> bool:
    """Whether the bytes hold an image of this size."""
    return data is not None and not pd.isna(width) and not pd.isna(height) and min(width, height) > 0 and len(data) >= int(width) * int(height)


def added_marks(page: np.ndarray, template: tuple[bytes, int, int], boxes: list, eps: float, suppress: float, power: float, sigma: float) -> list[float]:
    """For each box (x1, y1, x2, y2) the darkness that was added to the printed template, summed over its pixels; 0 for an empty box.

    Sums are taken over the pixels themselves: differences of running sums would turn exact zeros into tiny scores.
    """
    h, w = page.shape
    printed, weight = _printed(*template, w, h, sigma, suppress)
    added = weight * np.clip(blurred(darkness(page), sigma) - printed - eps, 0, 1) ** power
    return [float(added[y1:y2, x1:x2].sum()) if x2 > x1 and y2 > y1 else 0.0 for x1, y1, x2, y2 in boxes]


def flat_and_graduated(page: np.ndarray, boxes: list) -> list[tuple[float, float]]:
    """For each box (x, y, w, h) inside the page its mean darkness, by a table of running sums, and the mean weighed towards its edge."""
    sums = np.zeros((page.shape[0] + 1, page.shape[1] + 1), dtype=np.int64)
    np.cumsum(np.cumsum(255 - page.astype(np.int64), axis=0), axis=1, out=sums[1:, 1:])
    out = []
    for x, y, w, h in boxes:
        total = sums[y + h, x + w] - sums[y, x + w] - sums[y + h, x] + sums[y, x]
        graded = (edge_weights(h, w) * darkness(page[y : y + h, x : x + w])).mean()
        out.append((int(total) / (255 * w * h), float(graded)))
    return out
