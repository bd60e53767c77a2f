"""Clean-up of grayscale pages in numpy: contrast, local equalisation, binarisation, skew."""

from __future__ import annotations

import math

import numpy as np

from packetlane.functions.marks import convolved, gaussian

LEVELS = 256


def percentile(page: np.ndarray, percent: float) -> float:
    """The level at a place among a page's sorted pixels; between two pixels their levels are weighed, and the weighed sum is rounded once.

    That is how DuckDB's quantile_cont rounds. np.percentile differs in the last bit, which moves a pixel whose stretched level is a whole number.
    """
    place = (page.size - 1) * (percent / 100)
    part = place - math.floor(place)
    low, high = np.searchsorted(np.bincount(page.ravel(), minlength=LEVELS).cumsum(), [math.floor(place), math.ceil(place)], side="right").tolist()
    return math.fma(low, 1 - part, high * part)


def contrast(page: np.ndarray, low: float = 1.0, high: float = 99.0, power: float = 1.0) -> np.ndarray:
    """Levels between two percentiles stretched to the full range, then to a power; fractions are cut off."""
    lo, hi = percentile(page, low), percentile(page, high)
    out = page.astype(np.float64) if hi <= lo else np.clip((page - lo) / (hi - lo) * 255, 0, 255)
    return (np.clip((out / 255) ** power * 255, 0, 255) if power != 1.0 else out).astype(np.uint8)


def _tile_levels(tile: np.ndarray, limit: int) -> np.ndarray:
    """New levels of a tile: its cumulated histogram, whose columns are cut at the limit and what was cut is dealt to all."""
    counts = np.bincount(tile.ravel(), minlength=LEVELS)
    if limit > 0:
        over = int(np.maximum(counts - limit, 0).sum())
        counts = np.minimum(counts, limit) + over // LEVELS
        left = over % LEVELS
        if left:
            step = max(LEVELS // left, 1)
            counts[np.arange(LEVELS)[::step][:left]] += 1
    return np.clip(np.rint(counts.cumsum() * ((LEVELS - 1) / tile.size)), 0, LEVELS - 1)


def equalized(page: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: levels of the four nearest tiles, blended bilinearly.

    A page that tiles don't divide is mirrored beyond its right and lower border to make them whole.
    """
    h, w = page.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(page, [(0, th * tiles - h), (0, tw * tiles - w)], mode="reflect" if min(h, w) > tiles else "symmetric")
    limit = max(int(clip * th * tw / LEVELS), 1) if clip > 0 else 0
    levels = np.array([[_tile_levels(full[a * th : (a + 1) * th, b * tw : (b + 1) * tw], limit) for b in range(tiles)] for a in range(tiles)])

    def near(n: int, size: int):
        at = np.arange(n) / size - 0.5
        first = np.floor(at).astype(int)
        return np.clip(first, 0, tiles - 1), np.clip(first + 1, 0, tiles - 1), at - first

    y0, y1, fy = near(h, th)
    x0, x1, fx = near(w, tw)
    of = lambda a, b: levels[a[:, None], b[None], page]
    top, low = (of(y, x0) * (1 - fx) + of(y, x1) * fx for y in (y0, y1))
    return np.clip(np.rint(top * (1 - fy[:, None]) + low * fy[:, None]), 0, LEVELS - 1).astype(np.uint8)


def binarized(page: np.ndarray, block: int = 31, offset: float = 10) -> np.ndarray:
    """White where a pixel is lighter than the Gaussian mean of its block (made odd) less the offset."""
    block |= 1
    mean = np.rint(convolved(page.astype(np.float64), gaussian(block, 0.3 * ((block - 1) / 2 - 1) + 0.8), "edge"))
    return np.where(page > mean - offset, 255, 0).astype(np.uint8)


def otsu(page: np.ndarray) -> int:
    """The level that parts a page best in dark (at most this) and light."""
    n = np.bincount(page.ravel(), minlength=LEVELS).astype(np.float64)
    below, total = n.cumsum(), (n * np.arange(LEVELS)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nan_to_num(apart).argmax())


def skew(page: np.ndarray, most: float = 10.0, coarse: float = 0.5, fine: float = 0.05, least: int = 100) -> float:
    """Degrees by which lines of a page are turned counterclockwise: the turn back that makes its rows' darkness most uneven.

    0 for pages with fewer dark pixels than `least`, or only those.
    """
    y, x = np.nonzero(page <= otsu(page))
    if len(y) < least or len(y) == page.size:
        return 0.0
    x, y = x - page.shape[1] / 2, y - page.shape[0] / 2
    reach = int(np.hypot(*page.shape)) + 2

    def uneven(degrees: float) -> float:
        a = np.radians(degrees)
        place = x * np.sin(a) + y * np.cos(a) + reach
        whole = place.astype(int)
        part = place - whole  # each pixel is shared by two rows, so whole turns have no advantage by rounding
        rows = np.bincount(whole, 1 - part, 2 * reach) + np.bincount(whole + 1, part, 2 * reach)
        return float((np.diff(rows) ** 2).sum())

    steps = lambda middle, width, step: [middle + step * k for k in range(-round(width / step), round(width / step) + 1)]
    first = max(steps(0.0, most, coarse), key=lambda a: (uneven(a), -abs(a)))
    return round(max(steps(first, coarse, fine), key=lambda a: (uneven(a), -abs(a))), 6)


def turned(page: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counterclockwise around the middle, bilinear, with the border's pixels going on beyond it."""
    h, w = page.shape
    a = np.radians(degrees)
    y, x = np.arange(h)[:, None] - h / 2, np.arange(w)[None] - w / 2
    sx, sy = np.clip(x * np.cos(a) - y * np.sin(a) + w / 2, 0, w - 1), np.clip(x * np.sin(a) + y * np.cos(a) + h / 2, 0, h - 1)
    x0, y0 = sx.astype(int), sy.astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    p = page.astype(np.float64)
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)
