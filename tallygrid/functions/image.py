"""Page images as arrays of grey values, before recognition: smaller, sharper, straightened, black and white. Plain numpy, a page at a time."""

from __future__ import annotations

import numpy as np

#: Longest side of a page; the share of the mean grey that is still white; angles (degrees) that are tried to straighten a page.
LONGEST, SHARE, ANGLES = 4000, 0.85, tuple(np.linspace(-5, 5, 21))


def shrunk(page: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """A page of at most ``longest`` on either side, by whole steps."""
    step = -(-max(page.shape) // longest) if page.size else 1
    return page[::step, ::step]


def contrasted(page: np.ndarray) -> np.ndarray:
    """Greys spread over 0 to 255; a page of one grey stays."""
    low, high = float(page.min()), float(page.max())
    return page if high == low else (page - low) * (255 / (high - low))


def _neighbours(page: np.ndarray) -> np.ndarray:
    p = np.pad(page, 1, mode="edge")
    h, w = page.shape
    return np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def sharpened(page: np.ndarray) -> np.ndarray:
    return np.clip(2 * page - _neighbours(page).mean(axis=0), 0, 255)


def smoothed(page: np.ndarray) -> np.ndarray:
    """The median of each place and its neighbours."""
    return np.median(_neighbours(page), axis=0)


def black_and_white(page: np.ndarray, share: float = SHARE) -> np.ndarray:
    return np.where(page > page.mean() * share, 255.0, 0.0)


def rotated(page: np.ndarray, angle: float) -> np.ndarray:
    """A page turned about its middle, nearest places, white where there was nothing."""
    h, w = page.shape
    a, (y, x) = np.deg2rad(angle), np.indices((h, w))
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy = np.rint(dy * np.cos(a) - dx * np.sin(a) + (h - 1) / 2).astype(int)
    sx = np.rint(dy * np.sin(a) + dx * np.cos(a) + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, page[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255.0)


def row_variance(page: np.ndarray) -> float:
    """How much the ink of rows differs: greatest where lines of text are level."""
    return float((255.0 - page).sum(axis=1).var())


def skew(page: np.ndarray, angles=ANGLES) -> float:
    """The angle by which a page must be turned to be level; the smallest of equals."""
    return float(min(angles, key=lambda a: (-round(row_variance(rotated(page, a)), 6), abs(a))))


def prepared(page: np.ndarray) -> np.ndarray:
    """All steps in turn."""
    if not page.size:
        return page
    plain = black_and_white(smoothed(sharpened(contrasted(shrunk(page.astype(float))))))
    return rotated(plain, skew(plain))
