"""Gaussian kernels and line filtering on numpy arrays."""

from __future__ import annotations

import numpy as np


def gaussian_1d(sigma: float, normalize: bool = True) -> np.ndarray:
    """Kernel reaching three sigma; a unit impulse for sigma 0."""
    if sigma <= 0:
        kernel = np.array([0.0, 1.0, 0.0])
    else:
        half = max(1, int(3 * sigma + 0.5))
        at = np.arange(-half, half + 1)
        kernel = np.exp(-(at * at) / (2.0 * sigma * sigma))
    return kernel / kernel.sum() if normalize else kernel


def gaussian_offset(sigma: float, dx: float, dy: float) -> np.ndarray:
    """2-D kernel with its centre moved by a sub-pixel offset, rows are y."""
    half = max(1, int(np.floor(3 * sigma + 0.5)))
    at = np.arange(-half, half + 1)
    return np.exp(-((at[None, :] - dx) ** 2 + (at[:, None] - dy) ** 2) / (2.0 * sigma * sigma))


def mirror(index: np.ndarray, n: int) -> np.ndarray:
    """Reflected index, edge samples repeated."""
    m = np.mod(index, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def mirror_inner(index: np.ndarray, n: int) -> np.ndarray:
    """Reflected index about the edge samples."""
    period = max(2 * (n - 1), 1)
    m = np.mod(index, period)
    return np.where(m <= n - 1, m, period - m)


def filter_lines(lines: np.ndarray, kernel: np.ndarray, edge: str) -> np.ndarray:
    """Correlate every row of ``lines`` with ``kernel``.

    ``edge``: ``mirror`` repeats edge samples, ``inner`` reflects about them, ``renorm``
    drops outside weights and divides by the rest, ``zero`` only drops them.
    """
    n, half = lines.shape[1], len(kernel) // 2
    out = np.zeros(lines.shape)
    used = np.zeros(n)
    for i, w in enumerate(kernel):
        at = np.arange(n) + i - half
        if edge in ("mirror", "inner"):
            out += w * lines[:, mirror(at, n) if edge == "mirror" else mirror_inner(at, n)]
        else:
            ok = (at >= 0) & (at < n)
            out[:, ok] += w * lines[:, at[ok]]
            used[ok] += w
    return out / used if edge == "renorm" else out


def blur(image: np.ndarray, sigma: float, edge: str = "mirror") -> np.ndarray:
    """Separable Gaussian of a 2-D image, rows first."""
    kernel = gaussian_1d(sigma)
    return filter_lines(filter_lines(image, kernel, edge).T, kernel, edge).T


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and direction from half central differences, edges clamped."""
    h, w = image.shape
    x, y = np.arange(w), np.arange(h)
    dx = (image[:, np.minimum(x + 1, w - 1)] - image[:, np.maximum(x - 1, 0)]) / 2
    dy = (image[np.minimum(y + 1, h - 1), :] - image[np.maximum(y - 1, 0), :]) / 2
    return np.hypot(dx, dy), np.arctan2(dy, dx)
