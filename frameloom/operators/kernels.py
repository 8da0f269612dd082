"""The temporal techniques on stacks of whole tiles, in numpy.

The same semantics as the relational forms in ``temporal`` without motion: a
tile's frames are one array, and a window's samples are its slices.
"""

from __future__ import annotations

import numpy as np

from frameloom.functions.formulas import BLACK_LEVEL, READ_SHARE, SHOT_GAIN


def _pixel(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0, 65535) + 0.5).astype(np.uint16)


def _sigma(v: np.ndarray, sigma: float) -> np.ndarray:
    return np.sqrt(READ_SHARE * sigma * sigma + SHOT_GAIN * np.maximum(0, v - BLACK_LEVEL))


def _forward(v: np.ndarray, sigma: float) -> np.ndarray:
    return 2 * np.sqrt(np.maximum(0, np.maximum(0, v - BLACK_LEVEL) / SHOT_GAIN + 0.375 + READ_SHARE * sigma * sigma / SHOT_GAIN**2))


def _inverse(z: np.ndarray, sigma: float) -> np.ndarray:
    z = np.maximum(z, 0.5)
    plain = SHOT_GAIN * (z * z / 4 - 0.375 - READ_SHARE * sigma * sigma / SHOT_GAIN**2) + BLACK_LEVEL
    return plain + np.where(z > 1, SHOT_GAIN / (4 * z * z), 0)


def bilateral(stack: np.ndarray, centre: int, sigma: float, h: float = 1.0) -> np.ndarray:
    z = _forward(stack.astype(np.float64), sigma)
    zc = z[centre]
    d = z - zc
    use = np.abs(d) <= 3
    use[centre] = False
    w = np.where(use, np.exp(-d * d / (2 * h * h)), 0)
    sw, swz = w.sum(axis=0), (w * z).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where((sw > 0) & (1 / (1 + sw) < 0.3), 0.7 / (0.3 * sw), 1.0)
    out = _pixel(_inverse((zc + swz * scale) / (1 + sw * scale), sigma))
    return np.where(use.any(axis=0), out, stack[centre])


def wiener(stack: np.ndarray, centre: int, sigma: float) -> np.ndarray:
    z = _forward(stack.astype(np.float64), sigma)
    zc = z[centre]
    use = np.abs(z - zc) <= 3
    n = use.sum(axis=0)
    m = np.where(use, z, 0).sum(axis=0) / n
    var = np.where(use, z * z, 0).sum(axis=0) / n - m * m
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(var > 0.01, np.maximum(var - 1, 0) / var, 0)
    return np.where(n > 1, _pixel(_inverse(m + gain * (zc - m), sigma)), stack[centre])


def inverse_variance(stack: np.ndarray, centre: int, sigma: float) -> np.ndarray:
    s = stack.astype(np.float64)
    c = s[centre]
    w = np.where(np.abs(s - c) <= 3 * _sigma(c, sigma), 1 / (_sigma(s, sigma) ** 2 + 1), 0)
    return _pixel(np.round((w * s).sum(axis=0) / w.sum(axis=0), 6))


def sigma_clip(stack: np.ndarray, centre: int, sigma: float) -> np.ndarray:
    s = stack.astype(np.float64)
    limit, use = 2.5 * _sigma(s[centre], sigma), np.ones(s.shape, bool)
    for _ in range(2):
        n = use.sum(axis=0)
        m = np.where(use, s, 0).sum(axis=0) / np.maximum(n, 1)
        use &= np.abs(s - m) <= limit
    n = use.sum(axis=0)
    return _pixel(np.where(n > 0, np.round(np.where(use, s, 0).sum(axis=0) / np.maximum(n, 1), 6), s[centre]))


def dct_shrink(stack: np.ndarray, centre: int, sigma: float) -> np.ndarray:
    s = stack.astype(np.float64)
    n = len(s)
    if n < 3:
        return stack[centre]
    sig = _sigma(s[centre], sigma)
    s = np.where(np.abs(s - s[centre]) > 3 * sig, s[centre], s)
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    d = np.tensordot(basis, s, 1)
    d[1:][np.abs(d[1:]) < 3 * sig / np.sqrt(n)] = 0
    return _pixel(np.tensordot(basis[:, centre], d, 1))


KERNELS = {
    "vst_bilateral": bilateral,
    "vst_bilateral_tight": lambda a, c, s: bilateral(a, c, s, 0.8),
    "vst_bilateral_wide": lambda a, c, s: bilateral(a, c, s, 1.2),
    "vst_wiener": wiener,
    "inv_variance": inverse_variance,
    "sigma_clip": sigma_clip,
    "dct_shrink": dct_shrink,
}


def apply(name: str, stack: np.ndarray, centre: int, sigma: float, y0: int, x0: int, height: int, width: int) -> np.ndarray:
    """One frame's tile at (y0, x0) of a frame of ``height`` x ``width``; sites
    whose footprint leaves the frame see their own frame alone."""
    out = KERNELS[name](stack, centre, sigma)
    own = KERNELS[name](stack[centre : centre + 1], 0, sigma)
    rows, cols = stack.shape[1:]
    inside = (np.arange(y0, y0 + rows) + 2 < height)[:, None] & (np.arange(x0, x0 + cols) + 2 < width)[None, :]
    return np.where(inside, out, own).astype("<u2")


def window_of(f: int, n: int, w: int, most: int = 16) -> tuple[int, int]:
    """First frame and length of the window of frame ``f`` of ``n``."""
    w = min(w, n, most)
    return min(max(f - w // 2, 0), n - w), w
