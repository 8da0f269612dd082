"""Per-pixel formulas as SQL text over column names or sub-expressions.

All maths is in double precision.  Pixels are rounded half up after clamping.
"""

from __future__ import annotations

# Black level, shot gain (variance per unit of signal above it),
# and the share of a frame's noise variance that is read noise.
BLACK_LEVEL, SHOT_GAIN, READ_SHARE = 6032.0, 180.0, 0.55


def clamp(x: str, low: float | str, high: float | str) -> str:
    return f"least({high}, greatest({low}, {x}))"


def to_pixel(x: str) -> str:
    """Nearest integer in 0..65535."""
    return f"CAST(floor({clamp(x, '0D', '65535D')} + 0.5D) AS INT)"


def signal(v: str, black: float = BLACK_LEVEL) -> str:
    return f"greatest(0D, {v} - {black}D)"


def read_variance(sigma: str) -> str:
    return f"({READ_SHARE}D * {sigma} * {sigma})"


def noise_sigma(v: str, sigma: str) -> str:
    """Standard deviation of a pixel of value ``v``."""
    return f"sqrt({read_variance(sigma)} + {SHOT_GAIN}D * {signal(v)})"


def stabilise(v: str, sigma: str, black: float = BLACK_LEVEL, gain: float = SHOT_GAIN) -> str:
    """Generalised Anscombe transform: noise of about unit variance."""
    return f"(2D * sqrt(greatest(0D, {signal(v, black)} / {gain}D + 0.375D + {read_variance(sigma)} / ({gain}D * {gain}D))))"


def unstabilise(z: str, sigma: str, black: float = BLACK_LEVEL, gain: float = SHOT_GAIN) -> str:
    """Its inverse, with the asymptotic bias correction above 1."""
    z = f"greatest({z}, 0.5D)"
    plain = f"{gain}D * ({z} * {z} / 4D - 0.375D - {read_variance(sigma)} / ({gain}D * {gain}D)) + {black}D"
    return f"({plain} + CASE WHEN {z} > 1D THEN {gain}D / (4D * {z} * {z}) ELSE 0D END)"


def component(y: str = "y", x: str = "x") -> str:
    """Place in the 2 x 2 mosaic: 0 red, 1 green (red row), 2 green, 3 blue."""
    return f"(({y} % 2) * 2 + {x} % 2)"


def luma(r: str, g: str, b: str) -> str:
    return f"CAST(floor({clamp(f'0.2126D * {r} + 0.7152D * {g} + 0.0722D * {b} + 0.5D', '0D', '65535D')}) AS INT)"


def compand(i: str) -> str:
    """Cubic expansion of 8-bit magnitudes."""
    return f"({i} + 768 * {i} * {i} * {i} DIV 16777216)"


def half_away(x: str, q: str) -> str:
    """Quotient rounded half away from zero."""
    return f"CAST(sign({x}) * floor((abs({x}) + {q} DIV 2) / {q}) AS INT)"


def dead_zone(x: str, q: str) -> str:
    """Quotient truncated towards zero."""
    return f"CAST(sign({x}) * floor(abs({x}) / CAST({q} AS DOUBLE)) AS INT)"


def soft_threshold(x: str, t: str) -> str:
    return f"(sign({x}) * greatest(abs({x}) - {t}, 0D))"


def unfold_sign(u: str) -> str:
    """0, 1, 2, 3, ... to 0, -1, 1, -2, ..."""
    return f"((shiftright({u}, 1)) ^ (-({u} & 1)))"


def fold_sign(n: str) -> str:
    return f"(CASE WHEN {n} < 0 THEN -2 * {n} - 1 ELSE 2 * {n} END)"
