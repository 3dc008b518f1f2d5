"""Affine maps (a, b, c, d, e, f) in single precision."""

from __future__ import annotations

import numpy as np

_F = np.float32
Matrix = tuple[np.float32, ...]
IDENTITY: Matrix = tuple(_F(v) for v in (1, 0, 0, 1, 0, 0))


def product(first: Matrix, then: Matrix) -> Matrix:
    a, b, c, d, e, f = first
    return (
        then[0] * a + then[2] * b, then[1] * a + then[3] * b,
        then[0] * c + then[2] * d, then[1] * c + then[3] * d,
        then[0] * e + then[2] * f + then[4], then[1] * e + then[3] * f + then[5],
    )


def point(m: Matrix, x: np.float32, y: np.float32) -> tuple[np.float32, np.float32]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def moved(m: Matrix, x: np.float32, y: np.float32) -> Matrix:
    """``m`` after a step of (x, y) in its own space."""
    return (*m[:4], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])


def page_matrix(rotate: int, box: tuple[np.float32, ...]) -> Matrix:
    """From a page's space to its upright view; only quarter turns below a full one."""
    zero, one = _F(0), _F(1)
    turned = {
        90: (zero, -one, one, zero, -box[1], box[2]),
        180: (-one, zero, zero, -one, box[2], box[3]),
        270: (zero, one, -one, zero, box[3], -box[0]),
    }
    return turned.get(rotate, (one, zero, zero, one, -box[0], -box[1]))
