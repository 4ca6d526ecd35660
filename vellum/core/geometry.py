"""Matrices, points and boxes."""

from __future__ import annotations

from collections.abc import Iterable

Matrix = tuple[float, float, float, float, float, float]
Rect = tuple[float, float, float, float]
Point = tuple[float, float]
IDENTITY: Matrix = (1.0, *(0.0,) * 2, 1.0, *(0.0,) * 2)


def multiply(first: Matrix, then: Matrix) -> Matrix:
    """The matrix that applies `first`, then `then`."""
    a, b, c, d, e, f = first
    p, q, r, s, t, u = then
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def moved(m: Matrix, x: float, y: float) -> Matrix:
    """m after a translation by (x, y) in its own space."""
    right, up = apply(m, (x, y))
    return (*m[:4], right, up)


def apply(m: Matrix, p: Point) -> Point:
    dx, dy = apply_vector(m, p)
    return (m[4] + dx, m[5] + dy)


def apply_vector(m: Matrix, p: Point) -> Point:
    return (p[0] * m[0] + p[1] * m[2], p[0] * m[1] + p[1] * m[3])


def normal_rect(r: Rect) -> Rect:
    return (min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3]))


def bound(points: Iterable[Point]) -> Rect:
    xs, ys = zip(*points, strict=True)
    return (min(xs), min(ys), max(xs), max(ys))


def union(boxes: Iterable[Rect | None]) -> Rect | None:
    own = [b for b in boxes if b is not None]
    if not own:
        return None
    return (min(b[0] for b in own), min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own))


def transform_rect(m: Matrix, r: Rect) -> Rect:
    a, b, c, d, right, up = m
    x0, y0, x1, y1 = r
    ax, az, cx, cz, bx, bz, dx, dz = x0 * a, x1 * a, y0 * c, y1 * c, x0 * b, x1 * b, y0 * d, y1 * d
    xs = (right + (ax + cx), right + (ax + cz), right + (az + cx), right + (az + cz))
    ys = (up + (bx + dx), up + (bx + dz), up + (bz + dx), up + (bz + dz))
    return (min(xs), min(ys), max(xs), max(ys))


def initial_matrix(media: Rect, rotate: int, space: str) -> Matrix:
    """From user space to a device space: "screen" (origin top left), "page" (bottom left of the box), or as it is."""
    x0, y0, x1, y1 = media
    width, height = x1 - x0, y1 - y0
    m = {90: (0.0, -1.0, 1.0, 0.0, 0.0, width), 180: (-1.0, 0.0, 0.0, -1.0, width, height), 270: (0.0, 1.0, -1.0, 0.0, height, 0.0)}.get(rotate, IDENTITY)
    x0, y0, x1, y1 = transform_rect(m, media)
    if space == "screen":
        return multiply(m, (1.0, 0.0, 0.0, -1.0, -x0, y1))
    if space == "page":
        return (*m[:4], m[4] - x0, m[5] - y0)
    return m
