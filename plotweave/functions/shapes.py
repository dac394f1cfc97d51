"""Measures of point sets that need a loop: convex hull and smallest enclosing circle."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.functions.geometry import RINGS


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners counter-clockwise, by Andrew's monotone chain."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def polygon_area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def enclosing_radius(points: list[tuple[float, float]]) -> float:
    """Radius of the smallest enclosing circle, by Welzl's incremental method on the hull."""
    pts = convex_hull(points)
    random.Random(0).shuffle(pts)

    def inside(c, p):
        return c is not None and math.hypot(p[0] - c[0], p[1] - c[1]) <= c[2] * (1 + 1e-12) + 1e-12

    def two(a, b):
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a, b, c):
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if d == 0:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda x: x[2])
        s = [p[0] ** 2 + p[1] ** 2 for p in (a, b, c)]
        x = (s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1])) / d
        y = (s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])) / d
        return x, y, math.hypot(a[0] - x, a[1] - y)

    circle = None
    for i, p in enumerate(pts):
        if inside(circle, p):
            continue
        circle = (*p, 0.0)
        for j, q in enumerate(pts[:i]):
            if inside(circle, q):
                continue
            circle = two(p, q)
            for r in pts[:j]:
                if not inside(circle, r):
                    circle = three(p, q, r)
    return circle[2] if circle else 0.0


def _corners(rings) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for ring in rings if ring is not None for p in ring] if rings is not None else []


@F.pandas_udf(T.DoubleType())
def hull_area(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: polygon_area(convex_hull(_corners(r)))).astype(float)


@F.pandas_udf(T.DoubleType())
def circle_area(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: math.pi * enclosing_radius(_corners(r)) ** 2).astype(float)


def clip_ring(ring: list[tuple[float, float]], theta: float, threshold: float, left: bool) -> list[tuple[float, float]]:
    """The part of a ring on one side of a sweep line (Sutherland and Hodgman, 1974)."""
    far = [(-math.sin(theta) * x + math.cos(theta) * y - threshold) * (1 if left else -1) for x, y in ring]
    out: list[tuple[float, float]] = []
    for (a, da), (b, db) in zip(zip(ring, far), zip(ring[1:] + ring[:1], far[1:] + far[:1])):
        if da < 0:
            out.append(a)
        if (da < 0) != (db < 0):
            t = da / (da - db)
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out if len(out) > 2 else []


def clip_half_plane(rings, theta, threshold, left: bool):
    """Polygons cut by a line: the side ``left`` or right of it, as a column of rings."""
    def one(r, t, c):
        parts = [clip_ring([(p["x"], p["y"]) for p in ring], t, c, left) for ring in r or []]
        return [[{"x": x, "y": y} for x, y in part] for part in parts if part]

    return F.udf(one, RINGS)(rings, theta, threshold)


def convex_hull_ratio(area, hull):
    """Area over the hull's; 0 where the hull has none."""
    return F.when(hull == 0, F.lit(0.0)).otherwise(area / hull)


def reock(area, circle):
    """Area over the smallest enclosing circle's; 0 where that has none."""
    return F.when(circle == 0, F.lit(0.0)).otherwise(area / circle)
