"""Segments and polygons of the plane, as column expressions over numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
EPS = 1e-9


def side(a: Point, b: Point, c: Point) -> Column:
    """Positive if c is left of the line from a to b, zero on it."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _touches(a: Point, b: Point, p: Point, turn: Column) -> Column:
    near = [p[k].between(F.least(a[k], b[k]) - EPS, F.greatest(a[k], b[k]) + EPS) for k in (0, 1)]
    return (F.abs(turn) < EPS) & near[0] & near[1]


def crosses(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether the segments share a point."""
    o = [side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)]
    proper = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    return proper | _touches(a, b, c, o[0]) | _touches(a, b, d, o[1]) | _touches(c, d, a, o[2]) | _touches(c, d, b, o[3])


def to_segment(p: Point, a: Point, b: Point) -> Column:
    """Distance of a point from a segment; one of no length is a point."""
    vx, vy, wx, wy = b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]
    size = vx * vx + vy * vy
    t = F.when(size <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wx * vx + wy * vy) / F.greatest(size, F.lit(1e-300)))))
    return F.hypot(wx - t * vx, wy - t * vy)


def segment_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Distance of two segments, zero if they share a point."""
    return F.when(crosses(a, b, c, d), 0.0).otherwise(F.least(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b)))


def side_distance(s: Column, u: Column) -> Column:
    """``segment_distance`` of two sides (as of ``segments``), in vectors: as one expression it is too long to be compiled."""

    def to(px, py, ax, ay, bx, by) -> np.ndarray:
        vx, vy, wx, wy = bx - ax, by - ay, px - ax, py - ay
        size = vx * vx + vy * vy
        t = np.where(size <= 1e-12, 0.0, np.clip((wx * vx + wy * vy) / np.maximum(size, 1e-300), 0.0, 1.0))
        return np.hypot(wx - t * vx, wy - t * vy)

    @F.pandas_udf("double")
    def run(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        a, b, c, d = ((x.to_numpy(), y.to_numpy()) for x, y in ((ax, ay), (bx, by), (cx, cy), (dx, dy)))
        turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        near = lambda p, q, r, k: (r[k] >= np.minimum(p[k], q[k]) - EPS) & (r[k] <= np.maximum(p[k], q[k]) + EPS)
        o = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
        meet = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
        for turned, (p, q, r) in zip(o, ((a, b, c), (a, b, d), (c, d, a), (c, d, b)), strict=True):
            meet |= (np.abs(turned) < EPS) & near(p, q, r, 0) & near(p, q, r, 1)
        far = np.minimum(np.minimum(to(*a, *c, *d), to(*b, *c, *d)), np.minimum(to(*c, *a, *b), to(*d, *a, *b)))
        return pd.Series(np.where(meet, 0.0, far))

    return run(*[v[k] for v in (s, u) for k in ("ax", "ay", "bx", "by")])


def segments_meet(s: Column, u: Column, limit: float) -> Column:
    """Whether the boxes of two sides (as of ``segments``) come within ``limit``: if not, neither do the sides."""

    def gap(axis: str) -> Column:
        low, high = (lambda v: F.least(v[f"a{axis}"], v[f"b{axis}"])), (lambda v: F.greatest(v[f"a{axis}"], v[f"b{axis}"]))
        return F.greatest(low(s) - high(u), low(u) - high(s))

    return (gap("x") <= limit + EPS) & (gap("y") <= limit + EPS)


def segments(polygon: Column) -> Column:
    """``array<struct<ax, ay, bx, by>>`` of a polygon's sides, the closing one added where it is open; none below two points."""
    n = F.size(polygon)
    open_ = F.element_at(polygon, 1) != F.element_at(polygon, -1)
    ring = F.when(open_, F.concat(polygon, F.slice(polygon, 1, 1))).otherwise(polygon)
    sides = F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p, i: F.struct(p[0].alias("ax"), p[1].alias("ay"), ring[i + 1][0].alias("bx"), ring[i + 1][1].alias("by")))
    return F.when(n >= 2, sides).otherwise(F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>"))


def finite_list(values: Column, size: int) -> Column:
    """An array of ``size`` finite doubles, or null."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    good = (F.size(values) == size) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, numbers)
