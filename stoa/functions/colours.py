"""Colours of points and palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_colours(points: DataFrame, channels: list[str], middle: float = 127.5) -> DataFrame:
    """Channels from 0 to 255: those of a cloud that reaches no more than 1 are scaled up, missing ones are ``middle``."""
    top = points.agg(F.greatest(*[F.max(c) for c in channels], F.lit(float("-inf"))).alias("_top"))  # one row
    scale = F.when(F.col("_top") <= 1.0, 255.0).otherwise(1.0)
    clipped = {c: F.when(F.col(c).isNull(), middle).otherwise(F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(255.0))) for c in channels}
    return points.crossJoin(F.broadcast(top)).withColumns(clipped).drop("_top")


def hsv(h: Column, s: float, v: float) -> list[Column]:
    """Red, green and blue from 0 to 1 of a hue from 0 to 1."""
    six = F.floor(h * 6.0)
    f = h * 6.0 - six
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f))
    k = six % 6
    pick = lambda *c: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c]), (k + 1).cast("int"))
    return [pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)]


def palette(index: Column) -> list[Column]:
    """The colour of a label: hues by the golden ratio, as whole numbers from 0 to 255."""
    hue = F.pmod(index * 0.618033988749895, F.lit(1.0))
    return [F.floor(c * 255 + 1e-9).cast("int") for c in hsv(hue, 0.65, 0.95)]


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def blend(a: Column, b: Column | float, ratio: float) -> Column:
    """``ratio`` of a and the rest of b, kept within 0 and 255."""
    return F.least(F.greatest(ratio * a + (1 - ratio) * b, F.lit(0.0)), F.lit(255.0))
