"""Poses of a cloud's wall band on a map: their cost in a distance field, and a search for the cheapest.

A pose ``(tx, ty, yaw)`` turns the band's points by ``yaw`` and shifts them. The list of poses is small (a population);
points and the field are tables. All poses of a list are scored by one job: each point is placed by every pose, meets
the four pixels around it by an equi-join on the pixel, and each pose's costs are reduced to exact quantiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.operators.quantiles import quantiles
from stoa.session import broadcast_if_small, written

Pose = tuple[float, float, float]
NO_FIT = 1e6


@dataclass(frozen=True)
class Guide:
    """Points that a pose places in a field, and how their costs count.

    ``points``: ``x, y``. ``patches``: see ``patches``. ``outside`` weighs the share of points out of the map, in units of the
    penalty. A pose that puts fewer than ``least`` points or ``least_share`` of them on the map costs ``unfit``.
    """

    points: DataFrame
    count: int
    patches: DataFrame
    height: int
    width: int
    resolution: float
    origin: tuple[float, float]
    penalty: float
    outside: float
    least: int
    least_share: float
    unfit: float


def patches(field: DataFrame) -> DataFrame:
    """``(r, c, d00, d01, d10, d11)`` of each pixel with its right, lower and diagonal neighbour, from ``field`` (``row, col, d``)."""
    corner = F.explode(F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)]))
    laid = field.select("d", corner.alias("e")).select("d", "e.*")
    met = laid.groupBy("r", "c").agg(*[F.max(F.when(F.col("k") == 2 * i + j, F.col("d"))).alias(f"d{i}{j}") for i in (0, 1) for j in (0, 1)])
    return met.where("d00 is not null and d01 is not null and d10 is not null and d11 is not null")


def wall_guide(points: DataFrame, field: DataFrame, height: int, width: int, resolution: float, origin: tuple[float, float], penalty: float, least_share: float = 0.15) -> Guide:
    """The guide of the wall band: under 500 points or 15 % of them on the map is no fit."""
    return _guide(points, field, height, width, resolution, origin, penalty, 0.6, 500, least_share, NO_FIT + penalty)


def object_guide(points: DataFrame, field: DataFrame, height: int, width: int, resolution: float, origin: tuple[float, float], penalty: float, least_share: float = 0.0) -> Guide:
    """The guide of known object places: one of them on the map is enough."""
    return _guide(points, field, height, width, resolution, origin, penalty, 0.8, 1, least_share, 1.5 * penalty)


def _guide(points, field, height, width, resolution, origin, penalty, outside, least, least_share, unfit) -> Guide:
    laid = broadcast_if_small(written(patches(field), "patches"), 200_000)
    at = written(points.select("x", "y"), "guide")
    return Guide(at, at.count(), laid, height, width, resolution, origin, penalty, outside, least, least_share, unfit)


def _costs(guide: Guide, poses: list[Pose], gathered: int) -> dict[int, float]:
    """Each pose's cost by one guide. Poses of up to ``gathered`` points have their quantiles by values, else by narrowing histograms."""
    n = guide.count
    required = max(guide.least, int(guide.least_share * n))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pose"), F.lit(float(tx)).alias("tx"), F.lit(float(ty)).alias("ty"), F.lit(float(np.cos(yaw))).alias("c"), F.lit(float(np.sin(yaw))).alias("s")) for k, (tx, ty, yaw) in enumerate(poses)]))
    p = guide.points.select("x", "y", each.alias("p")).select("p.pose", (F.col("x") * F.col("p.c") - F.col("y") * F.col("p.s") + F.col("p.tx")).alias("x"), (F.col("x") * F.col("p.s") + F.col("y") * F.col("p.c") + F.col("p.ty")).alias("y"))
    p = p.select("pose", ((guide.height - 1) - (F.col("y") - guide.origin[1]) / guide.resolution).alias("row"), ((F.col("x") - guide.origin[0]) / guide.resolution).alias("col"))
    on = p.where((F.col("row") >= 0) & (F.col("row") < guide.height - 1) & (F.col("col") >= 0) & (F.col("col") < guide.width - 1))
    at = on.select("pose", F.floor("row").alias("r"), F.floor("col").alias("c"), (F.col("row") - F.floor("row")).alias("fr"), (F.col("col") - F.floor("col")).alias("fc"))
    mix = lambda a, b, f: F.col(a) * (1 - F.col(f)) + F.col(b) * F.col(f)
    seen = at.join(guide.patches, ["r", "c"]).select("pose", (mix("d00", "d01", "fc") * (1 - F.col("fr")) + mix("d10", "d11", "fc") * F.col("fr")).alias("d"))
    if n <= gathered:
        rows = seen.groupBy("pose").agg(F.count(F.lit(1)).alias("n"), F.percentile("d", [0.5, 0.75]).alias("q")).collect()
    else:
        seen = written(seen, "sampled")
        q = quantiles(seen, ["pose"], "d", [0.5, 0.75]).groupBy("pose").agg(F.array(F.min_by("v", "share"), F.max_by("v", "share")).alias("q"))
        rows = seen.groupBy("pose").agg(F.count(F.lit(1)).alias("n")).join(q, "pose").collect()
    costs = {k: guide.unfit for k in range(len(poses))}
    for r in rows:
        if r["n"] >= required:
            costs[r["pose"]] = r["q"][0] + 0.35 * r["q"][1] + guide.outside * guide.penalty * (1 - r["n"] / n)
    return costs


def pose_costs(walls: Guide, poses: list[Pose], objects: Guide | None = None, object_weight: float = 0.0, gathered: int = 1_000_000) -> list[float]:
    """The cost of each pose: that of the wall band and, if it fits, ``object_weight`` times that of known objects.

    The driver gets one row a pose. A cost is the median of the field at the points, plus 0.35 times its upper quartile, plus the penalty
    for points out of the map. A pose that the walls don't fit costs a million and the penalty. Poses are a small list; no points cost as no fit.
    """
    own = _costs(walls, poses, gathered)
    if objects is not None and object_weight > 0 and objects.count:
        more = _costs(objects, poses, gathered)
        own = {k: v if v == walls.unfit else v + object_weight * more[k] for k, v in own.items()}
    return [own[k] for k in range(len(poses))]


def search(cost, bounds: list[tuple[float, float]], generations: int = 40, size: int = 15, seed: int = 0, halvings: int = 12) -> tuple[Pose, float]:
    """The cheapest pose found within ``bounds``: differential evolution, then a pattern search about its best.

    ``cost`` takes a list of poses and gives their costs, so a generation is one call: every member's trial (the best plus a
    scaled difference of two others, crossed with the member) is scored, then those that are no worse stay. The pattern search scores
    a step ahead and back along each axis together, moves to the best, and halves its step where none is better.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    dim = len(bounds)
    people = low + rng.random((max(5, size * dim), dim)) * (high - low)
    worth = np.array(cost([tuple(map(float, p)) for p in people]))
    for _ in range(generations):
        best, scale = people[worth.argmin()], rng.uniform(0.5, 1.0)
        pairs = np.array([rng.choice([j for j in range(len(people)) if j != i], 2, replace=False) for i in range(len(people))])
        trial = best + scale * (people[pairs[:, 0]] - people[pairs[:, 1]])
        crossed = rng.random(people.shape) < 0.7
        crossed[np.arange(len(people)), rng.integers(0, dim, len(people))] = True
        trial = np.where(crossed, trial, people)
        trial = np.where((trial < low) | (trial > high), low + rng.random(people.shape) * (high - low), trial)
        found = np.array(cost([tuple(map(float, p)) for p in trial]))
        keep = found <= worth
        people, worth = np.where(keep[:, None], trial, people), np.where(keep, found, worth)
    at, least, step = people[worth.argmin()], worth.min(), (high - low) / 50
    while halvings:
        around = [np.clip(at + sign * step * (np.arange(dim) == k), low, high) for k in range(dim) for sign in (1, -1)]
        found = np.array(cost([tuple(map(float, p)) for p in around]))
        if found.min() < least:
            at, least = around[int(found.argmin())], found.min()
        else:
            step, halvings = step / 2, halvings - 1
    return tuple(map(float, at)), float(least)


def placed(points: DataFrame, pose: Pose) -> DataFrame:
    """``points`` with ``x, y`` turned and shifted by the pose; other columns stay."""
    tx, ty, yaw = pose
    c, s = float(np.cos(yaw)), float(np.sin(yaw))
    turned: dict[str, Column] = {"x": F.col("x") * c - F.col("y") * s + tx, "y": F.col("x") * s + F.col("y") * c + ty}
    return points.select(*[turned.get(k, F.col(k)).alias(k) for k in points.columns])
