"""Joint trajectories at a fixed rate: clamped cubic splines through timed knots, one group per trajectory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZERO_STEP = 0.005  # seconds that two knots of one time are taken to be apart


def second_derivatives(t: np.ndarray, y: np.ndarray, v0: float = 0.0, v1: float = 0.0) -> np.ndarray:
    """Of the spline through the knots with end velocities ``v0`` and ``v1``: one elimination along the tridiagonal system."""
    h = np.diff(t)
    h[h == 0] = ZERO_STEP
    slope = np.concatenate([[v0], np.diff(y) / h, [v1]])
    side = np.concatenate([[0.0], h, [0.0]])
    middle, right = 2 * (side[:-1] + side[1:]), 6 * np.diff(slope)
    for i in range(1, len(t)):
        part = h[i - 1] / middle[i - 1]
        middle[i] -= part * h[i - 1]
        right[i] -= part * right[i - 1]
    out = right / middle
    for i in range(len(t) - 2, -1, -1):
        out[i] = (right[i] - h[i] * out[i + 1]) / middle[i]
    return out


def evaluate(t: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, velocity and acceleration. A knot belongs to the segment that it starts; the last one also extrapolates."""
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    h = np.where(h == 0, ZERO_STEP, h)
    slope, turn, s = (y[k + 1] - y[k]) / h, (m[k + 1] - m[k]) / h, at - t[k]
    start = slope - h * (2 * m[k] + m[k + 1]) / 6
    return y[k] + s * (start + s * (m[k] / 2 + s * turn / 6)), start + s * (m[k] + s * turn / 2), m[k] + s * turn


def resampled(knots: DataFrame, keys: list[str], period: float = 0.01) -> DataFrame:
    """``(keys, step, t, position, velocity, acceleration)`` from ``(keys, t, y)``, ``step`` counting samples.

    Samples lie at ``0, period, ...`` up to the first that reaches the last knot. Groups of one to three knots are
    copied through, without velocity and acceleration. Knots with a null or non-finite value are left out; a
    trajectory is one group, as its spline couples all of its knots.
    """
    fine = knots.where("t is not null and y is not null and not isnan(t) and not isnan(y) and abs(t) < double('inf') and abs(y) < double('inf')")
    rows = fine.select(*keys, F.col("t").cast("double"), F.col("y").cast("double"))

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "y"], kind="stable")
        t, y = frame["t"].to_numpy(), frame["y"].to_numpy()
        if len(t) <= 3:
            at, values = t, (y, None, None)
        else:
            at = np.arange(max(0, int(np.ceil(t[-1] / period - 1e-9))) + 1) * period
            values = evaluate(t, y, second_derivatives(t, y), at)
        out = {k: [v] * len(at) for k, v in zip(keys, group, strict=True)}
        out |= {"step": np.arange(len(at)), "t": at} | dict(zip(("position", "velocity", "acceleration"), values, strict=True))
        return pd.DataFrame(out)

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, step long, t double, position double, velocity double, acceleration double")


def held(samples: DataFrame, keys: list[str], more: int) -> DataFrame:
    """``samples`` followed by ``more`` repeats of each trajectory's last row, under the next steps."""
    last = samples.groupBy(*keys).agg(F.max_by(F.struct(*samples.columns), "step").alias("_last"))
    tail = last.select("_last.*", F.explode(F.sequence(F.lit(1), F.lit(more))).alias("_n"))
    return samples.unionByName(tail.withColumn("step", F.col("step") + F.col("_n")).drop("_n")) if more > 0 else samples
