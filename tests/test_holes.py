"""Hole filling against a flood from the edge."""

import numpy as np
import pytest

from stoa.operators.holes import fill_holes


def flooded(mask):
    open_ = np.zeros_like(mask)
    todo = [(r, c) for r in range(mask.shape[0]) for c in range(mask.shape[1]) if r in (0, mask.shape[0] - 1) or c in (0, mask.shape[1] - 1)]
    while todo:
        r, c = todo.pop()
        if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and not mask[r, c] and not open_[r, c]:
            open_[r, c] = True
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return ~open_


@pytest.mark.parametrize("seed", [0, 1])
def test_fill_holes(spark, seed):
    mask = np.random.default_rng(seed).random((9, 12)) < 0.55
    mask[2:6, 3:7] = [[1, 1, 1, 1], [1, 0, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]]
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(mask)] + [(20, 3)], "row int, col int")
    got = sorted((r["row"], r["col"]) for r in fill_holes(cells, mask.shape).collect())
    assert got == sorted((int(r), int(c)) for r, c in np.argwhere(flooded(mask)))


def test_empty_raster(spark):
    assert fill_holes(spark.createDataFrame([], "row int, col int"), (3, 4)).count() == 0
