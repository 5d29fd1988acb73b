"""Contrastive scores by blocks against whole tables of logits."""

import numpy as np
import pytest

from stoa.operators import contrast


@pytest.mark.parametrize("block", [1, 7, 512])
def test_blocks_merge_to_whole_log_sums(spark, block):
    """Logits of hundreds, whose exponentials overflow, batches of one row and of many."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for batch, n in ((1, 1), (2, 40), (3, 13)):
        a, b = rng.normal(size=(n, 4)) * 12, rng.normal(size=(n, 4)) * 12
        rows += [(batch, 100 * k, a[k].tolist(), b[k].tolist()) for k in range(n)]
        z = 2.0 * a @ b.T
        sums = lambda m: m.max(1) + np.log(np.exp(m - m.max(1, keepdims=True)).sum(1))
        lost = np.concatenate([sums(z) - np.diag(z), sums(z.T) - np.diag(z)]).mean()
        want[batch] = (n, lost, np.logaddexp(0.0, np.where(np.eye(n) > 0, -1, 1) * (z - 0.5)).mean())
    df = spark.createDataFrame([*rows, (4, 1, None, [1.0] * 4), (None, 2, [1.0] * 4, [1.0] * 4)], "batch long, item long, a array<double>, b array<double>")
    got = {r["batch"]: (r["n"], r["softmax"], r["sigmoid"]) for r in contrast.contrastive(df, 2.0, -0.5, block).collect()}
    assert got.keys() == want.keys()
    for batch, values in want.items():
        assert got[batch] == pytest.approx(values, rel=1e-9)
    assert contrast.contrastive(df.limit(0)).collect() == []


@pytest.mark.parametrize(("block", "held"), [(3, 9), (64, 1), (1, 25)])
def test_parts_merge_and_leave_a_row_each(spark, monkeypatch, block, held):
    """Batches in several parts; what is kept between is a row of a side for each part of its batch, whatever the block."""
    rng = np.random.default_rng(5)
    n, kept = 50, []
    a, b = rng.normal(size=(n, 4)) * 12, rng.normal(size=(n, 4)) * 12
    z = a @ b.T
    sums = lambda m: m.max(1) + np.log(np.exp(m - m.max(1, keepdims=True)).sum(1))
    lost = np.concatenate([sums(z) - np.diag(z), sums(z.T) - np.diag(z)]).mean()
    own = contrast.written
    monkeypatch.setattr(contrast, "written", lambda df, name: kept.append(own(df, name)) or kept[-1])
    df = spark.createDataFrame([(7, 3 * k, a[k].tolist(), b[k].tolist()) for k in range(n)], "batch long, item long, a array<double>, b array<double>")
    got = contrast.contrastive(df, 1.0, 0.5, block, held).collect()
    assert [(r["batch"], r["n"]) for r in got] == [(7, n)]
    assert (got[0]["softmax"], got[0]["sigmoid"]) == pytest.approx((lost, np.logaddexp(0.0, np.where(np.eye(n) > 0, -1, 1) * (z + 0.5)).mean()), rel=1e-9)
    assert sum(df.count() for df in kept) <= 2 * n * -(-n // held)


def test_mask_and_class_losses(spark):
    """Logits of hundreds, empty masks, ignored and missing labels."""
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(3, 30)) * 200, (rng.random((3, 30)) < 0.3).astype(float)
    t[2] = 0
    cells = [(1, m, float(x[m, k]), float(t[m, k])) for m in range(3) for k in range(30)] + [(1, 0, None, 1.0), (2, 0, 1.0, None)]
    df = spark.createDataFrame(cells, "scene long, mask long, x double, t double")
    p = np.exp(-np.logaddexp(0, -x))
    dice = (1 - (2 * (p * t).sum(1) + 1) / (p.sum(1) + t.sum(1) + 1)).mean()
    cross = (np.logaddexp(0, x) - x * t).mean()
    got = contrast.mask_losses(df, "scene", "mask", "x", "t").collect()
    assert [(r["scene"], r["masks"]) for r in got] == [(1, 3)] and (got[0]["dice"], got[0]["cross"]) == pytest.approx((dice, cross))
    rows = spark.createDataFrame([([700.0, 1.0], 0), ([700.0, 1.0], 1), ([0.0, 0.0], 5), ([0.0, 0.0], None), ([3.0, 3.0], 9)], "z array<double>, y int")
    lost = [r[0] for r in rows.select(contrast.class_cross(rows["z"], rows["y"], 9)).collect()]
    assert lost[:2] == pytest.approx([0.0, 699.0]) and lost[2:] == [None] * 3
