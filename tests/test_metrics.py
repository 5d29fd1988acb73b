"""Metrics from merged states: split runs equal one run, and equal plain Python."""

import numpy as np
import pytest

from stoa.operators import masks, metrics


def area(rows: list) -> float | None:
    """Average precision of ``(score, hit, missed)`` rows, equal scores with their hits first."""
    ranked = sorted((-s, -h) for s, h, m in rows if not m)
    instances = sum(h or m for _, h, m in rows)
    if not instances:
        return None
    tp = np.cumsum([-h for _, h in ranked]) if ranked else np.array([])
    p = tp / np.arange(1, len(ranked) + 1)
    return sum(p[k:].max() for k, (_, h) in enumerate(ranked) if h) / instances


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_split_runs_equal_one(spark, tmp_path, parts):
    """Ties of scores within and across runs, a hot class, a class without masks and one without instances."""
    rng = np.random.default_rng(8)
    rows = [(int(c), float(o), round(float(s), 2), int(h), 0) for c, o, s, h in zip(rng.choice([0, 0, 0, 1, 2], 600), rng.choice([0.25, 0.5], 600), rng.random(600), rng.random(600) < 0.6, strict=True)]
    rows += [(0, 0.5, 0.0, 0, 1)] * 9 + [(3, 0.25, 0.0, 0, 1)] * 2 + [(4, 0.5, 0.7, 0, 0)]
    points = [(int(a), int(b)) for a, b in rng.integers(0, 5, (400, 2))] + [(None, 3), (7, None)]
    for k in range(parts):
        found = spark.createDataFrame(rows[k::parts], "class long, overlap double, score double, hit int, missed int")
        seen = spark.createDataFrame(points[k::parts], "gt long, pred long")
        state = metrics.merged(metrics.matching_state(found), metrics.confusion_state(seen))
        for _ in range(1 + (k == 0)):  # the first run is saved twice
            metrics.saved(state, str(tmp_path / "state"), f"run-{k}")
    state = metrics.continued(spark, str(tmp_path / "state"))
    got = {(r["class"], r["overlap"]): r["ap"] for r in metrics.average_precisions(state).collect()}
    want = {(c, o): area([r[2:] for r in rows if r[:2] == (c, o)]) for c in range(5) for o in (0.25, 0.5)}
    assert got == pytest.approx({k: v for k, v in want.items() if v is not None})
    assert got[3, 0.25] == 0.0 and (4, 0.5) not in got
    whole = spark.createDataFrame(rows, "class long, overlap double, score double, hit int, missed int")
    same = {(r["class"], r["overlap"]): r["ap"] for r in masks.average_precision(whole, ["class", "overlap"]).collect()}
    assert got == pytest.approx(same)
    scores = {r["class"]: (r["iou"], r["accuracy"]) for r in metrics.class_scores(state).collect()}
    real = [p for p in points if p[0] is not None]
    for c in {0, 1, 2, 3, 4, 7}:
        tp, g, q = (sum(f(a, b) for a, b in real) for f in (lambda a, b: a == b == c, lambda a, b: a == c, lambda a, b: b == c))  # noqa: B023
        assert scores[c] == pytest.approx((tp / (g + q - tp), tp / g))
    assert scores.keys() == {0, 1, 2, 3, 4, 7}


def test_empty_states_and_names(spark, tmp_path):
    none = spark.createDataFrame([], metrics.STATE)
    assert metrics.average_precisions(none).collect() == [] and metrics.class_scores(none).collect() == []
    with pytest.raises(ValueError, match="letters"):
        metrics.saved(none, str(tmp_path), "../x")
