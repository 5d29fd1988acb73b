"""A robot's navigation state, folded from its notifications, one state per robot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Notification codes and the status that each leads to; 01002 only outside a cruise, 02004 leaves it as it is.
STATUS = {
    "01101": "running", "01102": "succeeded", "01104": "failed", "01001": "running", "01002": "succeeded",
    "01004": "failed", "01005": "running", "01006": "running", "02003": "failed",
}
CRUISE_START, CRUISE_DONE, CRUISE_CANCELLED, MOVING, REACHED, EMERGENCY_STOP = "01101", "01102", "01104", "01001", "01002", "02003"
STATE = "status string, markers array<string>, at int, active boolean, done boolean, target string, reached string"


def _after(s: dict, code: str, target: str | None, markers: list[str]) -> None:
    """Takes one notification into the state ``s``."""
    if code == CRUISE_START and markers:
        s.update(markers=markers, at=-1, active=True, done=False)
    if code in (CRUISE_DONE, CRUISE_CANCELLED, EMERGENCY_STOP):
        s.update(active=False, done=code == CRUISE_DONE)
    if code == REACHED:
        target = target or s["target"]
        s["reached"] = target or s["reached"]
    if code == MOVING and target:
        s["target"] = target
    if target and target in s["markers"] and (code == REACHED or code == MOVING and s["active"]):
        s["at"] = s["markers"].index(target)
    if code in STATUS and not (code == REACHED and s["active"]):
        s["status"] = STATUS[code]


def navigation(notes: DataFrame, key: str = "robot_id") -> DataFrame:
    """``(key, ts, code, status, cruise_index, cruise_active, cruise_done, reached)`` after each notification.

    ``notes`` has ``ts, code, target, markers``, and rows are taken in order of (ts, code) within a batch. A stated
    ``navigation_status``, where that column is there and not null, becomes the status. Rows without a time, or
    with neither code nor status, are left out; unknown codes change nothing. Works on streams and on tables.
    """

    def fold(name: object, frame: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        names = [part.split()[0] for part in STATE.split(", ")]
        s = dict(zip(names, held or (None, [], -1, False, False, None, None), strict=True))
        s["markers"] = list(s["markers"])
        out = []
        for row in frame.sort_values(["ts", "code"], kind="stable").itertuples(index=False):
            if row.said:
                s["status"] = row.said
            if row.code:
                _after(s, row.code, row.target, [] if row.markers is None else list(row.markers))
            out.append((name, row.ts, row.code, s["status"], s["at"], s["active"], s["done"], s["reached"]))
        return pd.DataFrame(out, columns=[key, "ts", "code", "status", "cruise_index", "cruise_active", "cruise_done", "reached"]), tuple(s[n] for n in names)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held = fold(group[0], pd.concat(list(batches)), state.get if state.exists else None)
        state.update(held)
        yield out

    def whole(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return fold(group[0], frame, None)[0]

    said = F.col("navigation_status") if "navigation_status" in notes.columns else F.lit(None).cast("string")
    rows = notes.select(key, "ts", "code", "target", "markers", said.alias("said")).where("ts is not null and (code is not null or said is not null)")
    kind = rows.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, ts timestamp, code string, status string, cruise_index int, cruise_active boolean, cruise_done boolean, reached string"
    if not rows.isStreaming:
        return rows.groupBy(key).applyInPandas(whole, shape)
    return rows.groupBy(key).applyInPandasWithState(step, shape, STATE, "append", GroupStateTimeout.NoTimeout)


def answered(asked: DataFrame, done: DataFrame, key: str = "audio_id", seconds: int = 60) -> DataFrame:
    """``(key, asked_at, done_at)``: requests and their end messages, joined on the id within ``seconds``; late rows leave the state."""
    wait = f"{seconds} seconds"
    a = asked.select(key, F.col("ts").alias("asked_at")).withWatermark("asked_at", wait)
    d = done.select(F.col(key).alias("_id"), F.col("ts").alias("done_at")).withWatermark("done_at", wait)
    return a.join(d, (F.col(key) == F.col("_id")) & F.expr(f"done_at BETWEEN asked_at AND asked_at + INTERVAL {wait}")).drop("_id")
