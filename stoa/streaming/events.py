"""Stateful streams of robot events: frames, non-refreshing repeats and link watchdogs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FEEDBACK = "command string, commanWd string, type string, code string, description string, data struct<target: string, markers: array<string>>, results struct<current_pose: struct<x: double, y: double, theta: double>, navigation_status: string>"


def frames(lines: DataFrame, value: str = "value") -> DataFrame:
    """Newline-framed JSON messages: one row each, malformed ones left out; a misspelt command key counts."""
    texts = lines.withColumn("_frame", F.explode(F.split(value, "\n"))).where(F.trim("_frame") != "")
    read = texts.withColumn("_m", F.from_json("_frame", FEEDBACK)).where(F.coalesce("_m.command", "_m.commanWd", "_m.type", "_m.code").isNotNull())
    return read.select(
        *lines.drop(value).columns, F.coalesce("_m.command", "_m.commanWd").alias("command"), F.col("_m.type").alias("type"),
        F.col("_m.code").alias("code"), F.col("_m.results.current_pose").alias("pose"),
        F.col("_m.data.target").alias("target"), F.col("_m.data.markers").alias("markers"), F.col("_m.results.navigation_status").alias("navigation_status"),
    )


def without_repeats(said: DataFrame, key: str = "robot_id", seconds: float = 2.0) -> DataFrame:
    """``(key, ts, text)`` less texts equal to the last kept one within ``seconds``; what is dropped doesn't refresh it.

    One key's rows of a batch are taken in order of (ts, text); its state is one text and time.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "text"], kind="stable")
        kept = []
        for row in rows.itertuples(index=False):
            now = row.ts.timestamp()
            if row.text != text or now - at > seconds:
                text, at = row.text, now
                kept.append((group[0], row.ts, row.text))
        state.update((text, at))
        yield pd.DataFrame(kept, columns=[key, "ts", "text"])

    rows = said.where("ts is not null and text is not null").select(key, "ts", "text")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, text string", "text string, at double", "append", GroupStateTimeout.NoTimeout)


def watchdog(checks: DataFrame, key: str = "iface", failures: int = 3, cooldown: float = 10.0) -> DataFrame:
    """``(key, ts, reset)``: a reset at the failure that makes ``failures`` in a row, at least ``cooldown`` seconds after the last."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, -1e18)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            count = 0 if row.ok else count + 1
            now = row.ts.timestamp()
            if count >= failures and now - last >= cooldown:
                out.append((group[0], row.ts, count))
                count, last = 0, now
        state.update((count, last))
        yield pd.DataFrame(out, columns=[key, "ts", "failures"])

    rows = checks.where("ts is not null and ok is not null").select(key, "ts", "ok")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, failures int", "count int, last double", "append", GroupStateTimeout.NoTimeout)
