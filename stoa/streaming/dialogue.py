"""State of a robot's dialogue and plan, folded from events: pending texts, interrupts, retries, resets, staleness.

Each operator keeps a few values a key. Rows of a batch are taken in order of time, then of their id; it works on
streams and, by one fold over each key's rows, on tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


Step = Callable[[tuple, object], tuple[tuple, list[tuple]]]


def folded(events: DataFrame, key: str, shape: str, state: str, start: tuple, step: Step, deadline: Callable[[tuple], float | None] | None = None, expired: Callable[[tuple], list[tuple]] | None = None) -> DataFrame:
    """Rows that ``step(state, event) -> (state, rows)`` gives for each key's events, with the key before them.

    With ``deadline(state)`` (seconds, or None) a key whose events fall silent isn't left waiting: once the watermark is past its
    deadline, ``expired(state)`` gives its last rows and the state leaves. A step sees the same deadline pass when the next event
    comes first, so rows don't depend on how events fall into batches. Events without a key only move the time on (see
    ``with_clock``). On a table, which has ended, all deadlines pass.
    """
    names = [key, *[part.split()[0] for part in shape.split(", ")]]

    def run(name: object, frame: pd.DataFrame, held: tuple) -> tuple[tuple, list[tuple]]:
        out = []
        for event in frame.sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
            held, rows = step(held, event)
            out += [(name, *r) for r in rows]
        return held, out

    def stream(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            rows = [(group[0], *r) for r in expired(kept.get)]
            kept.remove()
        else:
            held, rows = run(group[0], pd.concat(list(batches)), kept.get if kept.exists else start)
            due = deadline(held) if deadline else None
            if deadline and due is None:
                if kept.exists:
                    kept.remove()
            else:
                kept.update(held)
            if due is not None:
                kept.setTimeoutTimestamp(max(int(due * 1000) + 1, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    def whole(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held, rows = run(group[0], frame, start)
        if deadline and deadline(held) is not None:
            rows += [(group[0], *r) for r in expired(held)]
        return pd.DataFrame(rows, columns=names)

    full = f"{key} {events.schema[key].dataType.simpleString()}, {shape}"
    clean = events.where("ts is not null")
    if events.isStreaming:
        timed = clean.withWatermark("ts", "1 second") if deadline else clean
        timeout = GroupStateTimeout.EventTimeTimeout if deadline else GroupStateTimeout.NoTimeout
        return timed.groupBy(key).applyInPandasWithState(stream, full, state, "append", timeout)
    return clean.groupBy(key).applyInPandas(whole, full)


def with_clock(events: DataFrame, ticks: DataFrame, key: str) -> DataFrame:
    """``events`` and the times of a clock (``ts``), as rows without key: time goes on although all keys are silent."""
    return events.unionByName(ticks.select("ts"), allowMissingColumns=True)


def confirmations(events: DataFrame, key: str, offer: str, confirm: str, reject: str) -> DataFrame:
    """``(key, event_id, answer)``: a confirmation gives the pending offer's id and leaves it, a rejection drops it; without one ``no_pending``."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        (pending,) = s
        if e.event_type == offer:
            return (int(e.event_id),), []
        if e.event_type not in (confirm, reject):
            return s, []
        answer = "no_pending" if pending < 0 else f"{'saved' if e.event_type == confirm else 'dropped'} {pending}"
        return ((-1,) if e.event_type == reject else s), [(int(e.event_id), answer)]

    return folded(events, key, "event_id long, answer string", "pending long", (-1,), step)


def interrupts(events: DataFrame, key: str, interrupt: str, drain: str) -> DataFrame:
    """``(key, event_id, drained_by, place)``: interrupts wait in order of arrival until the next step drains them all."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        waiting = list(s[0])
        if e.event_type == interrupt:
            return ([*waiting, int(e.event_id)],), []
        if e.event_type != drain:
            return s, []
        return ([],), [(i, int(e.event_id), k) for k, i in enumerate(waiting)]

    return folded(events, key, "event_id long, drained_by long, place int", "waiting array<long>", ([],), step)


def retries(events: DataFrame, key: str, failure: str, success: str, most: int = 3) -> DataFrame:
    """``(key, event_id)`` of the failures at which a new instruction is asked for: the ``most``-th since a success or the last ask."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        n = s[0] + 1 if e.event_type == failure else 0 if e.event_type == success else s[0]
        return ((0,), [(int(e.event_id),)]) if n >= most else ((n,), [])

    return folded(events, key, "event_id long", "failures int", (0,), step)


def plan_steps(events: DataFrame, key: str, reset: str) -> DataFrame:
    """``(key, event_id, plan, step)``: a new instruction starts a new plan at step -1; other events are its steps in turn."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        plan, at = (int(e.event_id), -1) if e.event_type == reset else (s[0], s[1] + 1)
        return (plan, at), [(int(e.event_id), plan, at)]

    return folded(events, key, "event_id long, plan long, step int", "plan long, at int", (-1, -1), step)


def stale_links(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """``(key, event_id, silent)``: the first event after a silence of more than ``seconds``, and how long it was."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        now = e.ts.timestamp()
        return (now,), ([(int(e.event_id), now - s[0])] if s[0] >= 0 and now - s[0] > seconds else [])

    return folded(events, key, "event_id long, silent double", "last double", (-1.0,), step)


def silences(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """``(key, event_id, heard)``: the last event before each silence of more than ``seconds``, reported when the time is up,
    whether the key is heard of again or not."""

    def step(s: tuple, e) -> tuple[tuple, list]:
        if e.event_id is None or e.event_id != e.event_id:  # a tick
            return s, []
        now, (last, heard) = e.ts.timestamp(), s
        return (int(e.event_id), now), ([(last, heard)] if last >= 0 and now - heard > seconds else [])

    return folded(events, key, "event_id long, heard double", "event_id long, heard double", (-1, 0.0), step, lambda s: s[1] + seconds if s[0] >= 0 else None, lambda s: [s])


def outcomes(events: DataFrame, key: str, start: str, progress: str, done: str, quiet: float, limit: float) -> DataFrame:
    """``(key, event_id, outcome)`` of each started move: ``reached``, ``no_progress`` once ``quiet`` seconds pass without
    news, ``timeout`` once ``limit`` do in all, ``replaced`` by the next start. Of both times the earlier one names the outcome.
    """

    def due(s: tuple) -> float | None:
        return min(s[2] + quiet, s[1] + limit) if s[0] >= 0 else None

    def late(s: tuple) -> list[tuple]:
        return [(s[0], "no_progress" if s[2] + quiet <= s[1] + limit else "timeout")]

    def step(s: tuple, e) -> tuple[tuple, list]:
        if not isinstance(e.event_type, str):  # a tick
            return s, []
        now, out = e.ts.timestamp(), []
        if s[0] >= 0 and now > due(s):
            out, s = late(s), (-1, s[1], s[2])
        move, began, heard = s
        if e.event_type == start:
            if move >= 0:
                out.append((move, "replaced"))
            return (int(e.event_id), now, now), out
        if move >= 0 and e.event_type == done:
            return (-1, began, now), [*out, (move, "reached")]
        return (move, began, now if e.event_type == progress else heard), out

    return folded(events, key, "event_id long, outcome string", "move long, began double, heard double", (-1, 0.0, 0.0), step, due, late)
