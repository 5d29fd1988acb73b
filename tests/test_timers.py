"""Timers of streams: silence is reported without another event, whatever the batches, and state leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stoa.streaming import dialogue
from stoa.streaming.replay import replayed

EVENTS = "event_id long, ts timestamp, user long, event_type string"


@pytest.fixture(scope="module")
def events(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        (1, 0, 1, "start"), (2, 30, 1, "news"), (3, 100, 1, "done"),  # reached
        (4, 5, 2, "start"), (5, 15, 2, "news"),  # silent from then on
        (6, 10, 3, "start"), (7, 60, 3, "start"), (8, 150, 3, "news"), (9, 155, 3, "done"),  # replaced, then late before its news
        (10, 20, 4, "start"), (11, 45, 4, "news"), (12, 70, 4, "news"), (13, 95, 4, "news"), (14, 118, 4, "news"),  # out of time although not silent
        (15, 160, 5, "start"),  # begun at the end
    ]
    return spark.createDataFrame([(i, at(s), u, k) for i, s, u, k in rows], EVENTS)


WANT = [(1, 1, "no_progress"), (2, 4, "no_progress"), (3, 6, "no_progress"), (3, 7, "no_progress"), (4, 10, "timeout"), (5, 15, "no_progress")]


def moves(df):
    return dialogue.outcomes(df, "user", "start", "news", "done", 40.0, 90.0)


def clocked(events, seconds):
    return dialogue.with_clock(events, events.agg((F.max("ts") + F.make_interval(secs=F.lit(seconds))).alias("ts")), "user")


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_open_moves_end_whatever_the_batches(spark, events, batches):
    got = replayed(clocked(events, 200), moves, f"moves-{batches}", batches=batches)
    assert sorted(tuple(r) for r in got.collect()) == WANT


def test_a_table_has_ended(events):
    assert sorted(tuple(r) for r in moves(events).collect()) == WANT


def test_without_a_clock_others_move_the_time_on(spark, events):
    """User 2's silence is over its limit once user 3 speaks; nobody speaks after user 5's start, so that stays open."""
    got = replayed(events, moves, "moves-open", batches=4)
    assert sorted(tuple(r) for r in got.collect()) == WANT[:-1]


def test_silences(spark, events):
    want = [(1, 2), (1, 3), (2, 5), (3, 6), (3, 7), (3, 9), (4, 14), (5, 15)]
    for batches in (1, 5):
        got = replayed(clocked(events, 100), lambda s: dialogue.silences(s, "user", 45.0), f"silent-{batches}", batches=batches)
        assert sorted((r["user"], r["event_id"]) for r in got.collect()) == want
