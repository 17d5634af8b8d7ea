"""From attempts to results: each key's attempts go through states until one is final, exactly once.

A key waits, retries after a failure that may pass, pauses when asked to wait, and ends in success or error. A
failure that won't pass ends it at once, one that may after ``RETRIES`` retries. What comes after the end changes
nothing. Attempts of a key are taken in the order of their times and numbers, whatever the batches they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from glyphmill.streaming import ordered

RETRIES = 2
FINAL = ("success", "error")
OUTPUT = "key long, state string, attempts int, at long"
_STATE = "state string, attempts int, at long"
_NAMES = ["state", "attempts", "at"]
START = ("waiting", 0, -1)


def step(state: str, attempts: int, outcome: str) -> tuple[str, int]:
    """The state after an attempt's outcome: success, permanent, retryable or wait."""
    if state in FINAL:
        return state, attempts
    if outcome == "wait":
        return "paused", attempts
    attempts += 1
    if outcome == "success":
        return "success", attempts
    if outcome == "permanent" or attempts > RETRIES:
        return "error", attempts
    return "retrying", attempts


def _advance(state: tuple[str, int, int], rows: Iterator[tuple[int, str]]) -> tuple[str, int, int]:
    now, attempts, at = state
    for number, outcome in rows:
        if now not in FINAL:
            now, attempts = step(now, attempts, outcome)
            at = number
    return now, attempts, at


def _frame(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["ts", "number"])
    return pd.DataFrame([(key[0], *_advance(START, zip(frame["number"], frame["outcome"], strict=True)))], columns=["key", *_NAMES])


def results(attempts: DataFrame, late: str = "2 hours", keep: int = 24 * 3600) -> DataFrame:
    """key, state, attempts and at (the number of the attempt that led there) of (key, ts, number, outcome).

    On a frame, a row for each key. On a stream a row for each key that a batch has changed, see ``ordered``: attempts
    may come out of order by ``late``, and a key leaves the store ``keep`` seconds after its last one.
    """
    if not attempts.isStreaming:
        return attempts.groupBy("key").applyInPandas(_frame, OUTPUT)
    fold = ordered.Fold(START, lambda state, event: _advance(state, iter([event])), lambda state: state[0] in FINAL, _STATE, [("outcome", "string")], 1000 * keep)
    return ordered.folded(attempts, fold, _STATE, late)


drained = ordered.drained
