"""Timing of responses that come token by token: the first output, the whole, and which streams broke off.

A response counts once its end has come after some output. One that ends without any, reports an error, or stays
silent for ``patience`` is rejected, with what came so far; nothing of it is used as a result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.streaming import ordered

#: Kinds of events.
START, TOKEN, END, ERROR = "start", "token", "end", "error"
STATE = "status string, began long, first_ms long, total_ms long, tokens long"
NOTHING = ("open", None, None, None, 0)


def step(state: tuple[Any, ...], event: tuple[Any, ...]) -> tuple[Any, ...]:
    """The state after an event: number, kind and its time in milliseconds. Before a start only an error counts."""
    status, began, first, total, tokens = state
    _, kind, ms = event
    if kind == ERROR:
        return "rejected", began, first, total, tokens
    if kind == START:
        return (status, ms, first, total, tokens) if began is None else state
    if began is None:
        return state
    if kind == TOKEN:
        return status, began, ms - began if first is None else first, total, tokens + 1
    return ("complete" if tokens else "rejected"), began, first, ms - began, tokens


def timing(events: DataFrame, patience: int = 3600, late: str = "10 minutes") -> DataFrame:
    """key, status (open, complete or rejected), began, first_ms, total_ms and tokens, after each batch that changed a key.

    events: a stream of key, ts, number and kind. patience is in seconds.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "number", "kind", ms.alias("at"))
    fold = ordered.Fold(NOTHING, step, lambda s: s[0] != "open", STATE, [("kind", "string"), ("at", "long")], 1000 * patience, lambda s: ("rejected", *s[1:]))
    return ordered.folded(rows, fold, STATE, late)
