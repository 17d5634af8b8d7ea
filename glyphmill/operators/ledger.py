"""What requests reserve and what they turn out to cost, against a limit, event by event.

A request reserves an amount when it starts; when it finishes, that is freed and its cost counts, or its cost is unknown.
Nothing may start while a cost is unknown, nor once costs and open reservations reach the limit. Amounts are whole
numbers, such as millionths of a dollar.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running_sums

RESERVE, FINISH = "reserve", "finish"
STATE = "spent long, reserved long, unknown long, open long"
START = (0, 0, 0, 0)


def findings(events: DataFrame) -> DataFrame:
    """ledger, request and what is wrong: finished without a start or before it, or anything twice."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("ts", "number")))
    times = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    of = events.groupBy("ledger", "request").agg(times(RESERVE).alias("starts"), times(FINISH).alias("ends"), at(RESERVE).alias("began"), at(FINISH).alias("ended"))
    why = F.when(F.col("starts") > 1, "reserved_twice").when(F.col("ends") > 1, "finished_twice").when(F.col("starts") == 0, "never_reserved").when(F.col("ended") < F.col("began"), "finished_before")
    return of.select("ledger", "request", why.alias("finding")).where("finding is not null")


def may_start(spent: Column, reserved: Column, unknown: Column, amount: Column, limit: int) -> Column:
    total = spent + reserved
    return (unknown == 0) & (total < limit) & (total + amount <= limit)


def running(events: DataFrame, limit: int, amount: int) -> DataFrame:
    """After each event of a ledger: spent, reserved, unknown, open requests, and whether a request for ``amount`` may start.

    events: ledger, ts, number, request, kind, amount (what a request reserves) and cost (null if unknown, or not yet
    known). What a finish frees is what its request reserved. A ledger as large as the table is summed in ranges.
    """
    starts = F.col("kind") == RESERVE
    amounts = events.where(starts).select("ledger", "request", F.col("amount").alias("held"))
    rows = events.join(amounts, ["ledger", "request"], "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sums = {
        "spent": F.when(starts, none).otherwise(F.coalesce("cost", none)),
        "reserved": F.when(starts, F.col("held")).otherwise(-F.col("held")),
        "unknown": F.when(~starts & F.col("cost").isNull(), one).otherwise(none),
        "open": F.when(starts, one).otherwise(-one),
    }
    out = running_sums(rows, ["ledger"], ["ts", "number", "kind", "held", "cost"], sums)
    return out.select("ledger", "number", "kind", "spent", "reserved", "unknown", "open", may_start(F.col("spent"), F.col("reserved"), F.col("unknown"), F.lit(amount), limit).alias("may_start"))


def step(state: tuple[Any, ...], event: tuple[Any, ...]) -> tuple[Any, ...]:
    """The same for one event after another; an event is number, kind, amount and cost, a finish with its request's amount."""
    spent, reserved, unknown, open_ = state
    _, kind, amount, cost = event
    if kind == RESERVE:
        return spent, reserved + amount, unknown, open_ + 1
    return spent + (cost or 0), reserved - amount, unknown + (cost is None), open_ - 1
