"""Folds over events in the order of their times, whatever the order and the batches in which they come.

A key's state is what its settled events led to, and the events that still wait. An event settles when the watermark
passes its time, since no earlier one can come then. Each batch gives, for each key it changed, the state that all its
events so far lead to, waiting ones in order of time and number; so the last row of a key doesn't depend on how the
log was cut, as long as no event is later than the watermark allows. Events behind the watermark are dropped by Spark.

Keys share a value of the store and a timer with others of their group (GROUPS). A key whose state is final keeps no events, and every key leaves the store once ``keep`` has passed since its last
settled event; one that isn't final by then may be given a last state. Repeats of an event (same time and number) count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

State = tuple[Any, ...]
Step = Callable[[State, tuple[Any, ...]], State]

#: The state store that timers and lists need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Keys are dealt into so many groups by hash, each with one value in the store and one timer: a call into the store costs
#: more than many keys' events. What a group holds grows with the keys that are open at a time, not with the log.
GROUPS = 4096
#: The time of events that have none, before all others.
NO_TIME = -9_223_372_036_855


class Fold(StatefulProcessor):
    """step(state, (number, *values)) over a key's events. Columns of an event: ts, number and its values."""

    def __init__(self, start: State, step: Step, final: Callable[[State], bool], state: str, values: list[tuple[str, str]], keep_ms: int, expired: Callable[[State], State] | None = None) -> None:
        self.start, self.step, self.final, self.keep_ms, self.expired = start, step, final, keep_ms, expired
        self.state_type = T._parse_datatype_string(state)
        self.event_type = T._parse_datatype_string(", ".join(["ms long", "number long", *(f"{n} {k}" for n, k in values)]))
        self.names = ["ms", "number", *(n for n, _ in values)]
        self.whole = {"ms", "number", *(n for n, k in values if k in ("int", "long", "bigint"))}

    def of(self, key: T.DataType) -> Fold:
        """The fold for keys of a type."""
        one = [T.StructField("key", key), T.StructField("state", self.state_type), T.StructField("last_ms", T.LongType()), T.StructField("waiting", T.ArrayType(self.event_type))]
        self.held_type = T.StructType([T.StructField("wake", T.LongType()), T.StructField("keys", T.ArrayType(T.StructType(one)))])
        if isinstance(key, T.IntegralType):
            self.whole = self.whole | {"key"}
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.held_type)

    def _load(self) -> tuple[int | None, dict[Any, tuple[State, int, list[tuple]]]]:
        """When the group's timer rings, and each key's settled state, the time of its last settled event, and what waits."""
        found = self.held.get()
        if found is None:
            return None, {}
        return found[0], {k: (tuple(state), last, [tuple(x) for x in waiting]) for k, state, last, waiting in found[1]}

    def _store(self, before: int | None, wake: int | None, keys: dict[Any, tuple[State, int, list[tuple]]]) -> None:
        """``before``: a timer that is still set. There is one timer at most."""
        if wake != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if wake is not None:
                self.handle.registerTimer(wake)
        if keys:
            self.held.update((wake, [(k, *x) for k, x in keys.items()]))
        else:
            self.held.clear()

    def _fold(self, state: State, events: list[tuple]) -> State:
        for _, *event in events:
            if self.final(state):
                break
            state = self.step(state, tuple(event))
        return state

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wake, keys = self._load()
        new: dict[Any, set[tuple]] = {}
        for frame in rows:
            columns = [self._plain(n, frame[n]) for n in self.names]
            for k, named, event in zip(self._plain("key", frame["key"]), frame["named"], zip(*columns, strict=True), strict=True):
                new.setdefault(k if named else None, set()).add(event)
        out = []
        for k, some in new.items():
            state, last, waiting = keys.get(k, (self.start, 0, []))
            events = sorted(some.union(waiting), key=lambda x: x[:2])
            keys[k] = state, last, [] if self.final(state) else events
            out.append((k, *self._fold(state, events)))
        first = min(x[0] for some in new.values() for x in some) + 1
        self._store(wake, first if wake is None else min(first, wake), keys)
        yield pd.DataFrame(out, dtype=object)

    def _plain(self, name: str, column: pd.Series) -> list:
        """Values as the store takes them: pandas makes whole numbers beside nulls floats."""
        values = column.tolist()
        if not column.hasnans:
            return list(map(int, values)) if name in self.whole and column.dtype.kind == "f" else values
        return [None if v is None or v != v else int(v) if name in self.whole else v for v in values]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        _, keys = self._load()
        out, left, wakes = [], {}, []
        for k, (state, last, waiting) in keys.items():
            due, rest = [x for x in waiting if x[0] <= until], [x for x in waiting if x[0] > until]
            if due:
                state, last = self._fold(state, due), max(last, due[-1][0])
            if self.final(state):
                rest = []
            if not rest and last + self.keep_ms < until:
                if self.expired and not self.final(state):
                    out.append((k, *self.expired(state)))
                continue
            left[k] = state, last, rest
            wakes.append((rest[0][0] if rest else last + self.keep_ms) + 1)
        self._store(None, min(wakes, default=None), left)
        if out:
            yield pd.DataFrame(out, dtype=object)

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, state: str, late: str) -> DataFrame:
    """key and state after each batch, for each key that it changed. events: a stream of key, ts, number and values."""
    key = events.schema["key"]
    output = T.StructType([T.StructField("key", key.dataType), *T._parse_datatype_string(state).fields])
    ms = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(NO_TIME))
    # Null keys are a key like others; a null among whole numbers would make floats of all in pandas.
    named = F.coalesce("key", F.lit(0).cast(key.dataType))
    rows = events.withWatermark("ts", late).select("ts", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group"), named.alias("key"), F.col("key").isNotNull().alias("named"), ms.alias("ms"), *fold.names[1:])
    return rows.groupBy("group").transformWithStateInPandas(statefulProcessor=fold.of(key.dataType), outputStructType=output, outputMode="Update", timeMode="eventTime")


def drained(stream: DataFrame, folder: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The last row of every key, once a stream has given all that it has; updates are kept as files."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), "batch long"])
    rows = spark.read.schema(schema).parquet(f"{folder}/out/*")
    names = [f.name for f in stream.schema if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(*keys, "x.*")
