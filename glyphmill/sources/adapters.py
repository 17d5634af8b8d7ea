"""Systems under test as plug-ins: a factory makes one for each task, which sees samples but never their references."""

from __future__ import annotations

import hashlib
import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "model string, sample_id long, status string, prediction string, error string, latency_seconds double"


class Adapter(Protocol):
    """What a system does; load and unload frame a task's samples."""

    def load(self) -> None: ...
    def transcribe(self, sample: dict) -> str: ...
    def unload(self) -> None: ...


@dataclass(frozen=True)
class Capabilities:
    """Tracks and sample types that a system can do; None allows all."""

    tracks: frozenset[str] | None = None
    sample_types: frozenset[str] | None = None
    concurrency: int = 1
    fields: tuple[str, ...] = field(default=("image",))


def admitted(samples: DataFrame, c: Capabilities) -> DataFrame:
    """Samples with ``supported``; asking for more at once than one, or for references, is an error before any work."""
    if c.concurrency < 1:
        raise ValueError("concurrency must be at least 1")
    if barred := {"reference", "metrics"} & set(c.fields):
        raise ValueError(f"a system must not see {sorted(barred)}")
    inside = lambda col, some: F.lit(True) if some is None else F.coalesce(F.col(col).isin(*some), F.lit(False))
    return samples.withColumn("supported", inside("track", c.tracks) & inside("sample_type", c.sample_types))


def run(samples: DataFrame, name: str, factory: Callable[[], Adapter], c: Capabilities) -> DataFrame:
    """Results of a system: unsupported samples aren't given to it, one that raises is an error of that sample alone."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = None
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                if not row.pop("supported"):
                    rows.append((name, row["sample_id"], "unsupported", None, None, None))
                    continue
                if system is None:
                    system = factory()
                    system.load()
                began = time.perf_counter()
                try:
                    text, why = system.transcribe(row), None
                except Exception as e:  # noqa: BLE001
                    text, why = None, f"{type(e).__name__}: {e}"
                rows.append((name, row["sample_id"], "error" if why else "success", text, why, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["model", "sample_id", "status", "prediction", "error", "latency_seconds"])
        if system is not None:
            system.unload()

    return admitted(samples, c).select("sample_id", "supported", *c.fields).mapInPandas(work, RESULT)


def source_fingerprint(factory: Callable[[], Adapter]) -> str:
    """Digest of a plug-in's source, for a run's manifest."""
    return hashlib.sha256(inspect.getsource(factory).encode()).hexdigest()


class Plain:
    """A system for tests: what it reads, each e as a 3; it fails on nothing to read."""

    def load(self) -> None:
        self.ready = True

    def transcribe(self, sample: dict) -> str:
        if not self.ready or not sample["image"].strip():
            raise ValueError("nothing to read")
        return sample["image"].replace("e", "3")

    def unload(self) -> None:
        self.ready = False


#: Systems by provider, with what each says of itself.
PROVIDERS: dict[str, tuple[Callable[[], Adapter], Capabilities]] = {"test": (Plain, Capabilities(tracks=frozenset({"prose", "word"})))}


def backend(selector: str) -> tuple[str, Callable[[], Adapter], Capabilities]:
    """Model name, factory and capabilities of ``provider:model``; an unknown provider is an error."""
    provider, _, model = selector.partition(":")
    if provider.lower() not in PROVIDERS or not model:
        raise ValueError(f"unknown system {selector!r}; providers are {sorted(PROVIDERS)}")
    return model, *PROVIDERS[provider.lower()]


def model_listing(spark) -> DataFrame:
    """provider, tracks and source of the systems that can be asked for."""
    rows = [(p, sorted(c.tracks) if c.tracks else None, source_fingerprint(f)) for p, (f, c) in PROVIDERS.items()]
    return spark.createDataFrame(rows, "provider string, tracks array<string>, source string")
