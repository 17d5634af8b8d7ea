"""Hashes within a Hamming distance, by multi-index hashing over classes of equal hashes.

Rows with one hash are a class, and only classes are compared, so copies cost a row each. A hash's 64 bits are cut into
m runs; two hashes within distance d agree on at least m - d of them, so each hash is put under every choice of m - d
runs, and hashes that meet are compared. m grows with the number of different hashes, so that hashes of even spread
have about one other under a choice, whatever the table's size. Where hashes crowd under a choice, they go on to a
larger m; a pair that meets nowhere else is found there. The largest m compares all that meet.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.components import connected_components
from glyphmill.operators.skew import skewed_join
from glyphmill.plans.cut import checkpointed

BITS = 64
#: Hashes under one choice of runs that are compared there; runs beyond the distance at most.
CROWD, MOST_RUNS = 256, 6


def _masks(runs: int, distance: int) -> list[int]:
    """The bits of every choice of ``runs - distance`` runs, as signed 64-bit numbers."""
    cuts = [BITS * i // runs for i in range(runs + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x - (1 << BITS) if (x := sum(c)) >= 1 << (BITS - 1) else x for c in combinations(own, runs - distance)]


def runs_for(different: int, distance: int) -> int:
    """The least number of runs whose choices have as many values as there are hashes."""
    return next((m for m in range(distance + 1, distance + MOST_RUNS) if BITS * (m - distance) // m >= math.log2(max(different, 2))), distance + MOST_RUNS)


def classes(df: DataFrame, key: str, bits: str) -> DataFrame:
    """h, class_id (its least key) and n of each different hash that isn't null."""
    return df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n"))


def _met(hashes: DataFrame, runs: int, distance: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs that meet where hashes don't crowd, and the hashes that crowd somewhere; all pairs at the last number of runs."""
    points = checkpointed(hashes.select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in _masks(runs, distance)])).alias("choice", "cell")))
    cells = checkpointed(points.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    last = runs >= distance + MOST_RUNS
    crowded = cells.where(F.col("n") > CROWD)
    few = points.join((cells if last else cells.where(F.col("n") <= CROWD)).select("choice", "cell"), ["choice", "cell"])
    left, right = (few.select("choice", "cell", F.col("h").alias(name)) for name in ("left", "right"))
    gap = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    found = left.join(right, ["choice", "cell"]).where((F.col("left") < F.col("right")) & (gap <= distance)).select("left", "right", gap.alias("distance")).distinct()
    if last or not crowded.limit(1).count():
        return found, None
    total = crowded.agg(F.sum("n")).first()[0]
    return found, skewed_join(points, crowded, ["choice", "cell"], total).select("h").distinct()


def near_hashes(hashes: DataFrame, distance: int) -> DataFrame:
    """left, right and distance of different hashes (column h) that differ in at most ``distance`` bits; left < right."""
    rows = checkpointed(hashes.select("h"))
    runs, found = runs_for(rows.count(), distance), None
    while rows is not None:
        some, rows = _met(rows, runs, distance)
        found = some if found is None else found.union(some)
        if rows is not None:
            rows, runs = checkpointed(rows), runs + 1
    return found.distinct()


def class_links(known: DataFrame, distance: int) -> DataFrame:
    """left_id, right_id (classes, the smaller first) and distance. known: what ``classes`` gives."""
    near = near_hashes(known, distance)
    of = lambda side: known.select(F.col("h").alias(side), F.col("class_id").alias(f"{side}_class"))
    both = near.join(of("left"), "left").join(of("right"), "right")
    return both.select(F.least("left_class", "right_class").alias("left_id"), F.greatest("left_class", "right_class").alias("right_id"), "distance")


def groups(df: DataFrame, key: str, bits: str, distance: int) -> DataFrame:
    """key, class_id and component (the least key that links lead to) of every row with a hash. Each row comes once."""
    known = checkpointed(classes(df, key, bits))
    linked = connected_components(class_links(known, distance).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))).distinct()
    placed = known.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").select("h", "class_id", F.coalesce("component", "class_id").alias("component"), "n")
    rows = df.where(F.col(bits).isNotNull()).select(F.col(key).alias("key"), F.col(bits).alias("h"))
    return skewed_join(rows, placed, ["h"], known.agg(F.sum("n")).first()[0] or 0).select("key", "class_id", "component")
