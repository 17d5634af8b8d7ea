"""Splits that keep documents and writers whole, the largest groups first to the split that lacks most.

Each split gets one group in seeded order. The others come by size, the largest first, and in seeded order among equal
ones; each goes to the split that is furthest below its share. What that gives depends on the histogram of sizes alone:
it has at most sqrt(2 n) rows for n samples, and comes to the driver. For groups of one size the splits whose lack is
within a group's size of each other take turns until they reach the next one, so a size has a few phases: from which
rank on, and which splits in turn. A group's rank among those of its size is a running count, over ranges where a size
has very many groups.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.components import connected_components
from glyphmill.operators.running import running_sums
from glyphmill.plans.cut import checkpointed

Phase = tuple[int, list[str]]


def turns(target: dict[str, float], count: dict[str, int], size: int, groups: int) -> list[Phase]:
    """Phases (first rank, splits in turn) of ``groups`` groups of one size. target is in order of precedence; count is brought up to date."""
    out: list[Phase] = []
    done = 0
    while done < groups:
        lack = {s: target[s] - count[s] for s in target}
        ranked = sorted(target, key=lack.__getitem__, reverse=True)  # equal ones stay in order
        active = [s for s in ranked if lack[ranked[0]] - lack[s] < size]
        rest = ranked[len(active) :]
        rounds = (groups - done) // len(active)
        if rest:
            rounds = min(rounds, int((lack[active[-1]] - lack[rest[0]]) // size))
        if rounds < 1:
            active, rounds = ranked[:1], 1
        out.append((done, active))
        for s in active:
            count[s] += size * rounds
        done += rounds * len(active)
    return out


def _groups(samples: DataFrame, writers: bool) -> DataFrame:
    """sample_id and split_group: the least of the documents and writers that samples tie together, or the document."""
    document = F.concat(F.lit("d"), F.trim(F.col("source_document").cast("string")))
    writer = F.concat(F.lit("w"), F.trim(F.col("writer_id").cast("string")))
    rows = samples.select("sample_id", document.alias("node"), *([writer.alias("other")] if writers else []))
    bad = rows.where("node is null or node = 'd'" + (" or other is null or other = 'w'" if writers else "")).limit(1).collect()
    if bad:
        raise ValueError(f"without a document{' or writer' if writers else ''}: {bad[0]['sample_id']}")
    if not writers:
        return rows.select("sample_id", F.col("node").alias("split_group"))
    group = connected_components(rows.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()).distinct()
    return rows.join(group, "node").select("sample_id", F.col("component").alias("split_group"))


def grouped_split(samples: DataFrame, ratios: dict[str, float], seed: int, writers: bool = True) -> DataFrame:
    """sample_id, split_group and split. Fewer groups than splits, or a sample without a document, is an error."""
    if min(ratios.values()) < 0 or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must be non-negative and sum to 1")
    names = [s for s in ratios if ratios[s] > 0]
    random.Random(seed).shuffle(names)
    rows = checkpointed(_groups(samples, writers))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("split_group")))
    groups = checkpointed(rows.groupBy("split_group").agg(F.count(F.lit(1)).alias("size")).withColumn("place", order))
    first = groups.orderBy("place", "split_group").limit(len(names)).collect()
    if len(first) < len(names):
        raise ValueError(f"{len(names)} splits need as many groups")
    spark = samples.sparkSession
    given = spark.createDataFrame([(g.split_group, s) for g, s in zip(first, names, strict=True)], "split_group string, split string")
    others = groups.join(F.broadcast(given), "split_group", "left_anti")
    sizes = others.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    total = sum(g["size"] for g in first) + sum(x["size"] * x["n"] for x in sizes)
    target, count = {s: total * ratios[s] for s in names}, {s: g["size"] for g, s in zip(first, names, strict=True)}
    ranked = running_sums(others, ["size"], ["place", "split_group"], {"rank": F.lit(1).cast("long")})
    placed = ranked.join(_phases(spark, [(x["size"], turns(target, count, x["size"], x["n"])) for x in sizes]), "size")
    rank = F.col("rank") - 1
    phase = F.element_at(F.filter("phases", lambda p: p["start"] <= rank), -1)
    split = F.get(phase["splits"], ((rank - phase["start"]) % F.size(phase["splits"])).cast("int"))
    every = placed.select("split_group", split.alias("split")).union(given)
    return rows.join(every, "split_group").select("sample_id", "split_group", "split")


def _phases(spark: SparkSession, of: list[tuple[int, list[Phase]]]) -> DataFrame:
    return spark.createDataFrame(of, "size long, phases array<struct<start: long, splits: array<string>>>")
