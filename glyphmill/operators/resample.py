"""Cluster bootstrap over documents.

A corpus rate of resampled documents is a ratio of sums, and so is a score before its last step; sums by document
are all that a replicate needs. Draws come from hashes of seed, replicate and position, the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.scoring import Policy, _score
from glyphmill.plans.cut import checkpointed


def numbered(documents: DataFrame) -> DataFrame:
    """source_document and place, from 0 in their order, without gathering them: sorted ranges, each after the counts before it."""
    ranges = documents.select("source_document").distinct().repartitionByRange(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_document").sortWithinPartitions("source_document")
    placed = checkpointed(ranges.select("source_document", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("source_document", (F.col("before") + F.col("at")).alias("place"))


def pair_seed(seed: int, track: Column, left: Column, right: Column) -> Column:
    """The seed of a pair's replicates on a track, from 0 to 2^64 - 1, as a decimal."""
    parts = F.concat_ws("\0", F.lit(str(seed)), track, left, right)
    return F.conv(F.substr(F.sha2(parts.cast("binary"), 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def draws(documents: DataFrame, replicates: int, seed: int) -> DataFrame:
    """replicate, document and how often it was drawn: as many draws as there are documents, dealt over all tasks."""
    places = numbered(documents)
    n = max(1, places.count())
    each = places.sparkSession.range(replicates * n).selectExpr(f"id div {n} as replicate", f"id % {n} as draw")
    at = F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(seed), "replicate", "draw")), F.lit(1), F.lit(8)), 16, 10).cast("long") % n
    return each.select("replicate", at.alias("place")).groupBy("replicate", "place").count().join(places, "place").select("replicate", "source_document", F.col("count").alias("times"))


def paired_difference(scored: DataFrame, left: str, right: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Corpus CER of right less left on samples that both have, with a percentile interval."""
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    both = scored.where(F.col("model").isin(left, right)).groupBy("sample_id", "source_document").agg(of(left, "char_edits").alias("el"), of(left, "reference_chars").alias("cl"), of(right, "char_edits").alias("er"), of(right, "reference_chars").alias("cr"))
    pairs = both.where("el is not null and er is not null")
    sums = checkpointed(pairs.groupBy("source_document").agg(*[F.sum(c).alias(c) for c in ("el", "cl", "er", "cr")]))
    rate = lambda e, c: F.try_divide(F.sum(F.col("times") * F.col(e)).cast("double"), F.sum(F.col("times") * F.col(c)))
    deltas = draws(sums, replicates, seed).join(sums, "source_document").groupBy("replicate").agg((rate("er", "cr") - rate("el", "cl")).alias("delta"))
    ends = deltas.agg(F.percentile("delta", 0.025).alias("ci_low"), F.percentile("delta", 0.975).alias("ci_high"), F.count("delta").alias("replicates"))
    point = sums.agg((F.try_divide(F.sum("er").cast("double"), F.sum("cr")) - F.try_divide(F.sum("el").cast("double"), F.sum("cl"))).alias("difference"), F.count(F.lit(1)).alias("documents"))
    return point.crossJoin(ends).select(F.lit(left).alias("left_model"), F.lit(right).alias("right_model"), "documents", "difference", "ci_low", "ci_high", "replicates")


def joint_bootstrap(cells: DataFrame, policy: Policy = Policy(), replicates: int = 250, seed: int = 42) -> DataFrame:
    """Intervals of model scores: all passes of a drawn document stay together."""
    live = cells.where("outcome <> 'unsupported'")
    sums = checkpointed(live.groupBy("track", "model", "pass", "source_document").agg(F.sum("char_edits").alias("e"), F.sum("reference_chars").alias("c"), F.count(F.when(F.col("exact_match"), 1)).alias("x"), F.count(F.lit(1)).alias("n")))
    w = lambda c: F.sum(F.col("times") * F.col(c)).cast("double")
    drawn = draws(sums, replicates, seed).join(sums, "source_document").groupBy("track", "model", "pass", "replicate").agg(F.try_divide(w("e"), w("c")).alias("cer"), F.try_divide(w("x"), w("n")).alias("exact"))
    scores = drawn.withColumn("score", _score(F.col("cer"), F.col("exact"), policy)).groupBy("track", "model", "replicate").agg(F.avg("score").alias("score"))
    return scores.groupBy("track", "model").agg(F.percentile("score", 0.025).alias("ci_low"), F.percentile("score", 0.975).alias("ci_high"), F.count("score").alias("replicates"))
