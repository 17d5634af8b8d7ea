"""Runs and models against each other, and what to look at first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators.summary import with_measures
from glyphmill.plans.cut import checkpointed


def merge_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs on one roster, their models named by run."""
    parts = [df.withColumn("model", F.concat_ws("@", "model", F.lit(name))) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def contingency(scored: DataFrame, planned: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """By ``by``, how often both, one or none of two models is exactly right on (by, sample_id), and where one has no result."""
    key = [*by, "sample_id"]
    found = checkpointed(scored.where(F.col("model").isin(left, right)).select("model", *key, "exact_match"))  # no texts; measured once for both sides
    side = lambda m, c: found.where(F.col("model") == m).select(*key, F.col("exact_match").alias(c))
    both = planned.select(*key).join(side(left, "l"), key, "left").join(side(right, "r"), key, "left")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    a, b = F.col("l"), F.col("r")
    return both.groupBy(*by).agg(n(a & b, "both_correct"), n(a & ~b, "left_only"), n(~a & b, "right_only"), n(~a & ~b, "both_wrong"), n(a.isNull() | b.isNull(), "missing_pair"))


def variability(per_pass: DataFrame) -> DataFrame:
    """CER over the complete passes of each track and model."""
    done = per_pass.where("missing_count = 0")
    return done.groupBy("track", "model").agg(F.count(F.lit(1)).alias("passes"), F.avg("corpus_cer").alias("mean_cer"), F.stddev_samp("corpus_cer").alias("stddev_cer"), F.min("corpus_cer").alias("min_cer"), F.max("corpus_cer").alias("max_cer"))


def condition_pairs(per_pass: DataFrame) -> DataFrame:
    """Differences of CER between models on the passes that both completed."""
    done = checkpointed(per_pass.where("missing_count < eligible_sample_count").select("track", "model", "pass", "corpus_cer"))  # a few rows; joined to itself
    a, b = done.withColumnsRenamed({"model": "left_model", "corpus_cer": "l"}), done.withColumnsRenamed({"model": "right_model", "corpus_cer": "r"})
    return a.join(b, ["track", "pass"]).where("left_model < right_model").groupBy("track", "left_model", "right_model").agg(F.count(F.lit(1)).alias("passes"), F.avg(F.col("r") - F.col("l")).alias("mean_difference"))


def threshold_sweep(scored: DataFrame, size: Column, thresholds: list[int]) -> DataFrame:
    """Rates over the samples at or over each threshold: each sample goes once to the thresholds it meets."""
    met = F.explode(F.filter(F.array(*[F.lit(x) for x in sorted(thresholds)]), lambda x: x <= size)).alias("threshold")
    out = scored.select("model", "char_edits", "reference_chars", "exact_match", met).groupBy("model", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("exact_match"), 1)).alias("exact"), F.sum("char_edits").alias("char_edits"), F.sum("reference_chars").alias("reference_chars"))
    return out.withColumn("cer", F.try_divide(F.col("char_edits").cast("double"), F.col("reference_chars")))


def overlapping_subgroups(scored: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Rates of groups that a sample may be in several of."""
    names = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))).alias("subgroup")
    return scored.select("model", "exact_match", "cer", names).groupBy("subgroup", "model").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("exact_match"), 1)).alias("exact"), F.avg("cer").alias("mean_cer"))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at the nearest rank of a quantile, which is one of the values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.expr(f"percentile_disc({q}) within group (order by {value})").alias("nearest_rank"))


def worst(results: DataFrame, n: int) -> DataFrame:
    """The n results to look at first: failures, then by error rate."""
    rows = with_measures(results).select("model", "sample_id", "status", F.col("m.cer").alias("cer"), t.flags(F.col("prediction"), F.col("truncated")).alias("flags"))
    return rows.orderBy((F.col("status") == "success").asc(), F.coalesce("cer", F.lit(-1.0)).desc(), "model", "sample_id").limit(n)


def review_queue(results: DataFrame, by: str, n: int) -> DataFrame:
    """n results taken from the buckets in turn."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy("model", "pass", "sample_id"))
    return results.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", by).limit(n).select(by, "turn", "model", "pass", "sample_id")


def flag_histogram(results: DataFrame) -> DataFrame:
    """How often each diagnostic name occurs, by model."""
    names = F.explode(t.error_flags(F.col("reference"), F.col("prediction"), F.col("status"), F.col("truncated"))).alias("flag")
    return results.select("model", names).groupBy("model", "flag").agg(F.count(F.lit(1)).alias("n"))
