"""From results to scores: cells, passes, models.

A cell is one (model, pass, sample). A missing or failed cell counts as all deletions, an unsupported one leaves the
denominator. A pass's score is 100 (w_c max(0, 1 - CER) + w_e EM); a model's is the mean of its passes'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.plans.cut import checkpointed


@dataclass(frozen=True)
class Policy:
    character_weight: float = 0.95
    exact_weight: float = 0.05
    margin: float = 0.5

    def __post_init__(self) -> None:
        if min(self.character_weight, self.exact_weight) < 0 or abs(self.character_weight + self.exact_weight - 1) > 1e-9:
            raise ValueError("weights must be non-negative and sum to 1")
        if not 0 <= self.margin <= 100:
            raise ValueError("margin must be between 0 and 100")


def track(content_type: Column) -> Column:
    """Words count as prose."""
    return F.when(content_type == "equation", F.lit("equation")).otherwise(F.lit("prose"))


def spread(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """df dealt out by key. Measuring costs far more than the bytes show, so small inputs mustn't be gathered into a task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _measurable() -> Column:
    return (F.col("status") == "success") & F.col("prediction").isNotNull() & t.has_text(F.col("reference"))


def measured(results: DataFrame, m: Column) -> DataFrame:
    """results with ``m``, computed where they lie; no later step can push it down, pull it apart and compute it again."""
    return results.select("*", F.explode(F.array(m)).alias("m"))


def scored(results: DataFrame, raw: bool = False) -> DataFrame:
    """Successful results with their measures as columns.

    Rows are measured where they lie, equal pairs of a batch once. So results should be made of samples that are dealt
    out (``spread``): then each text is sent once and not with each prediction, and those of a sample lie side by side.
    """
    text = ["sample_id", "reference", "prediction"]
    found = measured(results.where(_measurable()), t.score(F.col("prediction"), F.col("reference"), raw))
    return found.select(*text, *[c for c in results.columns if c not in text], "m.*")


def spine(samples: DataFrame, models: DataFrame, passes: DataFrame) -> DataFrame:
    """Every planned cell. Models and passes are a plan's few rows; the samples stay where they are."""
    return samples.crossJoin(F.broadcast(models.crossJoin(passes)))


def _bad(results: DataFrame) -> DataFrame:
    bad = results.select("model", "pass", "sample_id", F.when(F.col("status") == "unsupported", "unsupported").otherwise("failed").alias("outcome"), "status")
    return bad.where("status <> 'success'").drop("status")


def outcomes(samples: DataFrame, models: DataFrame, passes: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of every planned cell as ``cells`` has it, without measures: texts are neither dealt out nor compared."""
    keys = ["model", "pass", "sample_id"]
    got = results.where(_measurable()).select(*keys, F.lit("success").alias("outcome")).unionByName(_bad(results))
    planned = spine(samples.select("sample_id", track(F.col("content_type")).alias("track")), models.select("model"), passes)
    return planned.join(got, keys, "left").select("track", *keys, F.coalesce("outcome", F.lit("missing")).alias("outcome"))


def cells(samples: DataFrame, models: DataFrame, passes: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome and penalised counts of every planned cell. No text is joined, only counts of it."""
    sized = samples.select("sample_id", "source_document", track(F.col("content_type")).alias("track"), t.sizes("reference").alias("n")).select("sample_id", "source_document", "track", "n.*")
    keys = ["model", "pass", "sample_id"]
    good = scored(results.select(*keys, "status", "reference", "prediction", "cache_hit", "latency_seconds"))
    empty = ~t.has_text(F.col("prediction"))
    good = good.select(*keys, F.lit("success").alias("outcome"), empty.alias("empty"), "cache_hit", "latency_seconds", "char_edits", "word_edits", "exact_match")
    got = good.unionByName(_bad(results), allowMissingColumns=True)
    joined = spine(sized, models.select("model", "ord"), passes).join(got, keys, "left")
    return joined.select(
        "model", "ord", "pass", "sample_id", "source_document", "track", F.coalesce("outcome", F.lit("missing")).alias("outcome"), "empty", "cache_hit", "latency_seconds",
        F.coalesce("char_edits", "reference_chars").alias("char_edits"), "reference_chars", F.coalesce("word_edits", "reference_words").alias("word_edits"), "reference_words",
        F.coalesce("exact_match", F.lit(False)).alias("exact_match"),
    )


def _score(cer: Column, exact: Column, policy: Policy) -> Column:
    return 100.0 * (policy.character_weight * F.greatest(F.lit(0.0), 1.0 - cer) + policy.exact_weight * exact)


def pass_table(cell: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row for each track, model and pass."""
    measured = (F.col("outcome") == "success") & ~F.coalesce("cache_hit", F.lit(False)) & (F.col("latency_seconds") >= 0)
    when = lambda c: F.count(F.when(c, 1))
    out = cell.where("outcome <> 'unsupported'").groupBy("track", "model", "pass").agg(
        F.sum("char_edits").alias("character_edits"), F.sum("reference_chars").alias("reference_chars"),
        F.sum("word_edits").alias("word_edits"), F.sum("reference_words").alias("reference_words"),
        when(F.col("exact_match")).alias("exact_matches"), F.count(F.lit(1)).alias("eligible_sample_count"),
        when(F.col("outcome") == "success").alias("success_count"), when(F.col("outcome") == "failed").alias("failed_count"), when(F.col("outcome") == "missing").alias("missing_count"),
        when((F.col("outcome") == "success") & F.col("empty")).alias("empty_count"),
        when((F.col("outcome") == "success") & F.col("cache_hit")).alias("cache_hit_count"),
        F.percentile(F.when(measured, F.col("latency_seconds")), 0.5).alias("median_latency_seconds"),
    )
    cer, wer, exact = (F.try_divide(F.col(a).cast("double"), F.col(b)) for a, b in (("character_edits", "reference_chars"), ("word_edits", "reference_words"), ("exact_matches", "eligible_sample_count")))
    return out.withColumns({"corpus_cer": cer, "wer": wer, "exact_match_rate": exact}).withColumn("score", _score(F.col("corpus_cer"), F.col("exact_match_rate"), policy))


def model_table(cell: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row for each track and model: means over passes, sums of counts, latencies pooled over passes."""
    cell = checkpointed(cell)  # counts without texts: cheaper to keep than to measure predictions twice
    per_pass = pass_table(cell, policy)
    measured = (F.col("outcome") == "success") & ~F.coalesce("cache_hit", F.lit(False)) & (F.col("latency_seconds") >= 0)
    pooled = cell.where(measured).groupBy("track", "model").agg(F.percentile("latency_seconds", 0.5).alias("median_latency_seconds"), F.percentile("latency_seconds", 0.95).alias("p95_latency_seconds"))
    out = per_pass.groupBy("track", "model").agg(
        F.avg("score").alias("score"), F.stddev_samp("score").alias("score_stddev"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg("corpus_cer").alias("corpus_cer"), F.when(F.count("wer") == F.count(F.lit(1)), F.avg("wer")).alias("wer"), F.avg("exact_match_rate").alias("exact_match_rate"),
        F.sum("character_edits").alias("character_edits"), F.sum("reference_chars").alias("reference_chars"),
        F.sum("success_count").alias("success_count"), F.sum("failed_count").alias("failed_count"), F.sum("missing_count").alias("missing_count"),
        F.sum("eligible_sample_count").alias("expected_count"), F.count(F.when(F.col("missing_count") == 0, 1)).alias("terminal_pass_count"),
        F.every(F.col("missing_count") == 0).alias("terminal_complete"),
    )
    rates = {"failure_rate": F.try_divide((F.col("failed_count") + F.col("missing_count")).cast("double"), F.col("expected_count")), "sample_coverage": F.try_divide(F.col("success_count").cast("double"), F.col("expected_count"))}
    return out.withColumns(rates).join(pooled, ["track", "model"], "left")
