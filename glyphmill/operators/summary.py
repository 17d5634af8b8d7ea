"""Summaries by model, by track and model, and by subgroup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators.scoring import measured


def number(value: Column) -> Column:
    """Finite and not negative, else null."""
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), value)


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


def with_measures(results: DataFrame) -> DataFrame:
    """results with ``m``, the measures of those that succeeded, null for the others. See ``scoring.scored`` on how they should lie."""
    ok = (F.col("status") == "success") & F.col("prediction").isNotNull()
    return measured(results, t.score(F.col("prediction"), F.when(ok, F.col("reference")), raw=False))


def _common(measured: DataFrame, by: list[str]) -> DataFrame:
    live = ~F.col("cache_hit")
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"), _n(F.col("m").isNotNull()).alias("scored_sample_count"),
        _n(F.col("status") == "success").alias("success_count"), _n(F.col("status") != "success").alias("failed_count"),
        _n((F.col("status") == "success") & ~t.has_text(F.coalesce("prediction", F.lit("")))).alias("empty_count"),
        _n(F.col("truncated")).alias("truncated_count"), _n(F.col("cache_hit")).alias("cache_hit_count"),
        F.sum("m.char_edits").alias("char_edits"), F.sum("m.reference_chars").alias("reference_chars"),
        F.sum("m.word_edits").alias("word_edits"), F.sum("m.reference_words").alias("reference_words"),
        F.avg("m.cer").alias("mean_sample_cer"), F.avg("m.wer").alias("mean_sample_wer"), _n(F.col("m.exact_match")).alias("exact_matches"),
        F.sum(F.when(live, number(F.col("latency_seconds")))).alias("total_latency_seconds"), F.count(F.when(live, number(F.col("latency_seconds")))).alias("measured_latency_sample_count"),
        F.percentile(F.when(live, number(F.col("latency_seconds"))), 0.5).alias("median_latency_seconds"), F.percentile(F.when(live, number(F.col("latency_seconds"))), 0.95).alias("p95_latency_seconds"),
        F.sum(F.when(live, number(F.col("load_duration_seconds")))).alias("load_duration_seconds"), F.count(F.when(live, number(F.col("load_duration_seconds")))).alias("load_event_count"),
        F.countDistinct("sample_id").alias("distinct_samples"),
    ).withColumns({"cer": _ratio("char_edits", "reference_chars"), "wer": _ratio("word_edits", "reference_words"), "exact_match_rate": _ratio("exact_matches", "scored_sample_count")})


def summarize(results: DataFrame, expected: DataFrame, models: DataFrame) -> DataFrame:
    """Corpus rates per model, ranked where every expected sample was done once without a failure."""
    out = models.select("model").join(_common(with_measures(results), ["model"]), "model", "full_outer")
    n = expected.agg(F.count(F.lit(1)).alias("expected_sample_count"))
    out = out.crossJoin(F.broadcast(n))
    have = results.select("model", "sample_id").distinct().join(expected.select("sample_id"), "sample_id").groupBy("model").agg(F.count(F.lit(1)).alias("have"))  # by sample alone: results stay where they lie
    lacking = F.col("expected_sample_count") - F.coalesce("have", F.lit(0))
    missing = models.select("model").join(have, "model", "left").crossJoin(F.broadcast(n)).groupBy("model").agg(F.sum(lacking).alias("missing_sample_count"))
    out = out.join(missing, "model", "left").na.fill(0, ["missing_sample_count", "sample_count", "failed_count"])
    out = out.withColumn("complete", (F.col("failed_count") == 0) & (F.col("missing_sample_count") == 0) & (F.col("sample_count") == F.col("expected_sample_count")))
    out = out.withColumns({"failure_rate": _ratio("failed_count", "sample_count"), "mean_latency_seconds": _ratio("total_latency_seconds", "measured_latency_sample_count"), "samples_per_minute": F.try_divide(60.0 * F.col("measured_latency_sample_count"), F.col("total_latency_seconds"))})
    order = Window.partitionBy("complete").orderBy(F.col("cer").asc_nulls_last(), F.col("wer").asc_nulls_last(), "model")
    return out.withColumn("rank", F.when(F.col("complete"), F.row_number().over(order)))


def track_report(samples: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each content type and model, with a status and a rank among the complete."""
    eligible = samples.groupBy("content_type").agg(F.count(F.lit(1)).alias("eligible_sample_count"))
    live, fine = ~F.col("cache_hit"), F.col("m").isNotNull()
    got = with_measures(results).join(samples.select("sample_id"), "sample_id", "left_semi")
    stats = got.groupBy("content_type", "model").agg(
        _n(fine).alias("scored"), _n(F.col("status") == "unsupported").alias("unsupported"), _n(~fine & (F.col("status") != "unsupported")).alias("failed"),
        _n(fine & F.col("cache_hit")).alias("cached_scored"), F.sum(F.when(live, number(F.col("latency_seconds")))).alias("total_latency_seconds"),
        F.sum("m.char_edits").alias("char_edits"), F.sum("m.reference_chars").alias("reference_chars"), F.sum("m.word_edits").alias("word_edits"), F.sum("m.reference_words").alias("reference_words"),
    )
    out = eligible.crossJoin(F.broadcast(models.select("model"))).join(stats, ["content_type", "model"], "left").na.fill(0, ["scored", "unsupported", "failed", "cached_scored"])
    out = out.withColumn("missing", F.col("eligible_sample_count") - F.col("scored") - F.col("failed") - F.col("unsupported"))
    status = F.when(F.col("unsupported") == F.col("eligible_sample_count"), "unsupported").when(F.col("scored") == F.col("eligible_sample_count"), "complete").otherwise("incomplete")
    out = out.withColumns({"status": status, "cer": _ratio("char_edits", "reference_chars"), "wer": _ratio("word_edits", "reference_words"), "failure_rate": F.try_divide(F.col("failed").cast("double"), F.col("scored") + F.col("failed")), "sample_coverage": _ratio("scored", "eligible_sample_count"), "samples_per_minute": F.try_divide(60.0 * (F.col("scored") - F.col("cached_scored")), F.col("total_latency_seconds"))})
    order = Window.partitionBy("content_type", "status").orderBy(F.col("cer").asc_nulls_last(), F.col("wer").asc_nulls_last(), "model")
    return out.withColumn("rank", F.when((F.col("status") == "complete") & F.col("cer").isNotNull(), F.row_number().over(order)))


def subgroups(results: DataFrame, samples: DataFrame, fields: list[str]) -> DataFrame:
    """One pass for all fields: a row for each field, value and model; unknown values are a group.

    Fields are joined before texts are measured, where the results lie: a table of fields in each task, nothing sorted, nothing sent after measuring.
    """
    known = samples.select("sample_id", *[F.coalesce(F.col(f).cast("string"), F.lit("Unknown")).alias(f) for f in fields]).hint("shuffle_hash")
    joined = with_measures(results.join(known, "sample_id"))
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")
    out = joined.select("model", "status", "m", "source_document", facets).groupBy("x.field", "x.value", "model").agg(
        F.count(F.lit(1)).alias("result_count"), _n(F.col("m").isNotNull()).alias("scored_count"), F.countDistinct("source_document").alias("document_count"),
        F.sum("m.char_edits").alias("char_edits"), F.sum("m.reference_chars").alias("reference_chars"), _n(F.col("m.exact_match")).alias("exact_matches"),
    )
    return out.withColumn("cer", _ratio("char_edits", "reference_chars"))
