"""Roll-ups of a run's evidence: timing, usage, operations, equivalence, status by condition, examples and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.summary import number


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def timing_breakdown(results: DataFrame) -> DataFrame:
    """Median and count of the finite timing observations by model, metric, unit, source and boundaries."""
    x = results.where("status = 'success' and not cache_hit").select("model", F.explode("timing_observations").alias("o")).select("model", "o.*")
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    by = ["model", "metric_name", "unit", "source", "start_boundary", "end_boundary"]
    return x.where(value.isNotNull()).groupBy(*by).agg(F.percentile("value", 0.5).alias("median"), F.count(F.lit(1)).alias("observations"))


def usage_coverage(results: DataFrame) -> DataFrame:
    """By model, source and tokenization: requests, those with usage, and token sums, null where none was observed."""
    x = results.where("status = 'success' and not cache_hit").withColumn("usage_source", F.coalesce("usage_source", F.lit("unknown")))
    fields = {"input_tokens_observed": ("input_tokens", "prompt_tokens"), "output_tokens_observed": ("output_tokens", "completion_tokens"), "cached_input_tokens_observed": ("cached_input_tokens", "cached_tokens")}
    have = {c[0]: c[1] for c in results.select("usage.*").dtypes}
    tokens = lambda names: number(F.coalesce(*[F.col(f"usage.{n}").cast("double") for n in names if n in have], F.lit(None)))
    out = x.groupBy("model", F.col("usage_source").alias("source"), "tokenization").agg(
        F.count(F.lit(1)).alias("successful_requests"), _n(F.col("usage").isNotNull()).alias("requests_with_usage"), *[F.sum(tokens(names)).cast("long").alias(c) for c, names in fields.items()]
    )
    return out.withColumn("coverage", _ratio(F.col("requests_with_usage"), F.col("successful_requests")))


def operational_summary(attempts: DataFrame, invocations: DataFrame, results: DataFrame, priced: bool) -> DataFrame:
    """A row a pass: retryable failures, attempts that never finished, failures, wall seconds, throughput and cost status."""
    a = attempts.groupBy("pass").agg(_n(F.col("status") == "retryable_error").alias("retryable_failures"), _n(F.col("event_kind") == "request_started").alias("s"), _n(F.col("event_kind") == "request_finished").alias("f"))
    i = invocations.groupBy("pass").agg(F.sum("wall_seconds").alias("wall"), F.sum("spend_usd").alias("spend"), F.count(F.when(F.col("spend_usd").isNull(), 1)).alias("unknown"))
    r = results.groupBy("pass").agg(_n(F.col("status") == "error").alias("failed_predictions"), _n((F.col("status") == "success") & ~F.col("cache_hit")).alias("ok"))
    out = r.join(a, "pass", "left").join(i, "pass", "left")
    wall = F.when(F.col("wall") > 0, F.col("wall"))
    return out.select(
        "pass", F.coalesce("retryable_failures", F.lit(0)).alias("retryable_failures"), F.greatest(F.coalesce(F.col("s") - F.col("f"), F.lit(0)), F.lit(0)).alias("uncertain_attempts"), "failed_predictions",
        wall.alias("workload_wall_seconds"), _ratio(F.col("ok"), wall).alias("successful_samples_per_second"), (F.col("spend") if priced else F.lit(None).cast("double")).alias("estimated_cost_usd"),
        F.when(F.lit(priced) & (F.coalesce("unknown", F.lit(0)) == 0), "estimated").otherwise("unknown").alias("cost_status"),
    )


def equivalence_summary(outcomes: DataFrame, applicable: DataFrame, by: str) -> DataFrame:
    """Outcome counts and coverages of (by, status) against (by, applicable), the sample passes that could have one."""
    n = outcomes.groupBy(by).agg(*[_n(F.col("status") == s).alias(s) for s in ("equivalent", "different", "undetermined")], F.count(F.lit(1)).alias("attempted"))
    out = applicable.join(n, by, "left").na.fill(0, ["equivalent", "different", "undetermined", "attempted"])
    decided = F.col("equivalent") + F.col("different")
    return out.select(by, "equivalent", "different", "undetermined", "attempted", "applicable", _ratio(F.col("attempted"), F.col("applicable")).alias("attempted_coverage"), decided.alias("determinate"), _ratio(decided, F.col("attempted")).alias("determinate_coverage"))


def condition_status(runs: DataFrame, planned: DataFrame) -> DataFrame:
    """A row a condition: passes planned, started and completed, results expected, recorded and missing.

    runs: condition, status, expected, recorded. planned: condition, passes. Expected is null until a pass has started.
    """
    done = F.col("status").isin("complete", "complete_with_errors") & (F.col("expected") == F.col("recorded"))
    r = runs.groupBy("condition").agg(F.count(F.lit(1)).alias("started_passes"), _n(done).alias("completed_passes"), F.sum("expected").alias("e"), F.min("expected").alias("each"), F.sum("recorded").alias("recorded"))
    out = planned.join(r, "condition", "left").na.fill(0, ["started_passes", "completed_passes", "recorded"])
    expected = F.col("e") + (F.col("passes") - F.col("started_passes")) * F.col("each")
    return out.select("condition", F.col("passes").alias("planned_passes"), "started_passes", "completed_passes", expected.alias("expected_result_count"), F.col("recorded").alias("recorded_result_count"), (expected - F.col("recorded")).alias("missing_result_count"))


def experiment_status(conditions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: totals over conditions, null where any is, and what the whole is: complete, with errors, or the first of running, paused and interrupted."""
    known = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    c = conditions.agg(F.sum("planned_passes").alias("planned_passes"), F.sum("started_passes").alias("started_passes"), F.sum("completed_passes").alias("completed_passes"), known(F.col("expected_result_count")).alias("expected_result_count"), F.sum("recorded_result_count").alias("recorded_result_count"))
    r = runs.agg(F.sum("failed").alias("failed_count"), known(F.col("attempts")).alias("attempts"), *[F.max((F.col("status") == s).cast("int")).alias(s) for s in ("running", "paused", "interrupted")])
    active = F.coalesce(*[F.when(F.col(s) == 1, s) for s in ("running", "paused", "interrupted")], F.lit("incomplete"))
    status = F.when(F.col("completed_passes") < F.col("planned_passes"), active).when(F.col("failed_count") > 0, "complete_with_errors").otherwise("complete")
    return c.crossJoin(r).select("planned_passes", "started_passes", "completed_passes", "expected_result_count", "recorded_result_count", (F.col("expected_result_count") - F.col("recorded_result_count")).alias("missing_result_count"), "failed_count", "attempts", status.alias("run_status"))


def actual_model(results: DataFrame, by: list[str]) -> DataFrame:
    """The first model that a response named, in the order of samples."""
    return results.where("actual_model is not null").groupBy(*by).agg(F.min_by("actual_model", F.struct("sample_id", "pass")).alias("actual_model"))


def difficult_examples(scored: DataFrame, runs: list[str], each: int = 4, total: int = 12) -> DataFrame:
    """The worst results: at most ``each`` of a run and ``total`` of all, runs in their order."""
    worst = [F.col("cer").desc_nulls_first(), "model", "sample_id"]
    top = scored.withColumn("turn", F.row_number().over(Window.partitionBy(*runs).orderBy(*worst))).where(F.col("turn") <= each)
    return top.orderBy(*runs, "turn").limit(total)


def bounded_details(findings: DataFrame, first: int = 12) -> DataFrame:
    """By type, the first subjects as one text, and how many were left out."""
    ranked = findings.withColumn("turn", F.row_number().over(Window.partitionBy("type").orderBy("subject"))).where(F.col("turn") <= first)
    shown = ranked.groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "subject"))), lambda x: x["subject"]), "; ").alias("details"))
    counts = findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, "type").select("type", "n", "details", F.greatest(F.col("n") - first, F.lit(0)).alias("omitted"))


def ordered_groups(groups: DataFrame, field: str) -> DataFrame:
    """Groups numbered in their order: known ones first, by their names without regard to case."""
    value = F.coalesce(F.trim(field), F.lit(""))
    w = Window.orderBy((value == "") | (F.lower(value) == "unknown"), F.lower(value), value)
    return groups.select("*", F.row_number().over(w).alias("position"))


def comparison_order(rows: DataFrame) -> DataFrame:
    """Models numbered as a comparison lists them: ranked ones by rank, then the others by score."""
    w = Window.orderBy(F.col("rank").asc_nulls_last(), F.col("score").desc_nulls_last(), "model")
    return rows.select("*", F.row_number().over(w).alias("position"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Different values in the order of their first appearance."""
    return df.groupBy(value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first")


def sorted_sets(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """The different values of each field in a group, sorted. For fields of few values."""
    return df.groupBy(*by).agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in fields])


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when((tokens >= 0) & (seconds > 0), F.try_divide(tokens.cast("double"), seconds))


def retry_delay(retry: Column, after: Column) -> Column:
    """Seconds before a retry: what the server asked for, else a tenth for each retry, one at most."""
    return F.coalesce(number(after), F.least(retry * F.lit(0.1), F.lit(1.0)))


def load_durations(warmups: DataFrame, by: str = "model") -> DataFrame:
    """Warm-ups that worked, their load seconds from nanoseconds or, lacking those, seconds, and how many had any."""
    seconds = F.coalesce(number(F.col("load_duration").cast("double")) / 1e9, number(F.col("load_duration_seconds")))
    ok = F.col("status") == "success"
    return warmups.groupBy(by).agg(F.count(F.lit(1)).alias("warmups"), _n(~ok).alias("failed"), F.sum(F.when(ok, seconds)).alias("load_seconds"), F.count(F.when(ok, seconds)).alias("measured"))


def track_status(tracks: DataFrame, eligible: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """What became of each track and model: no_eligible_samples, not_run, unsupported, complete or incomplete."""
    planned = eligible.groupBy("track").agg(F.count(F.lit(1)).alias("eligible"))
    got = results.join(eligible, "sample_id").groupBy("track", "model").agg(_n(F.col("status") == "success").alias("scored"), _n(F.col("status") == "unsupported").alias("unsupported"), F.count(F.lit(1)).alias("recorded"))
    out = tracks.crossJoin(F.broadcast(models.select("model"))).join(planned, "track", "left").join(got, ["track", "model"], "left").na.fill(0, ["eligible", "scored", "unsupported", "recorded"])
    status = F.when(F.col("eligible") == 0, "no_eligible_samples").when(F.col("recorded") == 0, "not_run").when(F.col("unsupported") == F.col("eligible"), "unsupported").when(F.col("scored") == F.col("eligible"), "complete").otherwise("incomplete")
    return out.select("track", "model", "eligible", "scored", "recorded", status.alias("status"))


def all_pairs(scored: DataFrame, key: list[str]) -> DataFrame:
    """Every two models, by name, over what both have scored: who is right, and the mean difference of their rates."""
    cols = ["model", "exact_match", "cer"]
    left, right = (scored.select(*key, *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in ("left", "right"))
    both = left.join(right, key).where("left_model < right_model")
    l, r = F.col("left_exact_match"), F.col("right_exact_match")
    return both.groupBy("left_model", "right_model").agg(F.count(F.lit(1)).alias("n"), _n(l & r).alias("both_correct"), _n(l & ~r).alias("left_only"), _n(~l & r).alias("right_only"), _n(~l & ~r).alias("both_wrong"), F.avg(F.col("right_cer") - F.col("left_cer")).alias("mean_difference"))


def contrast(results: DataFrame, left: int, right: int) -> DataFrame:
    """How statuses of the same model and sample go from one pass to another; missing where there is none."""
    side = lambda p, name: results.where(F.col("pass") == p).select("model", "sample_id", F.col("status").alias(name))
    both = side(left, "left").join(side(right, "right"), ["model", "sample_id"], "full_outer")
    return both.groupBy("model", F.coalesce("left", F.lit("missing")).alias("left"), F.coalesce("right", F.lit("missing")).alias("right")).agg(F.count(F.lit(1)).alias("n"))
