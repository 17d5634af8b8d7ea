"""Usage, cost, timing and throughput. What isn't known stays unknown: it is never taken for zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running_sums


@dataclass(frozen=True)
class Rates:
    """US dollars for a million tokens."""

    input: float
    output: float
    cached: float | None = None


def strict_cost(rates: Rates) -> Column:
    """Cost of a result, null unless its usage is whole and consistent."""
    cached = F.coalesce("cached_tokens", F.lit(0))
    fine = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull() & (cached <= F.col("input_tokens"))
    if rates.cached is None:
        fine = fine & (cached == 0)
    return F.when(fine, ((F.col("input_tokens") - cached) * rates.input + cached * (rates.cached or 0.0) + F.col("output_tokens") * rates.output) / 1e6)


def meter_cost(rates: Rates) -> Column:
    """Cost for the running ledger: the cached rate defaults to the input rate, uncached tokens are at least none."""
    cached = F.coalesce("cached_tokens", F.lit(0))
    return (F.greatest(F.col("input_tokens") - cached, F.lit(0)) * rates.input + cached * (rates.input if rates.cached is None else rates.cached) + F.col("output_tokens") * rates.output) / 1e6


def unit_cost(results: DataFrame, rates: Rates) -> DataFrame:
    """Mean cost of a request by model; null if one that should be priced isn't."""
    live = results.where(~F.col("cache_hit") & (F.col("status") != "unsupported")).withColumn("cost", strict_cost(rates))
    out = live.groupBy("model").agg(F.count("cost").alias("usage_record_count"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unpriced_count"), F.sum("cost").alias("observed"))
    whole = (F.col("unpriced_count") == 0) & (F.col("usage_record_count") > 0)
    return out.select("model", "usage_record_count", "unpriced_count", F.when(whole, F.col("observed")).alias("observed_cost"), F.when(whole, F.col("observed") / F.col("usage_record_count")).alias("unit_cost"))


def scenarios(costs: DataFrame, volumes: list[int], upfront: float, local_unit: float) -> DataFrame:
    """Local against metered totals at each volume, with the volume from which local is cheaper."""
    v = costs.sparkSession.createDataFrame([(x,) for x in sorted(set(volumes))], "sample_volume long")
    out = costs.crossJoin(F.broadcast(v))
    local, api = F.lit(upfront) + F.lit(local_unit) * F.col("sample_volume"), F.col("unit_cost") * F.col("sample_volume")
    even = F.when(F.col("unit_cost") > local_unit, F.greatest(F.lit(0), F.ceil(F.lit(upfront) / (F.col("unit_cost") - local_unit))))
    status = F.when(F.col("unit_cost").isNull(), "unknown_missing_cost_inputs").when(F.col("unit_cost") > local_unit, "available").otherwise("local_variable_cost_not_lower")
    known = F.col("unit_cost").isNotNull()
    return out.select("model", "sample_volume", F.when(known, local).alias("local_total"), api.alias("api_total"), F.when(known, local - api).alias("local_minus_api"), status.alias("break_even_status"), even.cast("long").alias("break_even_samples"))


def spend_ledger(results: DataFrame, rates: Rates, budget: float) -> DataFrame:
    """Running spend of each model in order of pass and sample; blocked once it is unknown or over the budget."""
    priced = results.where("status <> 'unsupported'").withColumn("cost", meter_cost(rates))
    sums = running_sums(priced, ["model"], ["pass", "sample_id"], {"spent": F.coalesce("cost", F.lit(0.0)), "unknown": F.when(F.col("cost").isNull(), 1).otherwise(0).cast("long")})
    return sums.withColumn("blocked", (F.col("unknown") > 0) | (F.col("spent") > budget))


def usage_summary(results: DataFrame) -> DataFrame:
    """Token sums by model, null if never observed, with coverage."""
    out = results.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), 1)).alias("with_usage"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
    return out.withColumn("coverage", F.try_divide(F.col("with_usage").cast("double"), F.col("requests")))


def timing_rollup(observations: DataFrame) -> DataFrame:
    """Median and p95 by metric, unit, source and why a value is missing."""
    return observations.groupBy("metric_name", "unit", "source", "unavailable_reason").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("measured"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"))


def throughput(invocations: DataFrame) -> DataFrame:
    """Samples a minute by run; unknown if one of its invocations has no duration."""
    out = invocations.groupBy("run").agg(F.count(F.lit(1)).alias("invocations"), F.count("wall_seconds").alias("timed"), F.sum("wall_seconds").alias("wall"), F.max_by("terminal", "ord").alias("terminal"))
    known = F.col("timed") == F.col("invocations")
    return out.select("run", "invocations", "terminal", F.when(known, F.col("wall")).alias("wall_seconds"), F.when(known, F.try_divide(60.0 * F.col("terminal"), F.col("wall"))).alias("samples_per_minute"))


def run_status(results: DataFrame, models: DataFrame, samples: DataFrame) -> DataFrame:
    """Outcome counts of each model and pass against what was planned."""
    n = samples.agg(F.count(F.lit(1)).alias("planned"))
    by = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = results.groupBy("model", "pass").agg(F.count(F.lit(1)).alias("present"), by("success"), by("error"), by("unsupported"))
    return out.join(models.select("model"), "model").crossJoin(F.broadcast(n)).withColumns({"missing": F.col("planned") - F.col("present"), "coverage": F.try_divide(F.col("present").cast("double"), F.col("planned"))})
