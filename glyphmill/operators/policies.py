"""Rules about models, requests and settings, as columns and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.running import running_sums


# Names of equation tasks, and models whose usual checkpoints read lines of prose only.
EQUATION_TASKS = ("equation", "math", "mathematics", "latex", "formula")
PROSE_ONLY = "trocr"


def supported(capabilities: DataFrame, tracks: DataFrame) -> DataFrame:
    """model, track and why the model doesn't do it: an allow-list, a deny-list or a flag of (model, allowed, denied, equations).

    Any name of equation tasks in a list stands for all of them. A model that says nothing of equations may be known
    by its name to read prose only.
    """
    pairs = F.broadcast(capabilities).crossJoin(F.broadcast(tracks))
    equation = F.col("track") == "equation"

    def named(c: str) -> Column:
        names = F.transform(F.col(c), lambda x: F.lower(F.trim(x)))
        return F.coalesce(F.array_contains(names, F.col("track")) | (equation & F.arrays_overlap(names, F.array(*map(F.lit, EQUATION_TASKS)))), F.lit(False))

    barred = (F.col("allowed").isNotNull() & ~named("allowed")) | named("denied") | (equation & ~F.coalesce("equations", F.lit(True)))
    silent = (F.coalesce(F.size("allowed"), F.lit(0)) < 1) & (F.coalesce(F.size("denied"), F.lit(0)) < 1) & F.col("equations").isNull()
    by_name = equation & F.lower("model").contains(PROSE_ONLY) & silent
    return pairs.select("model", "track", F.when(barred, "model_does_not_support_task").when(by_name, "standard_trocr_is_prose_only").alias("reason"))


def provider(selector: Column, default: str = "local") -> Column:
    """Struct of provider and model of ``provider:model``; a bare name has the default provider."""
    bare = ~selector.contains(":")
    return F.struct(F.when(bare, F.lit(default)).otherwise(F.lower(F.substring_index(selector, ":", 1))).alias("provider"), F.when(bare, selector).otherwise(F.regexp_replace(selector, "^[^:]*:", "")).alias("model"))


def retry(status: Column, retry_after: Column) -> Column:
    """retry, wait or permanent, by an HTTP status; no status is a lost connection."""
    return F.when(status.isNull() | status.isin(500, 502, 503, 504), "retry").when(status == 429, F.when(retry_after.isNotNull(), "wait").otherwise("permanent")).otherwise("permanent")


def settings(general: DataFrame, special: DataFrame) -> DataFrame:
    """(model, options) where a condition's options go before the general ones; models it doesn't name keep theirs."""
    joined = general.join(special.select("model", F.col("options").alias("own")), "model", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.coalesce("own", none)
    return joined.select("model", F.map_concat(F.map_filter("options", lambda k, _: ~F.map_contains_key(own, k)), own).alias("options"))


def large_enough(df: DataFrame, width: str, height: str, least: int) -> DataFrame:
    """Every row with its area and whether it is kept: the rest is the exclusion's audit."""
    area = F.col(width).cast("long") * F.col(height).cast("long")
    return df.withColumn("pixels", area).withColumn("kept", F.coalesce(area >= least, F.lit(False)))


def cache_key(df: DataFrame, parts: list[str], repeated: str) -> DataFrame:
    """Digest of the parts that make a response what it is, or why it can't be kept."""
    lacking = F.coalesce(*[F.when(F.col(p).isNull(), F.lit(f"missing_{p}")) for p in parts])
    why = F.when(F.col(repeated), "repeated_measurement").otherwise(lacking)
    return df.select("*", why.alias("bypass"), F.when(why.isNull(), F.sha2(F.concat_ws("|", *parts), 256)).alias("key"))


def unique_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """label, label-2, label-3 where a label comes again."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.select(order, F.when(n == 1, F.col(label)).otherwise(F.concat_ws("-", label, n)).alias("unique_label"))


def progress(results: DataFrame, planned: int) -> DataFrame:
    """Running seconds and what is left of each model's plan at the pace so far."""
    sums = running_sums(results, ["model"], ["pass", "sample_id"], {"done": F.lit(1).cast("long"), "seconds": F.col("latency_seconds")})
    return sums.withColumn("eta_seconds", F.col("seconds") / F.col("done") * F.greatest(F.lit(planned) - F.col("done"), F.lit(0)))


def preview(samples: DataFrame) -> DataFrame:
    """How many samples have each verification status."""
    return samples.groupBy(F.coalesce("verification_status", F.lit("unknown")).alias("verification_status")).agg(F.count(F.lit(1)).alias("n"))
