"""Relations that must hold: each check is a DataFrame of violations, empty where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_results(samples: DataFrame, models: DataFrame, passes: DataFrame, results: DataFrame) -> DataFrame:
    """Planned work without a result: also what a resumed run has still to do."""
    planned = samples.select("sample_id").crossJoin(F.broadcast(models.select("model").crossJoin(passes)))
    return planned.join(results.select("sample_id", "model", "pass"), ["sample_id", "model", "pass"], "left_anti")


def orphans(metadata: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of metadata that no row has."""
    return metadata.select(key).distinct().join(rows.select(key), key, "left_anti")


def pairing(left: DataFrame, right: DataFrame, key: str, left_missing: str, right_missing: str) -> DataFrame:
    """Keys that only one side has, and which side lacks them."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), left_missing).otherwise(right_missing).alias("finding"))


def overridden(base: DataFrame, override: DataFrame, key: str, value: str) -> DataFrame:
    """Values of base, those of override before them where it has one that isn't blank."""
    o = override.select(key, F.nullif(F.trim(F.col(value)), F.lit("")).alias("o_"))
    return base.join(o, key, "left").select(key, F.coalesce("o_", value).alias(value), F.col("o_").isNotNull().alias("overridden"))


def violations(samples: DataFrame, results: DataFrame, planned_passes: int) -> DataFrame:
    """check and n: duplicate and unknown cells, passes out of plan, references that differ, duplicate samples."""
    cell = ["model", "pass", "sample_id"]
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    repeated = results.groupBy(*cell).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    unknown = results.join(samples.select("sample_id"), "sample_id", "left_anti")
    late = results.where((F.col("pass") > planned_passes) | (F.col("pass") < 1))
    differs = results.select("sample_id", "reference").join(samples.select("sample_id", F.col("reference").alias("frozen")), "sample_id").where(~F.col("reference").eqNullSafe(F.col("frozen")))
    twice = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = [(repeated, "duplicate_result"), (unknown, "unknown_sample"), (late, "pass_out_of_plan"), (differs, "reference_mismatch"), (twice, "duplicate_sample")]
    out = count(*parts[0])
    for p in parts[1:]:
        out = out.union(count(*p))
    return out


def same_roster(results: DataFrame) -> DataFrame:
    """Count and order-free checksum of each model's samples: equal rows mean equal rosters."""
    ids = results.select("model", "sample_id").distinct()
    return ids.groupBy("model").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.conv(F.substr(F.md5(F.col("sample_id").cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")).alias("checksum"))
