"""Leaderboards: anchored accuracy bands, order within them, winners.

A band is anchored at the highest score that no band has yet, and holds all scores within the margin of it. This
depends on what came before, so a track's scores, one for each model, are folded in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy_bands(models: DataFrame, margin: float) -> DataFrame:
    """Models with a score, their band and its anchor, by track."""
    anchors = models.where("score is not null").groupBy("track").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores"))
    start = F.array().cast("array<double>")
    fold = F.aggregate("scores", start, lambda a, s: F.when((F.size(a) == 0) | (F.element_at(a, -1) - s > margin), F.array_append(a, s)).otherwise(a))
    anchored = anchors.select("track", F.posexplode(fold).alias("at", "band_anchor_score"))
    reach = (models["track"] == anchored["track"]) & (models["score"] <= anchored["band_anchor_score"]) & (anchored["band_anchor_score"] - models["score"] <= margin)
    found = models.join(anchored, reach).select(models["*"], (F.col("at") + 1).alias("band"), "band_anchor_score")
    first = Window.partitionBy("track", "model").orderBy("band")
    return found.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")


def ranked(models: DataFrame, margin: float) -> DataFrame:
    """Bands with positions by latency, score, name; none in a band where a latency is unknown, yet later ranks move on."""
    band, order = Window.partitionBy("track", "band"), [F.col("median_latency_seconds"), F.col("score").desc(), F.col("model")]
    before = Window.partitionBy("track").orderBy("band").rangeBetween(Window.unboundedPreceding, -1)
    out = accuracy_bands(models, margin).withColumn("timing_complete", F.every(F.col("median_latency_seconds").isNotNull()).over(band))
    out = out.withColumn("within_band_position", F.when(F.col("timing_complete"), F.row_number().over(band.orderBy(*order))))
    return out.withColumn("rank", F.col("within_band_position") + F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)))


def winners(ranking: DataFrame, finalizable: bool = True, tracks: DataFrame | None = None) -> DataFrame:
    """A row for each track, also those of ``tracks`` (column track) where nothing was scored: the winner, or why there is none."""
    top = F.col("band") == 1
    out = ranking.groupBy("track").agg(
        F.every("terminal_complete").alias("complete"),
        F.every(F.when(top, F.col("timing_complete"))).alias("top_timed"),
        F.every("timing_complete").alias("timed"),
        F.max(F.when(F.col("rank") == 1, F.col("model"))).alias("first"),
    )
    reason = F.when(~F.col("complete") | F.lit(not finalizable), "incomplete_evaluation").when(~F.col("top_timed"), "missing_top_band_latency")
    status = F.when(reason == "incomplete_evaluation", "incomplete").when(reason.isNotNull(), reason).when(F.col("timed"), "available").otherwise("partial_missing_latency")
    known = out.select("track", F.when(reason.isNull(), F.col("first")).alias("winner"), reason.alias("winner_reason"), status.alias("status"))
    if tracks is None:
        return known
    none = F.lit("no_scored_models")
    every = tracks.select("track").distinct().join(known.withColumn("known", F.lit(True)), "track", "left")
    return every.select("track", "winner", F.when(F.col("known").isNull(), none).otherwise(F.col("winner_reason")).alias("winner_reason"), F.coalesce("status", none).alias("status"))


def raw_accuracy_rank(models: DataFrame) -> DataFrame:
    """Rank by score, then name, within a track."""
    order = Window.partitionBy("track").orderBy(F.col("score").desc_nulls_last(), "model")
    return models.where("score is not null").withColumn("raw_accuracy_rank", F.row_number().over(order))
