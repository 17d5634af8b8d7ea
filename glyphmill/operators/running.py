"""Sums and group values by windows, over groups of which some may be as large as the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.skew import HEAVY_KEYS
from glyphmill.plans.cut import checkpointed

#: Rows of a group that a window takes whatever the size of the table.
SMALL = 100


def _heavy(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame | None:
    """Groups over a thousandth of the rows, so at most HEAVY_KEYS of them, with their ``values``; None if there are none."""
    bound = max(SMALL, df.select(*by).count() // HEAVY_KEYS)
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_"), *[v.alias(n) for n, v in values.items()])
    found = checkpointed(found.where(F.col("rows_") > bound).drop("rows_"))
    return found if found.limit(1).count() else None


def _by(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """left joined to the few rows of right, nulls being equal; right's keys are left out."""
    named = right.select(*[F.col(c).alias(f"{c}_k") if c in by else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in by:
        on &= left[c].eqNullSafe(named[f"{c}_k"])
    return left.join(F.broadcast(named), on, how).drop(*[f"{c}_k" for c in by])


def group_values(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """df with aggregates of each row's whole group.

    A window gives them, but for heavy groups, whose values are broadcast: their rows stay where they are. df is
    read up to four times.
    """
    heavy = _heavy(df, by, values)
    window = Window.partitionBy(*by)
    light = df if heavy is None else _by(df, heavy.select(*by), by, "left_anti")
    out = light.select("*", *[v.over(window).alias(n) for n, v in values.items()])
    return out if heavy is None else out.unionByName(_by(df, heavy, by, "inner"))


def running_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """by, order and the sums of ``values`` up to each row, in a group's order.

    A window adds up each group. Heavy groups are dealt out in ranges of (by, order) instead: a task adds up its
    own, after the totals of the ranges before it. df is read up to four times.
    """
    rows = df.select(*by, *order, *[v.alias(f"{n}_v") for n, v in values.items()])
    heavy = _heavy(rows, by, {})
    light = rows if heavy is None else _by(rows, heavy, by, "left_anti")
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = light.select(*by, *order, *[F.sum(f"{n}_v").over(running).alias(n) for n in values])
    return out if heavy is None else out.unionByName(_in_ranges(_by(rows, heavy, by, "left_semi"), by, order, list(values)))


def _in_ranges(rows: DataFrame, by: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Of the groups in a range only the first can have begun before it, so what is broadcast is a row for each range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    rows = checkpointed(rows.repartitionByRange(parts, *by, *order).withColumn("range_", F.spark_partition_id()))
    totals = rows.groupBy(*by, "range_").agg(*[F.sum(f"{n}_v").alias(f"{n}_t") for n in names])
    earlier = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "range_", *[F.sum(f"{n}_t").over(earlier).alias(f"{n}_b") for n in names], F.count(F.lit(1)).over(earlier).alias("before_"))
    offsets = offsets.where("before_ > 0").drop("before_")
    own = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select(*by, *order, "range_", *[F.sum(f"{n}_v").over(own).alias(f"{n}_s") for n in names])
    joined = _by(summed, offsets, [*by, "range_"], "left")
    return joined.select(*by, *order, *[F.coalesce(F.col(f"{n}_s") + F.col(f"{n}_b"), F.col(f"{n}_s"), F.col(f"{n}_b")).alias(n) for n in names])
