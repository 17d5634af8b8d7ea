"""Exact percentiles by selection from a counted histogram.

Equal values of a group are counted first, where they lie; running counts over the different ones say which hold the
ranks on both sides of a percentile. No task keeps a group's values, and a group with a large share of them is spread
over ranges (``running``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.running import running_sums
from glyphmill.plans.cut import checkpointed


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by, n and each percentile of ``at``, between the two nearest values as the built-in percentile has it.

    Null values don't count; a group without any others has no row.
    """
    counted = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    upto = running_sums(counted, by, ["v", "c"], {"upto": F.col("c")})
    total = counted.groupBy(*by).agg(F.sum("c").alias("n"))
    joined = upto.join(total, by) if by else upto.crossJoin(F.broadcast(total))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in at.items()}  # from 0
    holds = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    ends = [F.max(F.when(holds(end(p)), F.col("v"))).alias(f"{name}_{side}") for name, p in place.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    found = joined.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    part = {name: p - F.floor(p) for name, p in place.items()}
    mixed = [F.when(part[name] == 0, F.col(f"{name}_low")).otherwise((1 - part[name]) * F.col(f"{name}_low") + part[name] * F.col(f"{name}_high")).alias(name) for name in at]
    return found.select(*by, "n", *mixed)
