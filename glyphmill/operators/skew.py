"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes whatever the size of the table, and the most keys that can be broadcast.
LIGHT, HEAVY_KEYS = 10_000, 1_000


def skewed_join(left: DataFrame, right: DataFrame, key: list[str], total: int) -> DataFrame:
    """left joined to right by ``key``, without right's column ``n``.

    right has one row a key, and in ``n`` at least the number of left's rows with it; ``total`` bounds their sum.
    Keys over ``total / HEAVY_KEYS`` rows are at most HEAVY_KEYS, so their rows of right are broadcast and left's stay
    where they are; the others are shuffled, none of them with more than that share. right is read up to four times.
    """
    bound = max(LIGHT, total // HEAVY_KEYS)
    plain = right.drop("n")
    if total <= bound or not right.where(F.col("n") > bound).limit(1).count():
        return left.join(plain, key)
    heavy = F.broadcast(right.where(F.col("n") > bound).drop("n"))
    light = left.join(F.broadcast(right.where(F.col("n") > bound).select(*key)), key, "left_anti").join(right.where(F.col("n") <= bound).drop("n"), key)
    return left.join(heavy, key).unionByName(light)
