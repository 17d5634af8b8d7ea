"""Checks of snapshots and texts for sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_rows(frozen: DataFrame) -> DataFrame:
    """Rows of a snapshot whose hash isn't that of their values."""
    values = sorted(c for c in frozen.columns if c != "row_hash")
    return frozen.where(F.col("row_hash") != F.sha2(F.to_json(F.struct(*values)), 256))


def overflow_chunks(df: DataFrame, key: str, text: str, size: int = 32_000) -> DataFrame:
    """Texts too long for a sheet's cell, in numbered pieces."""
    long = df.where(F.char_length(text) > size)
    at = F.posexplode(F.sequence(F.lit(1), F.char_length(text), F.lit(size))).alias("piece", "at")
    return long.select(key, F.col(text).alias("t"), at).select(key, "piece", F.substr("t", F.col("at"), F.lit(size)).alias("text"))
