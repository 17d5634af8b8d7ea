"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans.cut import checkpointed

__all__ = ["DOCUMENT_COLUMNS", "GAP", "checkpointed", "let", "table"]

#: Columns of the documents table.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: What separates words: space and the ASCII controls tab to carriage return.
GAP = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row: a bound lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
