"""Annotated tasks: critical expressions and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as t


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs, without overlaps."""
    return F.try_divide(F.char_length(text) - F.char_length(F.replace(text, part, F.lit(""))), F.char_length(part)).cast("long")


def critical_expressions(df: DataFrame) -> DataFrame:
    """Of (sample_id, model, prediction, reference, expressions): how many occur as often as in the reference."""
    p, r = t.normalize_text(F.col("prediction")), t.normalize_text(F.col("reference"))
    e = F.transform("expressions", lambda x: t.normalize_text(x))
    right = F.filter(e, lambda x: occurrences(p, x) == occurrences(r, x))
    absent = F.exists(e, lambda x: (x == "") | (occurrences(r, x) < 1))
    status = F.when(F.col("expressions").isNull() | (F.size("expressions") == 0), "not_annotated").when(absent, "error").otherwise("scored")
    out = df.select("sample_id", "model", status.alias("status"), F.size(right).cast("long").alias("passed"), F.size(e).cast("long").alias("total"))
    scored = F.col("status") == "scored"
    return out.select("sample_id", "model", "status", F.when(scored, F.col("passed")).alias("passed"), F.when(scored, F.col("total")).alias("total"))


def reading_order(df: DataFrame) -> DataFrame:
    """Of (sample_id, model, prediction, reference, earlier, later): whether both occur once and in order."""
    p, r, a, b = (t.normalize_text(F.col(c)) for c in ("prediction", "reference", "earlier", "later"))
    fine = lambda x: (occurrences(x, a) == 1) & (occurrences(x, b) == 1) & (F.call_function("locate", a, x) < F.call_function("locate", b, x))
    status = F.when(F.col("earlier").isNull() | F.col("later").isNull(), "not_annotated").when(fine(r), "scored").otherwise("error")
    return df.select("sample_id", "model", status.alias("status"), F.when(status == "scored", fine(p)).alias("passed"))


def rollup(scored: DataFrame) -> DataFrame:
    """Status counts, coverage and pooled accuracy by model."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    out = scored.groupBy("model").agg(n("scored"), n("error"), n("not_annotated"), F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return out.withColumns({"coverage": F.try_divide(F.col("scored").cast("double"), F.col("n")), "accuracy": F.try_divide(F.col("passed").cast("double"), F.col("total"))})
