"""Readers of the evaluation's files, as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "model string, sample_id string, pass int, status string, prediction string, reference string, latency_seconds double, load_duration_seconds double, cache_hit boolean, truncated boolean, usage struct<input_tokens: bigint, output_tokens: bigint, input_tokens_details: struct<cached_tokens: bigint>>, error string"
PREDICTION = "sample_id string, prediction string, status string, latency_seconds double, usage struct<input_tokens: bigint, output_tokens: bigint>"


def repeated_keys(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """id and text of words whose second field is ok; comments start with #."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(fields.alias("f")).where("size(f) >= 3 and f[1] = 'ok'")
    return rows.select(F.col("f")[0].alias("id"), F.element_at("f", -1).alias("text"))


def forms(spark: SparkSession, path: str) -> DataFrame:
    """form, writer, line order, text and box of form XML; a last line that holds a signature is left out."""
    schema = "_id string, `_writer-id` string, `handwritten-part` struct<line: array<struct<_id: string, _text: string, word: array<struct<cmp: array<struct<_x: int, _y: int, _width: int, _height: int>>>>>>>"
    raw = spark.read.schema(schema).option("rowTag", "form").xml(path)
    lines = raw.select(F.col("_id").alias("form"), F.col("`_writer-id`").alias("writer_id"), F.posexplode("`handwritten-part`.line").alias("at", "line"), F.size("`handwritten-part`.line").alias("n"))
    parts = F.flatten(F.transform("line.word", lambda w: w["cmp"]))
    box = lambda f, e: F.array_max(F.transform(parts, e)) if f == "max" else F.array_min(F.transform(parts, e))
    out = lines.select("form", "writer_id", "at", "n", F.col("line._text").alias("text"), box("min", lambda c: c["_x"]).alias("left"), box("min", lambda c: c["_y"]).alias("top"), box("max", lambda c: c["_x"] + c["_width"]).alias("right"), box("max", lambda c: c["_y"] + c["_height"]).alias("bottom"))
    return out.where(~((F.col("at") == F.col("n") - 1) & F.col("text").contains("Name:"))).drop("n")


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each text file: its name without the suffix, and its text."""
    return spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("id"), F.col("value").alias("text"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest and size of PNG images, read from their headers."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    number = lambda at: F.conv(F.hex(F.substr("content", F.lit(at), F.lit(4))), 16, 10).cast("int")
    return raw.select("path", F.sha2("content", 256).alias("digest"), number(17).alias("width"), number(21).alias("height"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, title and visible text of HTML: scripts, styles and comments go with what they hold, tags go alone."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))
