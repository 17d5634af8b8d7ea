"""Append-only logs of JSON lines, read in byte ranges by many tasks, with what the end of each file says.

A line is committed once its newline is there. Only newlines split lines, so a file's lines and a newline each have as
many bytes as the file, or one more if its last line lacks its own; that takes one sum a file, whatever its blocks. A
line that isn't a record of the schema, blank ones included, is corrupt, unless it is the last of its file and without
a newline: then it is torn, which is what an interrupted append leaves.

A file that grows while it is read shows a last line that reaches beyond the size it was listed with; that line is not
committed yet. Compressed files have other sizes than their lines and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans.cut import checkpointed
from glyphmill.sources.strict import sound

#: Files with an unterminated end that are broadcast; more are joined by file and place.
FEW = 10_000


def lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, size, place, value, record and whole of each line. Places order a file's lines: its blocks, then lines as read."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"),
        "value",
    )
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.withColumn("record", record)
    return rows.withColumn("whole", F.col("record").isNotNull() & F.col("record._corrupt_record").isNull() & (F.trim("value") != ""))


def ends(found: DataFrame) -> DataFrame:
    """A row for each file: end (committed, unterminated or torn), place and value of its last line, lines, corrupt (how
    many lines are) and first_corrupt."""
    per_file = found.groupBy("file").agg(
        F.max("size").alias("size"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max(F.struct("place", "whole", "value")).alias("last"),
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(~F.col("whole"), 1)).alias("bad"),
        F.min(F.when(~F.col("whole"), F.struct("place", "value"))).alias("first_bad"),
    )
    end = F.when(F.col("bytes") == F.col("size"), "committed").when(F.col("bytes") > F.col("size"), F.when(F.col("last.whole"), "unterminated").otherwise("torn")).otherwise(F.raise_error(F.concat(F.lit("not a plain text file: "), "file")))
    out = per_file.withColumn("end", end).withColumn("corrupt", F.col("bad") - F.when(F.col("end") == "torn", 1).otherwise(0))
    return out.select("file", "end", F.col("last.place").alias("place"), F.col("last.value").alias("value"), "lines", "corrupt", F.when(F.col("corrupt") > 0, F.col("first_bad.value")).alias("first_corrupt"))


def states(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, value, state (whole, torn or corrupt) and record of every line."""
    found = lines(spark, path, schema)
    torn = _marked(found, ends(found).where("end = 'torn'"), "left")
    return torn.select("file", "value", F.when(F.col("whole"), "whole").when(F.col("marked"), "torn").otherwise("corrupt").alias("state"), "record")


def _marked(found: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """found joined to the last lines of some files, of which there is one a file."""
    marks = checkpointed(some.select("file", "place", F.lit(True).alias("marked")))
    return found.join(F.broadcast(marks) if marks.count() <= FEW else marks, ["file", "place"], how)


def _sound_ends(found: DataFrame) -> DataFrame:
    known = checkpointed(ends(found))
    return sound(known, known.where("corrupt > 0").select("file", "first_corrupt"), "corrupt line")


def repaired(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """All records of a log that no one writes to, and file and value of the torn ends, to be set aside. A last line
    that is whole counts without its newline; any corrupt line is an error."""
    found = lines(spark, path, schema)
    known = _sound_ends(found)
    return found.where("whole").select("record.*").drop("_corrupt_record"), known.where("end = 'torn'").select("file", "value")


def live(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The committed records of a log that may be written to: nothing after a file's last newline. Any corrupt line
    before it is an error."""
    found = lines(spark, path, schema)
    open_ends = _sound_ends(found).where("end <> 'committed'")
    return _marked(found, open_ends, "left_anti").select("record.*").drop("_corrupt_record")


def repair(spark: SparkSession, path: str | list[str], schema: str, to: str, aside: str) -> None:
    """Writes a log's records as JSON lines to a new folder, and its torn ends to another, so that nothing is lost."""
    records, torn = repaired(spark, path, schema)
    torn.write.json(aside)
    records.write.json(to)
