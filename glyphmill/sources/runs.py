"""Snapshots and runs: frozen rosters with fingerprints, results checked against them, plans of several runs, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import identity
from glyphmill.sources import export, log, strict
from glyphmill.sources.sinks import broken_rows

VERSION = "v1"


def row_hash(columns: list[str]) -> Column:
    """Digest of a row's values as JSON, by column name; where its files lie doesn't count."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if not c.endswith("_path"))), {"ignoreNullFields": "false"}).cast("binary"), 256)


def fingerprint(samples: DataFrame) -> DataFrame:
    """One row: n, and a digest that doesn't depend on the order of rows. Repeated rows count."""
    number = F.conv(F.substr("h", F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    sums = samples.select(row_hash(samples.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("s"), F.bit_xor(F.xxhash64("h")).alias("x"))
    return sums.select("n", F.sha2(F.concat_ws("|", F.lit(VERSION), "n", "s", "x").cast("binary"), 256).alias("fingerprint"))


def freeze(samples: DataFrame, path: str) -> str:
    """Publishes a snapshot, whole or not at all, and gives its fingerprint."""
    mark = fingerprint(samples).first()["fingerprint"]
    kept = samples.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(samples.columns))), 256))
    export.publish(kept, path)
    return mark


def snapshot(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """A snapshot's samples. Rows that aren't what was frozen, repeated ids and another fingerprint are errors."""
    frozen = spark.read.parquet(path)
    strict.sound(frozen, broken_rows(frozen).select("sample_id"), "changed row")
    samples = frozen.drop("row_hash")
    strict.sound(samples, samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated sample")
    if expected is not None and (mark := fingerprint(samples).first()["fingerprint"]) != expected:
        raise ValueError(f"fingerprint is {mark}, not {expected}")
    return samples


def run(spark: SparkSession, path: str, samples: DataFrame, models: DataFrame, planned_passes: int, schema: str, live: bool = False) -> DataFrame:
    """A run's results with their samples' metadata; cells that shouldn't be are errors. Of a live run's log only committed lines count."""
    if live:
        records = log.live(spark, path, schema)
    else:
        records, torn = log.repaired(spark, path, schema)
        strict.sound(records, torn, "torn line")
    findings = identity.result_findings(samples, models, records, planned_passes)
    strict.sound(records, findings, "result")
    more = [c for c in samples.columns if c not in records.columns]
    return records.join(samples.select("sample_id", *more), "sample_id")


def evidence_id(records: DataFrame) -> DataFrame:
    """A fingerprint of raw results: what was derived from them, and where files lie, doesn't count."""
    return fingerprint(records.drop("metrics", "scores"))


def source_plan(manifest: DataFrame) -> DataFrame:
    """condition, repetition and path of a source's runs in their order: a run alone, an experiment's passes, or a suite's conditions.

    manifest: kind (run, experiment or suite), position, condition, repetition, path; a run's condition is baseline.
    """
    condition = F.when(F.col("kind") == "run", "baseline").otherwise(F.coalesce("condition", F.lit("baseline")))
    rows = manifest.select(F.coalesce("position", F.lit(0)).alias("position"), condition.alias("condition"), F.coalesce("repetition", F.lit(1)).alias("repetition"), "path")
    strict.sound(rows, rows.groupBy("condition", "repetition").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repetition given twice")
    return rows.orderBy("position", "condition", "repetition")


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A derived report, one JSON document, with the fields of a schema; one that lacks them all is an error."""
    out = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return strict.sound(out, out.where(F.coalesce(*[F.col(c).cast("string") for c in out.columns]).isNull()), "not a report")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the response that is kept for their key, and whether there is one."""
    return requests.join(cache.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_conflicts(cache: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """key of responses that differ from what is kept, or from each other."""
    both = cache.select("key", value).unionByName(new.select("key", value))
    return both.groupBy("key").agg(F.countDistinct(F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit(""))).alias("n")).where("n > 1").select("key")


def cache_store(cache: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """What is to be appended to the cache: keys that it lacks, each once. Another response under a key is an error."""
    strict.sound(new, cache_conflicts(cache, new, value), "conflicting response")
    return new.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def metadata_rows(spark: SparkSession, document: str) -> DataFrame:
    """A manifest, given as JSON, as rows of path and value."""
    return export.document_rows(spark.createDataFrame([(0, document)], "at int, document string"), "at", "document").select("path", "value")


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and bytes of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def archive_members(spark: SparkSession, folder: str, pattern: str = "*.tar*") -> DataFrame:
    """archive, name, bytes and sha256 of the files in tar archives; each archive is one row, opened on an executor."""
    import io
    import tarfile

    import pandas as pd

    def opened(frames):
        import hashlib

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            data = tar.extractfile(m).read()
                            rows.append((path, m.name, m.size, hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["archive", "name", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(opened, "archive string, name string, bytes long, sha256 string")


def members_missing(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids that no archive's file is named after."""
    stem = F.regexp_extract("name", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return wanted.join(members.select(stem.alias("id")).distinct(), "id", "left_anti")
