"""Strict readers: annotation tables, id lists, external predictions and settings files.

A reader that finds what mustn't be there raises, naming the first case; ``*_findings`` list all cases instead.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources import readers

# Fixed values.
PREDICTION_FIELDS = ("sample_id", "prediction", "status", "latency_seconds", "usage")
STATUSES = ("success", "error", "unsupported")
MAX_TOKENS = 2**63 - 1


def sound(df: DataFrame, bad: DataFrame, what: str) -> DataFrame:
    """df, if bad has no row."""
    if first := bad.limit(1).collect():
        raise ValueError(f"{what}: {first[0].asDict()}")
    return df


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata by sample_id, each id once, with its annotations and critical fields as they are."""
    raw = spark.read.schema("id string, sample_id string, content_type string, split string, verified string, verification_status string, source_document string, document_id string, writer_id string, difficulty string, annotations struct<critical_expressions: array<string>, reading_order: array<array<string>>>").json(path)
    out = raw.select(F.coalesce("id", "sample_id").alias("sample_id"), *[c for c in raw.columns if c not in ("id", "sample_id")])
    return sound(out, readers.repeated_keys(out), "metadata given twice")


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """id and text of words; an id with two texts is an error."""
    out = readers.word_table(spark, path).distinct()
    return sound(out, readers.repeated_keys(out, "id"), "word with two texts")


def _bars(line: Column) -> Column:
    return F.when(F.regexp_count(line, F.lit(r"\|")) >= 8, F.split(line, r"\s*\|\s*", 9)).otherwise(F.split(line, r"\s+", 9))


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """id and text of the ok lines: nine fields between bars where there are eight or more, else between spaces; fields 3 to 8 are numbers."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(_bars(F.trim("value")).alias("f")).where("size(f) = 9 and f[1] = 'ok'")
    numbers = F.forall(F.slice("f", 3, 6), lambda x: x.try_cast("int").isNotNull())
    text = F.trim(F.regexp_replace(F.replace(F.col("f")[8], F.lit("|"), F.lit(" ")), r"\s+", " "))
    return rows.where(numbers).select(F.col("f")[0].alias("id"), text.alias("text"))


def protocol_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, status and text of all lines of a protocol's table; a line without nine fields, an empty text or a repeated id is an error."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("value", F.split(F.trim("value"), r"\s+", 9).alias("f"))
    sound(rows, rows.where("size(f) < 9 or trim(replace(f[8], '|', ' ')) = ''").select("value"), "line without a reference")
    out = rows.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("status"), F.trim(F.replace(F.col("f")[8], F.lit("|"), F.lit(" "))).alias("text"))
    return sound(out, readers.repeated_keys(out, "id"), "repeated line id")


def ids(spark: SparkSession, path: str, pattern: str = r"^[A-Za-z0-9-]+$") -> DataFrame:
    """One id in a line, each of the right form and there once."""
    out = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    sound(out, out.where(~F.col("id").rlike(pattern)), "not an id")
    return sound(out, readers.repeated_keys(out, "id"), "repeated id")


def stem(path: Column, folder: str) -> Column:
    """What identifies a file of a folder, whatever its kind: the path below the folder without the suffix."""
    return F.regexp_extract(path, rf"/{folder}/(.+?)(?:\.[^./]+)?$", 1)


def paired(images: DataFrame, texts: DataFrame) -> DataFrame:
    """stem, image, text and finding of files that belong together by their stems; two files of a side with one stem are ambiguous."""
    side = lambda df, name: df.groupBy("stem").agg(F.min("path").alias(name), F.count(F.lit(1)).alias(f"{name}s"))
    both = side(images, "image").join(side(texts, "text"), "stem", "full_outer")
    why = F.when(F.greatest("images", "texts") > 1, "ambiguous").when(F.col("image").isNull(), "missing_image").when(F.col("text").isNull(), "missing_reference")
    return both.select("stem", "image", "text", why.alias("finding"))


def layout(image_ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of the annotation tables by how many images they know; the first is the layout, the last name among equals."""
    counts = None
    for name, table in tables.items():
        n = image_ids.join(table.select("id").distinct(), "id", "left_semi").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.union(n)
    return counts.orderBy(F.col("n").desc(), F.col("name").desc())


def prediction_findings(lines: DataFrame, roster: DataFrame) -> DataFrame:
    """value and the first thing wrong with each line of external predictions; null where nothing is.

    A line must be one JSON object without repeated keys or numbers beyond JSON. It is parsed as a variant, which
    refuses both, and a field's kind is asked of it.
    """
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    has = lambda name: F.array_contains(F.json_object_keys("value"), name)
    tokens = lambda path: F.when(kind(path).isNull() | (kind(path) == "VOID"), F.lit(False)).otherwise(~F.coalesce((kind(path) == "BIGINT") & (at(path, "bigint") >= 0), F.lit(False)))
    latency = at("$.latency_seconds", "double")
    sid = at("$.sample_id", "string")
    cached = "$.usage.input_tokens_details.cached_tokens"
    checked = parsed.withColumn("sample_id", F.when(kind("$.sample_id") == "STRING", sid))
    known = checked.join(roster.select(F.col("sample_id").cast("string").alias("sample_id"), F.lit(True).alias("known")), "sample_id", "left")
    repeated = checked.where("sample_id is not null").groupBy("sample_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    why = (
        F.when(F.col("v").isNull(), "not_json")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "not_an_object")
        .when(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, PREDICTION_FIELDS)))) > 0, "unknown_field")
        .when(F.coalesce("sample_id", F.lit("")) == "", "missing_sample_id")
        .when(F.col("known").isNull(), "unknown_sample")
        .when(F.col("times").isNotNull(), "duplicate_sample")
        .when(~F.coalesce(kind("$.prediction") == "STRING", F.lit(False)), "missing_prediction")
        .when(has("status") & ~F.coalesce(at("$.status", "string").isin(*STATUSES), F.lit(False)), "unknown_status")
        .when(has("latency_seconds") & ~(number("$.latency_seconds") & F.coalesce((latency >= 0) & (latency < float("inf")), F.lit(False))), "bad_latency")
        .when(has("usage") & ~F.coalesce(kind("$.usage").startswith("OBJECT"), F.lit(False)), "bad_usage")
        .when(tokens("$.usage.input_tokens") | tokens("$.usage.output_tokens") | tokens(cached), "bad_token_count")
    )
    return known.join(repeated, "sample_id", "left").select("sample_id", "value", why.alias("finding"))


def predictions(spark: SparkSession, path: str, roster: DataFrame) -> DataFrame:
    """External predictions of a roster's samples, all lines sound; status is success where it isn't given."""
    found = prediction_findings(spark.read.text(path), roster)
    sound(found, found.where("finding is not null").select("finding", "value"), "external prediction")
    row = F.from_json("value", readers.PREDICTION)
    return found.select(row.alias("r")).select("r.sample_id", "r.prediction", F.coalesce("r.status", F.lit("success")).alias("status"), "r.latency_seconds", "r.usage")


def provenance(description: str | None = None, document: str | None = None) -> dict:
    """Where predictions come from: a description or a JSON document that isn't empty, just one of them."""
    import json

    def once(pairs: list[tuple]) -> dict:
        if len(dict(pairs)) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refused(x: str) -> None:
        raise ValueError(f"not a JSON number: {x}")

    if (description is None) == (document is None):
        raise ValueError("give a description or a document")
    value = json.loads(document, object_pairs_hook=once, parse_constant=refused) if document is not None else {"description": (description or "").strip()}
    if not isinstance(value, dict) or not value or value == {"description": ""}:
        raise ValueError("provenance is empty")
    return value


#: Settings of a run, their kinds and defaults.
SETTINGS = {"models": list, "passes": int, "seed": int, "limit": int, "split": str, "content_type": str, "margin": float, "conditions": list}
#: Older names of settings, by version.
RENAMED = {1: {"repeats": "passes", "accuracy_margin": "margin"}, 2: {"accuracy_margin": "margin"}, 3: {}}


def settings(text: str) -> dict:
    """A run's settings from TOML of version 1, 2 or 3, under today's names; unknown names and wrong kinds are errors."""
    raw = tomllib.loads(text)
    version = raw.pop("version", 1)
    if version not in RENAMED:
        raise ValueError(f"unknown version {version}")
    out: dict = {}
    for name, value in raw.items():
        new = RENAMED[version].get(name, name)
        if new not in SETTINGS or new in out:
            raise ValueError(f"unknown or repeated setting {name}")
        if isinstance(value, bool) or not isinstance(value, SETTINGS[new]) and not (SETTINGS[new] is float and isinstance(value, int)):
            raise ValueError(f"{name} must be of kind {SETTINGS[new].__name__}")
        out[new] = value
    if not out.get("models"):
        raise ValueError("no models")
    return out
