"""Relations that must hold between runs, rosters, reviews and partitions, as DataFrames of findings."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.eligibility import TRUE_WORDS

# Fixed values.
REVIEW_CODES = ("severe_fragmentation", "reference_mismatch", "unreadable", "other")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def result_findings(samples: DataFrame, models: DataFrame, results: DataFrame, planned_passes: int) -> DataFrame:
    """finding, model, pass, sample_id and n of result cells that shouldn't be. Model names count in lower case, trimmed."""
    got = results.withColumn("model", F.lower(F.trim("model")))
    cells = got.groupBy("model", "pass", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(models.select(F.lower(F.trim("model")).alias("model")).distinct())
    frozen = samples.select("sample_id", F.sha2(F.col("reference").cast("binary"), 256).alias("frozen"))
    named = lambda df, name: df.select(F.lit(name).alias("finding"), "model", "pass", "sample_id", "n")
    differs = got.select("model", "pass", "sample_id", F.sha2(F.col("reference").cast("binary"), 256).alias("own")).join(frozen, "sample_id").where(~F.col("own").eqNullSafe(F.col("frozen")))
    return _all(
        [
            named(cells.join(known, "model", "left_anti"), "unknown_model"),
            named(cells.join(samples.select("sample_id"), "sample_id", "left_anti"), "unknown_sample"),
            named(cells.where((F.col("pass") < 1) | (F.col("pass") > planned_passes)), "pass_out_of_plan"),
            named(cells.where("n > 1"), "duplicate_result"),
            named(differs.groupBy("model", "pass", "sample_id").agg(F.count(F.lit(1)).alias("n")), "reference_mismatch"),
        ]
    )


def declared_unsupported(roster: DataFrame, declared: DataFrame, results: DataFrame, planned_passes: int) -> DataFrame:
    """finding, model, sample_id: declared ids that the roster lacks, and samples unsupported in some passes only."""
    stray = declared.join(roster.select("sample_id"), "sample_id", "left_anti").select(F.lit("declared_unknown_sample").alias("finding"), "model", "sample_id")
    n = F.countDistinct(F.when(F.col("status") == "unsupported", F.col("pass")))
    some = results.groupBy("model", "sample_id").agg(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < planned_passes))
    return stray.unionByName(some.select(F.lit("eligibility_inconsistent").alias("finding"), "model", "sample_id"))


def differing_fields(manifests: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """by, field and n_values: identity fields that have more than one value in a group. Null is a value, nested ones count as JSON."""
    kinds = dict(manifests.dtypes)
    text = lambda c: F.to_json(F.col(c)) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    cells = manifests.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.concat(F.lit("="), text(f)), F.lit("")).alias("value")) for f in fields])).alias("x"))
    return cells.groupBy(*by, "x.field").agg(F.countDistinct("x.value").alias("n_values")).where("n_values > 1")


def pair_findings(rows: DataFrame) -> DataFrame:
    """finding and pair of (id, pair, origin, split, content_type): pairs that aren't one real and one synthetic sample alike."""
    n = lambda o: F.count(F.when(F.col("origin") == o, 1))
    pairs = rows.groupBy("pair").agg(n("real").alias("real"), n("synthetic").alias("synthetic"), F.count(F.lit(1)).alias("n"), *[F.min(F.coalesce(c, F.lit(""))).alias(f"{c}_a") for c in ("split", "content_type")], *[F.max(F.coalesce(c, F.lit(""))).alias(f"{c}_z") for c in ("split", "content_type")])
    kinds = F.array_compact(
        F.array(
            F.when((F.col("real") != 1) | (F.col("synthetic") != 1) | (F.col("n") != 2), "incomplete_pair"),
            F.when(F.col("split_a") != F.col("split_z"), "split_mismatch"),
            F.when(F.col("content_type_a") != F.col("content_type_z"), "content_type_mismatch"),
        )
    )
    return pairs.select(F.explode(kinds).alias("finding"), "pair")


LINEAGE = r"^(real|synthetic)/([^0-9/]+([0-9]{4}))/(.+)$"


def lineage_findings(rows: DataFrame, sources: Callable[[Column], list[Column]]) -> DataFrame:
    """finding and id of (id, origin, pair, source_document, paired_source_id) whose fields don't say what the id says.

    An id is origin/groupYYYY/page. ``sources`` gives the names that a document of a year may have.
    """
    part = lambda i: F.regexp_extract("id", LINEAGE, i)
    known, rest = F.col("id").rlike(LINEAGE), F.concat_ws("/", part(2), part(4))
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    kinds = F.array_compact(
        F.array(
            F.when(~known, "unexpected_id"),
            F.when(known & differs("origin", part(1)), "origin_mismatch"),
            F.when(known & differs("pair", rest), "pair_mismatch"),
            F.when(known & ~F.coalesce(F.col("source_document").isin(*sources(part(3))), F.lit(False)), "source_mismatch"),
            F.when(known & differs("paired_source_id", F.concat(F.lit("real/"), F.col("pair"))), "paired_source_mismatch"),
        )
    )
    return rows.select(F.explode(kinds).alias("finding"), "id")


def leaks(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """key, n_groups and n_rows: for each key, the groups that lie in more than one split. Null keys lie nowhere."""
    cells = rows.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).where("x.value is not null")
    groups = cells.groupBy("x.key", "x.value").agg(F.min(split).alias("a"), F.max(split).alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z")
    return groups.groupBy("key").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


def partition_findings(partitions: dict[str, DataFrame], sizes: dict[str, int], key: str = "id") -> DataFrame:
    """finding, subject and n: ids in more than one partition or twice in one, and partitions of another size than planned."""
    rows = _all([df.select(F.lit(name).alias("partition"), F.col(key).alias("id")) for name, df in partitions.items()])
    cells = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("partition").alias("parts"))
    planned = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    counts = rows.groupBy("partition").agg(F.countDistinct("id").alias("n"))
    return _all(
        [
            cells.where("parts > 1").select(F.lit("in_several_partitions").alias("finding"), F.col("id").cast("string").alias("subject"), F.col("parts").alias("n")),
            cells.where("n > parts").select(F.lit("repeated_id").alias("finding"), F.col("id").cast("string").alias("subject"), "n"),
            counts.where(F.col("n") != F.element_at(planned, F.col("partition"))).select(F.lit("unplanned_size").alias("finding"), F.col("partition").alias("subject"), "n"),
        ]
    )


def review_findings(review: DataFrame, roster: DataFrame) -> DataFrame:
    """sample_id and the first thing wrong with a review's decision; the roster must be reviewed whole and nothing else.

    review: sample_id, crop_sha256, reference_sha256, decision, reason_code, reason. roster: sample_id, crop, reference.
    """
    decisions = review.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("sample_id"))).withColumn("reviewed", F.lit(True))
    both = decisions.join(roster.select("sample_id", F.col("crop").alias("own_crop"), F.sha2(F.col("reference").cast("binary"), 256).alias("own_reference"), F.lit(True).alias("listed")), "sample_id", "full_outer")
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    why = (
        F.when(F.col("reviewed").isNull(), "missing_decision")
        .when(F.col("listed").isNull(), "unknown_sample")
        .when(F.col("times") > 1, "repeated_decision")
        .when(~F.coalesce(F.col("decision").isin("keep", "exclude"), F.lit(False)), "unfinished")
        .when(~F.col("crop_sha256").eqNullSafe(F.col("own_crop")), "crop_mismatch")
        .when(~F.col("reference_sha256").eqNullSafe(F.col("own_reference")), "reference_mismatch")
        .when((F.col("decision") == "exclude") & ~(F.coalesce(F.col("reason_code").isin(*REVIEW_CODES), F.lit(False)) & given(F.col("reason"))), "reason_missing")
        .when((F.col("decision") == "keep") & (given(F.col("reason_code")) | given(F.col("reason"))), "reason_unwanted")
    )
    return both.select("sample_id", why.alias("finding")).where("finding is not null").distinct()


def review_exclusions(review: DataFrame, roster: DataFrame) -> DataFrame:
    """sample_id and reason of the samples that a sound review excludes; an unsound one is an error."""
    if bad := review_findings(review, roster).limit(1).collect():
        raise ValueError(f"sample review: {bad[0].finding} of {bad[0].sample_id}")
    return _excluded(review)


def _excluded(review: DataFrame) -> DataFrame:
    return review.where("decision = 'exclude'").select("sample_id", F.concat(F.lit("human_review:"), "reason_code", F.lit(": "), "reason").alias("reason"))


def with_review(exclusions: DataFrame, review: DataFrame) -> DataFrame:
    """Exclusion reasons, a review's before all others."""
    own = _excluded(review).withColumnRenamed("reason", "human")
    return exclusions.join(own, "sample_id", "left").select(*[F.coalesce("human", "reason").alias("reason") if c == "reason" else F.col(c) for c in exclusions.columns])


def only(records: DataFrame, split: str | None = None, content_type: str | None = None) -> DataFrame:
    """Records of one split and content type; that none is left is an error."""
    for field, value in (("split", split), ("content_type", content_type)):
        if value is not None:
            records = records.where(F.lower(F.trim(F.col(field))) == value.strip().lower())
    if not records.limit(1).count():
        raise ValueError(f"no record has split {split!r} and content type {content_type!r}")
    return records


def verified(flag: Column, status: Column) -> Column:
    """Null where neither is given, else whether all that is given says verified; blanks alone say no."""
    words = F.replace(F.replace(F.lower(F.trim(status)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    explicit = flag.isNotNull() | F.coalesce(status != "", F.lit(False))
    said = F.coalesce(flag, words.isin(*TRUE_WORDS)) & F.when(F.coalesce(words, F.lit("")) == "", F.lit(True)).otherwise(words.isin(*TRUE_WORDS))
    none = flag.isNull() & (F.coalesce(words, F.lit("")) == "")
    return F.when(explicit, F.when(none, F.lit(False)).otherwise(said))


def speed_comparable(external: Column, profile: Column, profile_concurrency: Column, concurrency: Column) -> Column:
    """Whether a run's seconds compare: a latency profile, one request at a time; external predictions must state a profile."""
    at_once = F.coalesce(F.when(profile.isNotNull(), profile_concurrency), concurrency, F.lit(1))
    return F.when(F.coalesce(external, F.lit(False)) & profile.isNull(), F.lit(False)).otherwise((F.coalesce(profile, F.lit("latency")) == "latency") & (at_once == 1))


def cache_bypass(c: dict[str, Column]) -> Column:
    """Why a response can't be cached, or null: the first of the reasons that holds.

    c: repeated, temperature (string), do_sample (string), provider, reported_provider, seed, identity, crop, prompt.
    """
    number = c["temperature"].try_cast("double")
    sampled = F.lower(c["do_sample"])
    return (
        F.when(c["repeated"], "repeated_measurement")
        .when(c["temperature"].isNotNull() & (number.isNull() | F.isnan(number) | (number < 0) | (number == float("inf"))), "invalid_temperature")
        .when(number > 0, "stochastic_temperature")
        .when(sampled == "true", "stochastic_sampling")
        .when(sampled.isNotNull() & (sampled != "false"), "invalid_sampling_control")
        .when(c["reported_provider"].isNotNull() & (c["reported_provider"] != c["provider"]), "model_identity_provider_mismatch")
        .when((c["provider"] == "local") & c["temperature"].isNull(), "missing_deterministic_temperature")
        .when((c["provider"] == "local") & c["seed"].isNull(), "missing_fixed_seed")
        .when(F.coalesce(c["identity"], F.lit("")) == "", "missing_immutable_model_identity")
        .when(~F.coalesce(c["crop"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "missing_crop_hash")
        .when(F.coalesce(c["prompt"], F.lit("")) == "", "missing_prompt")
    )


#: Fields of a response that may be kept.
SAFE_FIELDS = ("status", "prediction", "usage", "latency_seconds", "truncated")


def safe_response(response: DataFrame, key: str = "key") -> DataFrame:
    """key and the allowed fields only: what else a response holds, such as headers or a request's text, isn't kept."""
    return response.select(key, *[c for c in SAFE_FIELDS if c in response.columns])
