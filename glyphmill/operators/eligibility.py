"""Which samples count: tracks, verification, splits, exclusions, and an audit of all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ("true", "yes", "verified", "approved")
FALSE_WORDS = ("false", "no", "unverified", "uncertain", "unresolved", "excluded")
SPLIT_ALIASES = {"testing": "test", "eval": "test", "evaluation": "test", "heldout": "test", "held-out": "test", "training": "train", "valid": "validation", "dev": "validation"}
TRACKED_SPLITS = ("train", "validation", "test")


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def tri_state(value: Column) -> Column:
    """True, false or unknown."""
    return F.when(_plain(value).isin(*TRUE_WORDS), True).when(_plain(value).isin(*FALSE_WORDS), False)


def split_name(value: Column) -> Column:
    """Lower case, dashes for underscores, aliases resolved; blank is null."""
    name = F.replace(_plain(value), F.lit("_"), F.lit("-"))
    known = F.coalesce(*[F.when(name == a, F.lit(b)) for a, b in SPLIT_ALIASES.items()], name)
    return F.when(name != "", known)


def kind(content_type: Column, sample_type: Column | None = None) -> Column:
    """equation, word or prose."""
    name = F.replace(_plain(F.coalesce(content_type, F.lit("prose"))), F.lit("_"), F.lit("-"))
    word = (name == "word") | (name.isin("", "none", "prose") & (F.coalesce(_plain(sample_type), F.lit("")) == "word") if sample_type is not None else F.lit(False))
    return F.when(name.contains("equation") | (name == "math"), "equation").when(word, "word").otherwise("prose")


def document(document_id: Column, source_document: Column, sample_id: Column) -> Column:
    """The document, or the sample for itself."""
    clean = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(clean(document_id), clean(source_document), sample_id.cast("string"))


def exclusions(samples: DataFrame) -> DataFrame:
    """sample_id and the first reason that holds against it; null for those that count.

    Whether splits matter at all is one fact about the whole roster. Columns excluded (boolean) and eligible (words for
    true and false), where there are any, exclude a sample before all else.
    """
    barred = F.lit(False)
    if "excluded" in samples.columns:
        barred |= F.coalesce(F.col("excluded").cast("boolean"), F.lit(False))
    if "eligible" in samples.columns:
        barred |= tri_state(F.col("eligible").cast("string")).eqNullSafe(F.lit(False))
    labelled = samples.agg(F.coalesce(F.max(F.when(split_name(F.col("split")).isin(*TRACKED_SPLITS), True)), F.lit(False)).alias("labelled_"))
    split = split_name(F.col("split"))
    reason = (
        F.when(barred, "explicitly_excluded")
        .when(tri_state(F.col("verification_status")).eqNullSafe(F.lit(False)), "reference_unverified")
        .when(F.col("labelled_") & split.isNull(), "missing_split")
        .when(split.isNotNull() & (split != "test") & (F.col("labelled_") | split.isin("train", "validation")), "not_test_split")
    )
    return samples.crossJoin(F.broadcast(labelled)).select("sample_id", "content_type", reason.alias("reason"))


def findings(samples: DataFrame) -> DataFrame:
    """One row for each thing an audit has against a sample, or against a document or writer in several splits."""
    split, verified = split_name(F.col("split")), tri_state(F.col("verification_status"))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    types = F.array_compact(
        F.array(
            F.when(verified.isNull(), "missing_verification_status").when(~verified, "reference_not_verified"),
            F.when(split.isNull(), "missing_test_split").when(split != "test", "not_test_split"),
            F.when(blank("source_document"), "missing_source_document"),
            F.when(blank("writer_id"), "missing_writer_id"),
            F.when(blank("reference"), "missing_reference"),
        )
    )
    own = samples.select(F.explode(types).alias("type"), F.col("sample_id").cast("string").alias("subject"))
    return own.union(overlaps(samples, "source_document", "document_split_overlap")).union(overlaps(samples, "writer_id", "writer_split_overlap"))


def overlaps(samples: DataFrame, field: str, name: str) -> DataFrame:
    """Groups that lie in more than one split."""
    split = split_name(F.col("split"))
    out = samples.where(split.isNotNull() & F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("subject")).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return out.where("a <> b").select(F.lit(name).alias("type"), "subject")


def eligibility_summary(samples: DataFrame) -> DataFrame:
    split = split_name(F.col("split"))
    good = tri_state(F.col("verification_status")).eqNullSafe(F.lit(True)) & split.eqNullSafe(F.lit("test")) & F.col("source_document").isNotNull() & (F.trim(F.coalesce("reference", F.lit(""))) != "")
    n = lambda c: F.count(F.when(c, 1))
    return samples.agg(
        F.count(F.lit(1)).alias("sample_count"), n(split == "train").alias("train_count"), n(split == "validation").alias("validation_count"), n(split == "test").alias("test_count"),
        F.countDistinct("source_document").alias("source_document_count"), F.countDistinct("writer_id").alias("writer_count"), n(good).alias("eligible_sample_count"),
    )
