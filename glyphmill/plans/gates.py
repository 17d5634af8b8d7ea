"""Queries over rules that withhold, exclude or name things, each with planted cases, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import eligibility, identity, policies, ranking, resample, scoring
from glyphmill.plans.scores import CELLS, MARGIN, P, _cells, _round, norm
from glyphmill.sources import evidence as e


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def winner_gates(spark, sf_dir):
    """Tracks by the samples' own content types: nothing is ranked under the name word."""
    tracks = e.samples(spark, sf_dir).select(F.col("content_type").alias("track"))
    return ranking.winners(ranking.ranked(scoring.model_table(_cells(spark, sf_dir)), MARGIN), tracks=tracks)


def explicit_exclusions(spark, sf_dir):
    k = F.col("sample_id")
    s = e.samples(spark, sf_dir).withColumns({"excluded": F.when(k % 11 == 0, True).when(k % 11 == 1, False), "eligible": F.when(k % 13 == 0, " No").when(k % 13 == 1, "yes").when(k % 13 == 2, "perhaps")})
    return eligibility.exclusions(s).select("sample_id", "reason")


def support_by_name(spark, sf_dir):
    """Suppliers as systems: lists, flags and names by number."""
    k = F.col("s_suppkey")
    c = _table(spark, sf_dir, "supplier").select(
        F.concat(F.when(k % 4 < 2, "TrOCR:").otherwise("other:"), "s_name").alias("model"),
        F.when(k % 6 == 1, F.array(F.lit("Prose"))).when(k % 6 == 2, F.array(F.lit(" latex "), F.lit("word"))).when(k % 6 == 3, F.array().cast("array<string>")).alias("allowed"),
        F.when(k % 5 == 1, F.array(F.lit("Math"))).when(k % 5 == 2, F.array().cast("array<string>")).alias("denied"),
        F.when(k % 7 == 1, False).when(k % 7 == 2, True).alias("equations"),
    )
    return policies.supported(c, e.samples(spark, sf_dir).select(F.col("content_type").alias("track")).distinct())


def equation_scores(spark, sf_dir):
    """A part's name with a composed letter, against the same name with that letter in two characters and one word in five changed."""
    k = F.col("p_partkey")
    reference = F.concat(F.lit(" é = "), "p_name")
    prediction = F.concat(F.lit("é =  "), F.when(k % 5 == 0, F.concat("p_name", F.lit(" +1"))).otherwise(F.col("p_name")))
    composed = _table(spark, sf_dir, "part").select("p_partkey", t.nfc(prediction).alias("p"), t.nfc(F.when(k % 17 == 0, " ").otherwise(reference)).alias("r"))
    out = composed.select("p_partkey", t.score_equation(F.col("p"), F.col("r")).alias("m"))
    return _round(out.select("p_partkey", "m.equation_cer", "m.normalized_exact_match", "m.char_edits", "m.word_edits", "m.reference_chars"))


def row_error_rates(spark, sf_dir):
    k = F.col("doc_id")
    prediction = F.when(k % 3 == 0, F.concat("text", F.lit(" x"))).when(k % 3 == 1, "").otherwise(F.concat(F.lit("\n"), "text"))
    stored = F.when(k % 4 == 0, 0.25).when(k % 4 == 1, -1.0).when(k % 4 == 2, float("inf"))
    return _round(_table(spark, sf_dir, "documents").select("doc_id", t.row_error_rate(stored, prediction, F.when(k % 29 == 0, " ").otherwise(F.col("text"))).alias("rate")))


def safe_names(spark, sf_dir):
    b = _table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "--!").otherwise(F.concat("url", F.lit(" Été_2!"))).alias("name"))
    return b.select("page_id", t.safe_name(F.col("name")).alias("safe"), t.document_of_line(F.col("name")).alias("document"))


def pair_seeds(spark, sf_dir):
    """A seed for each track and pair of brands."""
    brands = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("left")).distinct()
    tracks = _table(spark, sf_dir, "documents").select(F.col("lang").alias("track")).where("lang is not null").distinct()
    pairs = brands.join(brands.withColumnRenamed("left", "right"), F.col("left") < F.col("right")).join(F.broadcast(tracks))
    return pairs.select("track", "left", "right", resample.pair_seed(42, F.col("track"), F.col("left"), F.col("right")).cast("string").alias("seed"))


#: Rows of pairs with each thing wrong that an id can contradict.
_LINEAGE = """
select case when doc_id % 31 = 0 then 'page' || doc_id else o || '/exam' || y || '/page' || doc_id // 2 end as id, case when doc_id % 37 = 0 then 'scan' else o end as origin,
  case when doc_id % 41 = 0 then 'exam' || y || '/other' else 'exam' || y || '/page' || doc_id // 2 end as pair,
  case when doc_id % 43 = 0 then null when doc_id % 47 = 0 then 'Exam 1.pdf' when doc_id % 2 = 0 then 'Exam ' || y || '.pdf' else 'after Exam ' || y || '.pdf' end as source_document,
  case when doc_id % 53 = 0 then null when doc_id % 41 = 0 then 'real/exam' || y || '/other' else 'real/exam' || y || '/page' || doc_id // 2 end as paired_source_id, doc_id
from (select doc_id, 2010 + doc_id // 2 % 9 as y, case when doc_id % 2 = 0 then 'real' else 'synthetic' end as o from documents)
"""


def lineage_findings(spark, sf_dir):
    rows = spark.sql(_LINEAGE.replace("//", "div").replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))
    return identity.lineage_findings(rows, lambda year: [F.concat(F.lit("Exam "), year, F.lit(".pdf")), F.concat(F.lit("after Exam "), year, F.lit(".pdf"))])


QUERIES = {
    "winner_gates": (winner_gates, f"""{CELLS}, t as (select distinct content_type as track from samples), mm as (select track, model, count(*) filter (outcome = 'missing') as missing from cells where outcome <> 'unsupported' group by all)
        select track, null::varchar as winner, case when track in (select track from mm) then 'incomplete_evaluation' else 'no_scored_models' end as winner_reason, case when track in (select track from mm) then 'incomplete' else 'no_scored_models' end as status from t"""),
    "explicit_exclusions": (explicit_exclusions, f"{P} select sample_id, case when sample_id % 11 = 0 or sample_id % 13 = 0 then 'explicitly_excluded' when verification_status = 'unverified' then 'reference_unverified' when split <> 'test' then 'not_test_split' end as reason from samples"),
    "support_by_name": (support_by_name, f"""{P}, t as (select distinct content_type as track from samples), c as (select s_suppkey as k, case when s_suppkey % 4 < 2 then 'TrOCR:' else 'other:' end || s_name as model from supplier)
        select model, track, case when k % 6 = 1 and track <> 'prose' or k % 6 = 2 and track not in ('word', 'equation') or k % 6 = 3 or (track = 'equation' and (k % 5 = 1 or k % 7 = 1)) then 'model_does_not_support_task'
            when track = 'equation' and k % 4 < 2 and k % 6 in (0, 4, 5) and k % 7 not in (1, 2) then 'standard_trocr_is_prose_only' end as reason from c cross join t"""),
    "equation_scores": (equation_scores, """with x as (select p_partkey, p_partkey % 17 = 0 as gone, p_partkey % 5 = 0 as more, length(p_name) + 4 as n from part)
        select p_partkey, case when not gone then round(case when more then 3 else 0 end / n, 6) end as equation_cer, case when not gone then not more end as normalized_exact_match, case when not gone then case when more then 3 else 0 end::bigint end as char_edits, case when not gone then case when more then 1 else 0 end::bigint end as word_edits, case when not gone then n::bigint end as reference_chars from x"""),
    "row_error_rates": (row_error_rates, f"""with d as (select doc_id, case when doc_id % 29 = 0 then '' else {norm('text')} end as r, {norm("case doc_id % 3 when 0 then text || ' x' when 1 then '' else text end")} as p, case doc_id % 4 when 0 then 0.25 end as known from documents)
        select doc_id, case when (length(r) + 1) * (length(p) + 1) > 250000 or r = '' then known else round(case doc_id % 3 when 0 then 2 when 1 then length(r) else 0 end::double / length(r), 6) end as rate from d"""),
    "safe_names": (safe_names, r"""with n as (select page_id, case when page_id % 9 = 0 then '--!' else url || ' Été_2!' end as name from pages), k as (select *, substr(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48) as k from n)
        select page_id, case when k = '' then 'condition' else k end || '-' || substr(sha256(name), 1, 8) as safe, regexp_replace(name, '-[^-]*$', '') as document from k"""),
    "pair_seeds": (pair_seeds, "select t.track, a.b as left, c.b as right, (('0x' || substr(sha256('42' || chr(0) || t.track || chr(0) || a.b || chr(0) || c.b), 1, 16))::ubigint)::varchar as seed from (select distinct p_brand as b from part) a join (select distinct p_brand as b from part) c on a.b < c.b cross join (select distinct lang as track from documents where lang is not null) t"),
    "lineage_findings": (lineage_findings, f"""with r as ({_LINEAGE}), f as (select id, unnest([case when doc_id % 31 = 0 then 'unexpected_id' end, case when doc_id % 31 > 0 and doc_id % 37 = 0 then 'origin_mismatch' end, case when doc_id % 31 > 0 and doc_id % 41 = 0 then 'pair_mismatch' end,
            case when doc_id % 31 > 0 and (doc_id % 43 = 0 or doc_id % 47 = 0) then 'source_mismatch' end, case when doc_id % 31 > 0 and doc_id % 53 = 0 then 'paired_source_mismatch' end]) as finding from r) select finding, id from f where finding is not null"""),
}
