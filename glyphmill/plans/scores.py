"""Queries over scores, leaderboards and summaries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import ranking, scoring, summary
from glyphmill.sources import evidence as e

P = e.PRELUDE
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]+"
# DuckDB's distance counts bytes: the tables' letters beyond ASCII, one to one, become control characters.
_LETTERS = "èéêçñíóöäüßÈÉÊÇÑÍÓÖÄÜ"
_CODES = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


def byte(x: str) -> str:
    return f"translate({x}, '{_LETTERS}', {_CODES})"


def norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


#: Distance of two lists.
LISTS = """list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), lambda r, i: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]),
  lambda acc, j: list_append(acc, least(acc[-1] + 1, r[j[1] + 1] + 1, r[j[1]] + (case when {a}[i[1]] = {b}[j[1]] then 0 else 1 end))), [i[1]]), range(0, len({b}) + 1))[-1]"""

#: Measures of each distinct successful prediction, and every planned cell.
SCORED = f"""{P},
pairs as (select distinct model, sample_id, {norm('reference')} as r, {norm('prediction')} as p from results where status = 'success'),
split_ as (select *, string_split(r, ' ') as a, string_split(p, ' ') as b from pairs),
m as (select model, sample_id, case when r = p then 0 else levenshtein({byte('r')}, {byte('p')}) end::bigint as char_edits, length(r)::bigint as reference_chars,
  case when r = p then 0 else {LISTS.format(a='a', b='b')} end::bigint as word_edits, len(a)::bigint as reference_words, r = p as exact_match from split_ where r <> '')"""

CELLS = f"""{SCORED},
cells as (select mo.model, pa.pass, s.sample_id, s.source_document, case when s.content_type = 'equation' then 'equation' else 'prose' end as track,
  case when r.status is null then 'missing' when r.status = 'unsupported' then 'unsupported' when r.status = 'success' then 'success' else 'failed' end as outcome,
  r.cache_hit, r.latency_seconds, length({norm('s.reference')})::bigint as reference_chars, len(string_split({norm('s.reference')}, ' '))::bigint as reference_words,
  case when r.status = 'success' then m.char_edits else length({norm('s.reference')}) end::bigint as char_edits,
  case when r.status = 'success' then m.word_edits else len(string_split({norm('s.reference')}, ' ')) end::bigint as word_edits,
  coalesce(r.status = 'success' and m.exact_match, false) as exact_match
  from samples s cross join models mo cross join passes pa left join results r on r.model = mo.model and r.pass = pa.pass and r.sample_id = s.sample_id
  left join m on m.model = mo.model and m.sample_id = s.sample_id),
per_pass as (select track, model, pass, sum(char_edits)::bigint as character_edits, sum(reference_chars)::bigint as reference_chars, sum(word_edits)::bigint as word_edits, sum(reference_words)::bigint as reference_words,
  count(*) filter (exact_match) as exact_matches, count(*) as eligible_sample_count, count(*) filter (outcome = 'success') as success_count, count(*) filter (outcome = 'failed') as failed_count,
  count(*) filter (outcome = 'missing') as missing_count, count(*) filter (outcome = 'success' and cache_hit) as cache_hit_count,
  quantile_cont(case when outcome = 'success' and not cache_hit then latency_seconds end, 0.5) as median_latency_seconds
  from cells where outcome <> 'unsupported' group by all),
pass_scores as (select *, character_edits::double / nullif(reference_chars, 0) as corpus_cer, word_edits::double / nullif(reference_words, 0) as wer, exact_matches::double / nullif(eligible_sample_count, 0) as exact_match_rate,
  100.0::double * (0.95::double * greatest(0::double, 1 - character_edits::double / nullif(reference_chars, 0)) + 0.05::double * (exact_matches::double / nullif(eligible_sample_count, 0))) as score from per_pass),
pooled as (select track, model, quantile_cont(latency_seconds, 0.5) as median_latency_seconds, quantile_cont(latency_seconds, 0.95) as p95_latency_seconds from cells where outcome = 'success' and not cache_hit group by all),
board as (select track, model, avg(score) as score, stddev_samp(score) as score_stddev, min(score) as score_min, max(score) as score_max, avg(corpus_cer) as corpus_cer, avg(wer) as wer, avg(exact_match_rate) as exact_match_rate,
  sum(character_edits)::bigint as character_edits, sum(reference_chars)::bigint as reference_chars, sum(success_count)::bigint as success_count, sum(failed_count)::bigint as failed_count, sum(missing_count)::bigint as missing_count,
  sum(eligible_sample_count)::bigint as expected_count, count(*) filter (missing_count = 0) as terminal_pass_count, bool_and(missing_count = 0) as terminal_complete from pass_scores group by all),
models_ as (select b.*, (failed_count + missing_count)::double / nullif(expected_count, 0) as failure_rate, success_count::double / nullif(expected_count, 0) as sample_coverage, median_latency_seconds, p95_latency_seconds from board b left join pooled using (track, model))"""

MARGIN = 2.0
RANKED = f"""{CELLS},
walk as (select track, max(score) as anchor, 1 as band from models_ group by track
  union all select w.track, (select max(score) from models_ x where x.track = w.track and w.anchor - x.score > {MARGIN}) as anchor, w.band + 1 from walk w where exists (select 1 from models_ x where x.track = w.track and w.anchor - x.score > {MARGIN})),
banded as (select m.*, w.band, w.anchor as band_anchor_score, row_number() over (partition by m.track, m.model order by w.band) as n from models_ m join walk w on w.track = m.track and m.score <= w.anchor and w.anchor - m.score <= {MARGIN}),
ranks as (select *, bool_and(median_latency_seconds is not null) over (partition by track, band) as timing_complete, row_number() over (partition by track, band order by median_latency_seconds, score desc, model) as pos, row_number() over (partition by track order by band, median_latency_seconds, score desc, model) as overall from banded where n = 1)"""


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return e.samples(spark, sf_dir), e.models(spark), e.passes(spark), e.results(spark, sf_dir)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results to be measured: made of samples that are dealt out."""
    return e.results_of(scoring.spread(e.samples(spark, sf_dir)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cells(e.samples(spark, sf_dir), e.models(spark), e.passes(spark), _dealt(spark, sf_dir))


def normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.normalize_text(F.col("text")).alias("normalized"))


def normalize_content(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.normalize_content(F.col("text")).alias("normalized"))


def score_sample(spark, sf_dir):
    found = scoring.scored(_dealt(spark, sf_dir))
    return _round(found.select("model", "pass", "sample_id", "char_edits", "reference_chars", "word_edits", "reference_words", "exact_match", "cer", "wer"))


def _predictions(spark, sf_dir):
    """Each different successful prediction of a model, dealt out."""
    return scoring.spread(e.results(spark, sf_dir).where("status = 'success'").select("model", "sample_id", "reference", "prediction")).distinct()


def edit_breakdown(spark, sf_dir):
    ok = _predictions(spark, sf_dir)
    return ok.withColumn("d", t.edit_breakdown(t.normalize_text(F.col("reference")), t.normalize_text(F.col("prediction")))).select("model", "sample_id", "d.*")


def edit_alignment(spark, sf_dir):
    ok = _predictions(spark, sf_dir)
    return ok.withColumn("d", t.edit_alignment(t.normalize_text(F.col("reference")), t.normalize_text(F.col("prediction")))).select("model", "sample_id", "d.*")


def result_spine(spark, sf_dir):
    return scoring.outcomes(*_all(spark, sf_dir)).groupBy("track", "model", "pass", "outcome").agg(F.count(F.lit(1)).alias("n"))


_PASS = ["track", "model", "pass", "character_edits", "reference_chars", "word_edits", "reference_words", "exact_matches", "eligible_sample_count", "success_count", "failed_count", "missing_count", "cache_hit_count", "median_latency_seconds", "corpus_cer", "wer", "exact_match_rate", "score"]
_BOARD = ["track", "model", "score", "score_stddev", "score_min", "score_max", "corpus_cer", "wer", "exact_match_rate", "character_edits", "reference_chars", "success_count", "failed_count", "missing_count", "expected_count", "terminal_pass_count", "terminal_complete", "failure_rate", "sample_coverage", "median_latency_seconds", "p95_latency_seconds"]
_REAL = {"median_latency_seconds", "p95_latency_seconds", "corpus_cer", "wer", "exact_match_rate", "score", "score_stddev", "score_min", "score_max", "failure_rate", "sample_coverage", "cer", "band_anchor_score", "mean_sample_cer", "mean_sample_wer", "total_latency_seconds", "mean_latency_seconds", "samples_per_minute", "load_duration_seconds"}


def _sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) as {c}" if c in _REAL else c for c in columns)


def penalised_pass(spark, sf_dir):
    return _round(scoring.pass_table(_cells(spark, sf_dir)).select(*_PASS))


def leaderboard(spark, sf_dir):
    """The flagship: every planned cell scored with its penalty, passes and models aggregated."""
    return _round(scoring.model_table(_cells(spark, sf_dir)).select(*_BOARD))


def accuracy_bands(spark, sf_dir):
    out = ranking.ranked(scoring.model_table(_cells(spark, sf_dir)), MARGIN)
    return _round(out.select("track", "model", "score", F.col("band").cast("int").alias("band"), "band_anchor_score", "timing_complete", "within_band_position", F.col("rank").cast("long").alias("rank")))


def winner(spark, sf_dir):
    return ranking.winners(ranking.ranked(scoring.model_table(_cells(spark, sf_dir)), MARGIN))


def raw_accuracy_rank(spark, sf_dir):
    return ranking.raw_accuracy_rank(scoring.model_table(_cells(spark, sf_dir))).select("track", "model", "raw_accuracy_rank")


_SUM = ["model", "sample_count", "scored_sample_count", "success_count", "failed_count", "truncated_count", "cache_hit_count", "char_edits", "reference_chars", "word_edits", "reference_words", "cer", "wer", "mean_sample_cer", "exact_match_rate", "expected_sample_count", "missing_sample_count", "complete", "failure_rate", "measured_latency_sample_count", "total_latency_seconds", "mean_latency_seconds", "median_latency_seconds", "p95_latency_seconds", "samples_per_minute", "load_duration_seconds", "load_event_count", "rank"]


def _by_run(df: DataFrame) -> DataFrame:
    """Each pass of a model as a system of its own."""
    return df.withColumn("model", F.concat_ws("@", "model", "pass"))


def summary_by_model(spark, sf_dir):
    samples, models, results = e.samples(spark, sf_dir), e.models(spark), _dealt(spark, sf_dir)
    return _round(summary.summarize(_by_run(results), samples, _by_run(models.crossJoin(e.passes(spark)))).select(*_SUM))


_TRACK = ["content_type", "model", "status", "eligible_sample_count", "scored", "unsupported", "failed", "missing", "cer", "wer", "failure_rate", "sample_coverage", "samples_per_minute", "rank"]


def track_report(spark, sf_dir):
    samples, models, results = e.samples(spark, sf_dir), e.models(spark), _dealt(spark, sf_dir)
    return _round(summary.track_report(samples, _by_run(models.crossJoin(e.passes(spark))), _by_run(results)).select(*_TRACK))


def subgroup_report(spark, sf_dir):
    return _round(summary.subgroups(_by_run(_dealt(spark, sf_dir)), e.samples(spark, sf_dir), ["writer_id", "difficulty", "verification_status"]))


QUERIES = {
    "normalize_text": (normalize_text, rf"select doc_id, {norm('text')} as normalized from documents"),
    "normalize_content": (normalize_content, r"select doc_id, regexp_replace(nfc_normalize(text), '[\p{P}\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]', '', 'g') as normalized from documents"),
    "score_sample": (score_sample, f"{SCORED} select r.model, r.pass, r.sample_id, char_edits, reference_chars, word_edits, reference_words, exact_match, round(char_edits::double / reference_chars, 6) as cer, round(word_edits::double / reference_words, 6) as wer from results r join m using (model, sample_id) where status = 'success'"),
    "edit_breakdown": (edit_breakdown, None),
    "edit_alignment": (edit_alignment, None),
    "result_spine": (result_spine, f"{CELLS} select track, model, pass, outcome, count(*) as n from cells group by all"),
    "penalised_pass": (penalised_pass, f"{CELLS} select {_sql(_PASS)} from pass_scores"),
    "leaderboard": (leaderboard, f"{CELLS} select {_sql(_BOARD)} from models_"),
    "accuracy_bands": (accuracy_bands, f"{RANKED} select track, model, round(score, 6) as score, band, round(band_anchor_score, 6) as band_anchor_score, timing_complete, case when timing_complete then pos end::integer as within_band_position, case when timing_complete then overall end as rank from ranks"),
    "winner": (winner, f"""{RANKED} select track, case when bool_and(terminal_complete) then max(case when overall = 1 then model end) end as winner, case when bool_and(terminal_complete) then null else 'incomplete_evaluation' end as winner_reason,
        case when bool_and(terminal_complete) then 'available' else 'incomplete' end as status from ranks group by track"""),
    "raw_accuracy_rank": (raw_accuracy_rank, f"{CELLS} select track, model, row_number() over (partition by track order by score desc, model)::integer as raw_accuracy_rank from models_"),
    "summary_by_model": (summary_by_model, f"""{SCORED}, one as (select * replace (model || '@' || pass as model), model as base from results), j as (select one.* exclude (base), m.char_edits, m.reference_chars, m.word_edits, m.reference_words, m.exact_match from one left join m on m.model = one.base and m.sample_id = one.sample_id and one.status = 'success'),
        a as (select model, count(*) as sample_count, count(char_edits) as scored_sample_count, count(*) filter (status = 'success') as success_count, count(*) filter (status <> 'success') as failed_count, count(*) filter (truncated) as truncated_count, count(*) filter (cache_hit) as cache_hit_count,
        sum(char_edits)::bigint as char_edits, sum(reference_chars)::bigint as reference_chars, sum(word_edits)::bigint as word_edits, sum(reference_words)::bigint as reference_words, avg(char_edits::double / reference_chars) as mean_sample_cer, count(*) filter (exact_match) as exact_matches,
        sum(latency_seconds) filter (not cache_hit) as total_latency_seconds, count(latency_seconds) filter (not cache_hit) as measured_latency_sample_count, quantile_cont(case when not cache_hit then latency_seconds end, 0.5) as median_latency_seconds, quantile_cont(case when not cache_hit then latency_seconds end, 0.95) as p95_latency_seconds,
        sum(load_duration_seconds) filter (not cache_hit) as load_duration_seconds, count(load_duration_seconds) filter (not cache_hit) as load_event_count, count(distinct sample_id) as distinct_samples from j group by model),
        b as (select *, (select count(*) from samples) as expected_sample_count, (select count(*) from samples) - distinct_samples as missing_sample_count, char_edits::double / reference_chars as cer, word_edits::double / reference_words as wer, exact_matches::double / nullif(scored_sample_count, 0) as exact_match_rate,
        failed_count::double / sample_count as failure_rate, total_latency_seconds / measured_latency_sample_count as mean_latency_seconds, 60.0 * measured_latency_sample_count / total_latency_seconds as samples_per_minute from a),
        c as (select *, failed_count = 0 and missing_sample_count = 0 and sample_count = expected_sample_count as complete from b),
        d as (select *, case when complete then row_number() over (partition by complete order by cer, wer, model) end::integer as rank from c) select {_sql(_SUM)} from d"""),
    "track_report": (track_report, f"""{SCORED}, one as (select r.* replace (r.model || '@' || r.pass as model), m.char_edits, m.reference_chars, m.word_edits, m.reference_words from results r left join m on m.model = r.model and m.sample_id = r.sample_id and r.status = 'success'),
        el as (select content_type, count(*) as eligible_sample_count from samples group by all),
        st as (select content_type, model, count(char_edits) as scored, count(*) filter (status = 'unsupported') as unsupported, count(*) filter (char_edits is null and status <> 'unsupported') as failed, count(*) filter (char_edits is not null and cache_hit) as cached_scored, sum(latency_seconds) filter (not cache_hit) as total_latency_seconds,
        sum(char_edits) as char_edits, sum(reference_chars) as reference_chars, sum(word_edits) as word_edits, sum(reference_words) as reference_words from one group by all),
        a as (select content_type, models.model, eligible_sample_count, coalesce(scored, 0) as scored, coalesce(unsupported, 0) as unsupported, coalesce(failed, 0) as failed, coalesce(cached_scored, 0) as cached_scored, total_latency_seconds, char_edits::double / nullif(reference_chars, 0) as cer, word_edits::double / nullif(reference_words, 0) as wer from el cross join (select model || '@' || pass as model from models cross join passes) models left join st using (content_type, model)),
        b as (select *, eligible_sample_count - scored - failed - unsupported as missing, case when unsupported = eligible_sample_count then 'unsupported' when scored = eligible_sample_count then 'complete' else 'incomplete' end as status, failed::double / nullif(scored + failed, 0) as failure_rate, scored::double / eligible_sample_count as sample_coverage, 60.0 * (scored - cached_scored) / nullif(total_latency_seconds, 0) as samples_per_minute from a),
        d as (select *, case when status = 'complete' then row_number() over (partition by content_type, status order by cer, wer, model) end::integer as rank from b) select {_sql(_TRACK)} from d"""),
    "subgroup_report": (subgroup_report, f"""{SCORED}, one as (select r.model || '@' || r.pass as model, r.status, r.source_document, m.char_edits, m.reference_chars, m.exact_match, s.writer_id, s.difficulty, s.verification_status from results r join samples s using (sample_id) left join m on m.model = r.model and m.sample_id = r.sample_id and r.status = 'success'),
        f as (select 'writer_id' as field, coalesce(writer_id::varchar, 'Unknown') as value, * from one union all select 'difficulty', coalesce(difficulty, 'Unknown'), * from one union all select 'verification_status', coalesce(verification_status, 'Unknown'), * from one)
        select field, value, model, count(*) as result_count, count(char_edits) as scored_count, count(distinct source_document) as document_count, sum(char_edits)::bigint as char_edits, sum(reference_chars)::bigint as reference_chars, count(*) filter (exact_match) as exact_matches, round(sum(char_edits)::double / nullif(sum(reference_chars), 0), 6) as cer from f group by all"""),
}
