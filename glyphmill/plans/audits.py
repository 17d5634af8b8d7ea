"""Queries over findings and roll-ups of evidence, with their DuckDB SQL.

What could be wrong is planted by SQL texts that both engines read; what must be found is then counted apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import identity, rollup, scoring
from glyphmill.plans import roster
from glyphmill.plans.scores import SCORED, P, _dealt, _round
from glyphmill.sources import evidence as e

#: Results with repeated cells, unknown samples and models, passes out of plan and references that differ.
PLANTED = """
select model, pass, sample_id, status, reference from results
union all select upper(model) || ' ', pass, sample_id, status, reference from results where sample_id % 101 = 0
union all select model, pass, -1 - sample_id, status, reference from results where sample_id % 97 = 0
union all select 'm_other', pass, sample_id, status, reference from results where sample_id % 89 = 0 and model = 'm_sub'
union all select model, pass + 7, sample_id, status, reference || '!' from results where sample_id % 83 = 0
"""

REVIEW = """
select doc_id as sample_id, sha256_source as crop_sha256, case when doc_id % 37 = 0 then 'x' else sha256_text end as reference_sha256,
  case when doc_id % 41 = 0 then 'maybe' when doc_id % 5 = 0 then 'exclude' else 'keep' end as decision,
  case when doc_id % 5 = 0 and doc_id % 43 <> 0 then 'unreadable' else '' end as reason_code,
  case when doc_id % 5 = 0 or doc_id % 47 = 0 then 'can not be read' else '' end as reason
from docs where doc_id % 31 <> 0
union all select -1 - doc_id, sha256_source, sha256_text, 'keep', '', '' from docs where doc_id % 53 = 0
"""

PAIRED = """
select doc_id as id, doc_id - doc_id % 2 as pair, case when doc_id % 2 = 0 or doc_id % 59 = 1 then 'real' else 'synthetic' end as origin,
  case when doc_id % 61 = 1 then 'train' else 'test' end as split, case when doc_id % 67 = 0 then 'equation' else 'prose' end as content_type
from documents where doc_id % 23 <> 1
"""


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _review(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.sha2(F.col("source").cast("binary"), 256).alias("sha256_source"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256_text"))
    roster_ = docs.select(F.col("doc_id").alias("sample_id"), F.col("sha256_source").alias("crop"), F.col("text").alias("reference"))
    return spark.sql(REVIEW.replace("from docs", "from {docs}"), docs=docs), roster_


def result_findings(spark, sf_dir):
    planted = spark.sql(PLANTED.replace("from results", "from {results}"), results=e.results(spark, sf_dir))
    return identity.result_findings(e.samples(spark, sf_dir), e.models(spark), planted, 3)


def declared_unsupported(spark, sf_dir):
    s = e.samples(spark, sf_dir)
    declared = s.where("sample_id % 19 = 0").select(F.lit("m_sub").alias("model"), F.when(F.col("sample_id") % 38 == 0, -1 - F.col("sample_id")).otherwise(F.col("sample_id")).alias("sample_id"))
    r = e.results(spark, sf_dir).withColumn("status", F.when((F.col("sample_id") % 7 == 0) & (F.col("pass") <= F.col("sample_id") % 4), "unsupported").otherwise(F.col("status")))
    return identity.declared_unsupported(s, declared, r, 3)


def differing_fields(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", F.struct((F.col("s_suppkey") % 2).alias("parity")).alias("settings"), F.when(F.col("s_suppkey") % 5 == 0, "x").alias("protocol"), F.col("s_nationkey").alias("layout"))
    return identity.differing_fields(m, ["s_nationkey"], ["settings", "protocol", "layout"])


def pair_findings(spark, sf_dir):
    return identity.pair_findings(spark.sql(PAIRED.replace("from documents", "from {documents}"), documents=_docs(spark, sf_dir)))


def leak_summary(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 10 == 0, "train").otherwise("test").alias("split"), "source", F.md5(F.lower("text")).alias("reference"), F.when(F.col("n_chars") > 100, F.col("n_chars")).alias("length"), "doc_id")
    return identity.leaks(d, ["source", "reference", "length", "doc_id"])


def partition_findings(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    parts = {"first": c.where("id % 3 = 0").union(c.where("id % 210 = 0")), "second": c.where("id % 3 = 1 or id % 77 = 0"), "third": c.where("id % 3 = 2 and id % 7 <> 0")}
    return identity.partition_findings(parts, {"first": 1, "second": 2, "third": 3})


def review_findings(spark, sf_dir):
    return identity.review_findings(*_review(spark, sf_dir))


def reviewed_exclusions(spark, sf_dir):
    review, all_ = _review(spark, sf_dir)
    sound = review.where("sample_id >= 0 and sample_id % 37 <> 0 and sample_id % 41 <> 0 and sample_id % 43 <> 0 and sample_id % 47 <> 0")
    own = identity.review_exclusions(sound, all_.join(sound.select("sample_id"), "sample_id", "left_semi"))
    return identity.with_review(all_.select("sample_id", F.when(F.col("sample_id") % 3 == 0, "not_test_split").alias("reason")), sound).join(own.select("sample_id", F.lit(True).alias("human")), "sample_id", "left")


def metadata_filter(spark, sf_dir):
    return identity.only(e.samples(spark, sf_dir), " TEST", "word").select("sample_id", "split", "content_type")


def run_predicates(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    flag = F.when(k % 4 == 0, k % 8 == 0)
    status = F.when(k % 3 == 0, F.when(k % 2 == 0, " Verified").otherwise("un-verified")).when(k % 3 == 1, "")
    profile = F.when(k % 5 < 3, F.when(k % 5 == 0, "latency").otherwise("throughput"))
    return s.select("s_suppkey", identity.verified(flag, status).alias("verified"), identity.speed_comparable(k % 2 == 0, profile, F.when(k % 7 == 0, 4), F.when(k % 11 == 0, 2)).alias("comparable"), rollup.retry_delay(k % 15, F.when(k % 6 == 0, 2.5)).alias("delay"))


def cache_bypass(spark, sf_dir):
    k = F.col("s_suppkey")
    c = {
        "repeated": k % 23 == 0, "temperature": F.when(k % 7 != 0, F.element_at(F.array(F.lit("0"), F.lit("0.5"), F.lit("-1"), F.lit("hot"), F.lit("0.0")), (k % 5 + 1).cast("int"))), "do_sample": F.element_at(F.array(F.lit(None).cast("string"), F.lit("false"), F.lit("true"), F.lit("maybe"), F.lit("False")), (k % 11 % 5 + 1).cast("int")),
        "provider": F.when(k % 2 == 0, "local").otherwise("api"), "reported_provider": F.when(k % 13 == 0, "api"), "seed": F.when(k % 3 != 0, k), "identity": F.when(k % 17 != 0, F.col("s_name")), "crop": F.sha2(F.when(k % 19 != 0, F.col("s_name")).cast("binary"), 256), "prompt": F.when(k % 29 != 0, "read"),
    }
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", identity.cache_bypass(c).alias("bypass"))


def timing_breakdown(spark, sf_dir):
    o = lambda m, source, start, v: F.struct(F.lit(m).alias("metric_name"), F.lit("seconds").alias("unit"), F.lit(source).alias("source"), F.lit(start).cast("string").alias("start_boundary"), F.lit("end").alias("end_boundary"), v.alias("value"))
    r = e.results(spark, sf_dir).withColumn("timing_observations", F.array(o("request", "client", "sent", F.col("latency_seconds")), o("load", "server", None, F.col("load_duration_seconds"))))
    return _round(rollup.timing_breakdown(r))


def usage_coverage(spark, sf_dir):
    usage = F.when(F.col("sample_id") % 4 != 0, F.struct("input_tokens", "output_tokens", F.when(F.col("model") == "m_sub", F.col("cached_tokens")).alias("cached_tokens")))
    r = e.results(spark, sf_dir).withColumns({"usage": usage, "usage_source": F.when(F.col("sample_id") % 3 == 0, "server"), "tokenization": F.when(F.col("sample_id") % 3 == 0, "bpe")})
    return _round(rollup.usage_coverage(r))


def operational_summary(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("pass", (F.col("user_id") % 3 + 1).cast("int"))
    attempts = ev.select("pass", F.when(F.col("event_type") == "click", "request_started").when(F.col("event_type") != "view", "request_finished").alias("event_kind"), F.when(F.col("event_type") == "error", "retryable_error").alias("status"))
    invocations = ev.where("event_type = 'purchase'").select("pass", F.col("value").alias("wall_seconds"), F.when((F.col("pass") != 2) | (F.col("event_id") % 2 == 0), F.lit(0.25)).alias("spend_usd"))
    return _round(rollup.operational_summary(attempts, invocations, e.results(spark, sf_dir), True))


def equivalence_summary(spark, sf_dir):
    from glyphmill.plans.inputs import equation_equivalence

    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    out = equation_equivalence(spark, sf_dir).join(p, "p_partkey").where("p_partkey % 7 <> 0")
    return _round(rollup.equivalence_summary(out, p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("applicable")), "p_brand"))


def _runs(spark, sf_dir):
    r = e.results(spark, sf_dir).where("model <> 'm_drop' or pass < 3").groupBy(F.col("model").alias("condition"), "pass").agg(F.count(F.lit(1)).alias("recorded"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))
    expected = F.col("recorded") + F.when(F.col("pass") == 2, 5).otherwise(0)
    return r.select("condition", F.when(F.col("pass") == 2, "paused").otherwise("complete_with_errors").alias("status"), expected.alias("expected"), "recorded", "failed", F.when((F.col("condition") != "m_sub") | (F.col("pass") != 1), F.col("recorded") + 1).alias("attempts"))


def _planned(spark):
    return spark.sql("select * from values ('m_exact', 3), ('m_sub', 4), ('m_drop', 3), ('m_idle', 1) as t(condition, passes)")


def condition_status(spark, sf_dir):
    return rollup.condition_status(_runs(spark, sf_dir).where("condition <> 'm_sub' or status <> 'paused'"), _planned(spark))


def experiment_status(spark, sf_dir):
    return rollup.experiment_status(rollup.condition_status(_runs(spark, sf_dir), _planned(spark)), _runs(spark, sf_dir))


def actual_model(spark, sf_dir):
    r = e.results(spark, sf_dir).withColumn("actual_model", F.when(F.col("output_tokens") % 3 == 0, F.concat_ws("-", "model", F.col("output_tokens") % 5)))
    return rollup.actual_model(r, ["content_type", "model"])


def difficult_examples(spark, sf_dir):
    r = scoring.scored(_dealt(spark, sf_dir).where("status = 'success' and model <> 'm_exact'"))
    r = r.select("model", "pass", "sample_id", (F.col("char_edits") / F.col("reference_chars")).alias("cer"))
    return _round(rollup.difficult_examples(r, ["model", "pass"]))


def bounded_details(spark, sf_dir):
    return rollup.bounded_details(roster.research_findings(spark, sf_dir))


def ordered_groups(spark, sf_dir):
    g = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 7 == 0, "Unknown").when(F.col("doc_id") % 7 == 1, F.upper("source")).otherwise(F.col("source")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return rollup.ordered_groups(g, "value")


def comparison_order(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rollup.comparison_order(s.select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 7).alias("rank"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("score")))


def ordered_distinct(spark, sf_dir):
    return rollup.ordered_distinct(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "event_id")


def sorted_sets(spark, sf_dir):
    out = rollup.sorted_sets(e.results(spark, sf_dir), ["model"], ["status", "pass", "content_type"])
    return out.select("model", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("status", "pass", "content_type")])


def token_rates(spark, sf_dir):
    return _round(e.results(spark, sf_dir).select("model", "pass", "sample_id", rollup.tokens_per_second(F.col("output_tokens"), F.col("latency_seconds")).alias("rate")))


def load_durations(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('view', 'error')")
    w = ev.select((F.col("user_id") % 5).alias("model"), F.when(F.col("event_type") == "view", "success").otherwise("error").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 1000000).alias("load_duration"), F.when(F.col("event_id") % 3 != 2, F.lit(0.5)).alias("load_duration_seconds"))
    return _round(rollup.load_durations(w))


def track_status(spark, sf_dir):
    s = e.samples(spark, sf_dir).withColumn("track", F.col("content_type"))
    models = e.models(spark).select("model").union(spark.sql("select 'm_idle' as model"))
    good = s.where("track <> 'word'").select("sample_id", "track")
    r = e.results(spark, sf_dir).where("pass = 1 and (model <> 'm_sub' or content_type <> 'equation')")
    return rollup.track_status(s.select("track").distinct(), good, models, r.select("model", "sample_id", "status"))


def paired_models(spark, sf_dir):
    r = scoring.scored(_dealt(spark, sf_dir).where("status = 'success'")).select("model", "pass", "sample_id", "exact_match", (F.col("char_edits") / F.col("reference_chars")).alias("cer"))
    return _round(rollup.all_pairs(r.where("cer is not null"), ["sample_id", "pass"]))


def pass_contrast(spark, sf_dir):
    return rollup.contrast(e.results(spark, sf_dir), 1, 2)


def sampling_runs(spark, sf_dir):
    """Ids that earlier runs have measured are left out before a seeded subset is drawn."""
    from glyphmill.operators import audit

    known = e.results(spark, sf_dir).where("model = 'm_sub' and pass = 1 and status = 'success' and sample_id % 3 <> 0").select("sample_id").distinct()
    fresh = e.samples(spark, sf_dir).select("sample_id", "difficulty").join(known, "sample_id", "left_anti")
    return audit.seeded_subset(fresh, "sample_id", min(40, fresh.count()), 7)


_RUNS = f"""{P}, runs as (select model as condition, pass, count(*) as recorded, count(*) + 5 * (max(pass) = 2)::int as expected, count(*) filter (status = 'error') as failed from results where model <> 'm_drop' or pass < 3 group by model, pass),
    planned as (select * from (values ('m_exact', 3), ('m_sub', 4), ('m_drop', 3), ('m_idle', 1)) v(condition, passes))"""
_DOCS = "docs as (select doc_id, text, sha256(source) as sha256_source, sha256(text) as sha256_text from documents)"
_UNSOUND = "doc_id % 37 = 0 or doc_id % 41 = 0 or doc_id % 43 = 0 or doc_id % 47 = 0"

QUERIES = {
    "result_findings": (result_findings, f"""{P}, p as ({PLANTED}), q as (select lower(trim(model)) as model, pass, sample_id, reference from p)
        select 'unknown_model' as finding, model, pass, sample_id, count(*) as n from q where model not in (select model from models) group by all
        union all select 'unknown_sample', model, pass, sample_id, count(*) from q where sample_id not in (select sample_id from samples) group by all
        union all select 'pass_out_of_plan', model, pass, sample_id, count(*) from q where pass not between 1 and 3 group by all
        union all select 'duplicate_result', model, pass, sample_id, count(*) from q group by all having count(*) > 1
        union all select 'reference_mismatch', q.model, q.pass, q.sample_id, count(*) from q join samples s using (sample_id) where q.reference is distinct from s.reference group by all"""),
    "declared_unsupported": (declared_unsupported, f"""{P}, u as (select model, sample_id, count(distinct pass) as n from results where status = 'unsupported' or (sample_id % 7 = 0 and pass <= sample_id % 4) group by all)
        select 'declared_unknown_sample' as finding, 'm_sub' as model, -1 - sample_id as sample_id from samples where sample_id % 38 = 0 union all select 'eligibility_inconsistent', model, sample_id from u where n < 3"""),
    "differing_fields": (differing_fields, """select s_nationkey, 'settings' as field, count(distinct s_suppkey % 2) as n_values from supplier group by 1 having count(distinct s_suppkey % 2) > 1
        union all select s_nationkey, 'protocol', count(distinct s_suppkey % 5 = 0) from supplier group by 1 having count(distinct s_suppkey % 5 = 0) > 1"""),
    "pair_findings": (pair_findings, f"""with p as ({PAIRED}), g as (select pair, count(*) as n, count(distinct origin) as o, count(distinct split) as s, count(distinct content_type) as c from p group by 1)
        select 'incomplete_pair' as finding, pair from g where n <> 2 or o <> 2 union all select 'split_mismatch', pair from g where s > 1 union all select 'content_type_mismatch', pair from g where c > 1"""),
    "leak_summary": (leak_summary, """with d as (select case when doc_id % 10 = 0 then 'train' else 'test' end as split, unnest([{'k': 'source', 'v': source}, {'k': 'reference', 'v': md5(lower(text))}, {'k': 'length', 'v': case when n_chars > 100 then n_chars::varchar end}]) as x from documents),
        g as (select x.k as k, x.v as v, count(*) as n from d where x.v is not null group by 1, 2 having count(distinct split) > 1) select k as key, count(*) as n_groups, sum(n)::bigint as n_rows from g group by 1"""),
    "partition_findings": (partition_findings, """with c as (select c_custkey as id from customer), p as (select 'first' as p, id from c where id % 3 = 0 union all select 'first', id from c where id % 210 = 0 union all select 'second', id from c where id % 3 = 1 or id % 77 = 0 union all select 'third', id from c where id % 3 = 2 and id % 7 <> 0)
        select 'in_several_partitions' as finding, id::varchar as subject, count(distinct p) as n from p group by id having count(distinct p) > 1 union all select 'repeated_id', id::varchar, count(*) from p group by id having count(*) > count(distinct p)
        union all select 'unplanned_size', p, count(distinct id) from p group by p"""),
    "review_findings": (review_findings, f"""with {_DOCS}, r as ({REVIEW}) select coalesce(r.sample_id, d.doc_id) as sample_id, case when r.sample_id is null then 'missing_decision' when d.doc_id is null then 'unknown_sample' when doc_id % 41 = 0 then 'unfinished' when doc_id % 37 = 0 then 'reference_mismatch'
        when doc_id % 5 = 0 and doc_id % 43 = 0 then 'reason_missing' when doc_id % 5 <> 0 and doc_id % 47 = 0 then 'reason_unwanted' end as finding from docs d full join r on r.sample_id = d.doc_id
        where r.sample_id is null or d.doc_id is null or doc_id % 41 = 0 or doc_id % 37 = 0 or (doc_id % 5 = 0 and doc_id % 43 = 0) or (doc_id % 5 <> 0 and doc_id % 47 = 0)"""),
    "reviewed_exclusions": (reviewed_exclusions, f"""with x as (select *, doc_id % 5 = 0 and doc_id % 31 <> 0 and not ({_UNSOUND}) as human from documents) select doc_id as sample_id, case when human then 'human_review:unreadable: can not be read' when doc_id % 3 = 0 then 'not_test_split' end as reason, case when human then true end as human from x"""),
    "metadata_filter": (metadata_filter, f"{P} select sample_id, split, content_type from samples where split = 'test' and content_type = 'word'"),
    "run_predicates": (run_predicates, """with s as (select s_suppkey as k from supplier) select k as s_suppkey,
        case when k % 4 = 0 then (case when k % 3 = 0 then k % 8 = 0 and k % 2 = 0 else k % 8 = 0 end) when k % 3 = 0 then k % 2 = 0 end as verified,
        case when k % 2 = 0 and k % 5 >= 3 then false when k % 5 in (1, 2) then false when k % 5 = 0 then (case when k % 7 = 0 then false when k % 11 = 0 then false else true end) else k % 11 <> 0 end as comparable,
        case when k % 6 = 0 then 2.5::double else least((k % 15) * 0.1::double, 1.0::double) end as delay from s"""),
    "cache_bypass": (cache_bypass, """with s as (select s_suppkey as k, case when s_suppkey % 7 <> 0 then ['0', '0.5', '-1', 'hot', '0.0'][s_suppkey % 5 + 1] end as t, [null, 'false', 'true', 'maybe', 'False'][s_suppkey % 11 % 5 + 1] as d from supplier)
        select k as s_suppkey, case when k % 23 = 0 then 'repeated_measurement' when t in ('-1', 'hot') then 'invalid_temperature' when t = '0.5' then 'stochastic_temperature' when d = 'true' then 'stochastic_sampling' when d = 'maybe' then 'invalid_sampling_control'
        when k % 13 = 0 and k % 2 = 0 then 'model_identity_provider_mismatch' when k % 2 = 0 and t is null then 'missing_deterministic_temperature' when k % 2 = 0 and k % 3 = 0 then 'missing_fixed_seed' when k % 17 = 0 then 'missing_immutable_model_identity' when k % 19 = 0 then 'missing_crop_hash' when k % 29 = 0 then 'missing_prompt' end as bypass from s"""),
    "timing_breakdown": (timing_breakdown, f"""{P}, r as (select * from results where status = 'success' and not cache_hit) select model, 'request' as metric_name, 'seconds' as unit, 'client' as source, 'sent' as start_boundary, 'end' as end_boundary, round(quantile_cont(latency_seconds, 0.5), 6) as median, count(*) as observations from r group by model
        union all select model, 'load', 'seconds', 'server', null, 'end', round(quantile_cont(load_duration_seconds, 0.5), 6), count(*) from r where load_duration_seconds is not null group by model"""),
    "usage_coverage": (usage_coverage, f"""{P}, r as (select *, sample_id % 4 <> 0 as u from results where status = 'success' and not cache_hit) select model, case when sample_id % 3 = 0 then 'server' else 'unknown' end as source, case when sample_id % 3 = 0 then 'bpe' end as tokenization, count(*) as successful_requests, count(*) filter (u) as requests_with_usage,
        (sum(input_tokens) filter (u))::bigint as input_tokens_observed, (sum(output_tokens) filter (u))::bigint as output_tokens_observed, (sum(cached_tokens) filter (u and model = 'm_sub'))::bigint as cached_input_tokens_observed, round(count(*) filter (u)::double / count(*), 6) as coverage from r group by all"""),
    "operational_summary": (operational_summary, f"""{P}, v as (select *, (user_id % 3 + 1)::integer as pass from events), a as (select pass, count(*) filter (event_type = 'error') as retryable_failures, greatest(count(*) filter (event_type = 'click') - count(*) filter (event_type not in ('click', 'view')), 0) as uncertain_attempts,
        sum(value) filter (event_type = 'purchase') as wall, count(*) filter (event_type = 'purchase') as inv, count(*) filter (event_type = 'purchase' and (pass <> 2 or event_id % 2 = 0)) as known from v group by 1),
        r as (select pass, count(*) filter (status = 'error') as failed_predictions, count(*) filter (status = 'success' and not cache_hit) as ok from results group by 1)
        select pass, retryable_failures, uncertain_attempts, failed_predictions, round(wall, 6) as workload_wall_seconds, round(ok::double / wall, 6) as successful_samples_per_second, round(known * 0.25::double, 6) as estimated_cost_usd, case when inv = known then 'estimated' else 'unknown' end as cost_status from r join a using (pass)"""),
    "equivalence_summary": (equivalence_summary, """with p as (select p_brand, p_partkey % 3 as m, p_partkey % 7 <> 0 as done from part), g as (select p_brand, count(*) filter (m = 0 and done) as equivalent, count(*) filter (m = 1 and done) as different, count(*) filter (m = 2 and done) as undetermined, count(*) filter (done) as attempted, count(*) as applicable from p group by 1)
        select *, round(attempted::double / applicable, 6) as attempted_coverage, equivalent + different as determinate, round((equivalent + different)::double / nullif(attempted, 0), 6) as determinate_coverage from g"""),
    "condition_status": (condition_status, f"""{_RUNS}, w as (select condition, count(*) as started, count(*) filter (pass <> 2) as done, sum(expected) as e, min(expected) as one, sum(recorded) as r from runs where condition <> 'm_sub' or pass <> 2 group by 1)
        select condition, passes as planned_passes, coalesce(started, 0)::bigint as started_passes, coalesce(done, 0)::bigint as completed_passes, (e + (passes - started) * one)::bigint as expected_result_count, coalesce(r, 0)::bigint as recorded_result_count, (e + (passes - started) * one - r)::bigint as missing_result_count from planned left join w using (condition)"""),
    "experiment_status": (experiment_status, f"""{_RUNS} select (select sum(passes) from planned)::bigint as planned_passes, count(*) as started_passes, count(*) filter (pass <> 2) as completed_passes, null::bigint as expected_result_count, sum(recorded)::bigint as recorded_result_count, null::bigint as missing_result_count,
        sum(failed)::bigint as failed_count, case when bool_and(condition <> 'm_sub' or pass <> 1) then 0 end::bigint as attempts, case when bool_or(pass = 2) then 'paused' else 'incomplete' end as run_status from runs"""),
    "actual_model": (actual_model, f"{P} select content_type, model, arg_min(model || '-' || output_tokens % 5, (sample_id, pass)) as actual_model from results where output_tokens % 3 = 0 group by all"),
    "difficult_examples": (difficult_examples, f"""{SCORED}, r as (select r.model, r.pass, r.sample_id, char_edits::double / reference_chars as cer from results r left join m using (model, sample_id) where status = 'success' and model <> 'm_exact'),
        t as (select *, row_number() over (partition by model, pass order by cer desc nulls first, sample_id)::integer as turn from r) select model, pass, sample_id, round(cer, 6) as cer, turn from t where turn <= 4 order by model, pass, turn limit 12"""),
    "bounded_details": (bounded_details, None),
    "ordered_groups": (ordered_groups, "with g as (select case doc_id % 7 when 0 then 'Unknown' when 1 then upper(source) else source end as value, count(*) as n from documents group by 1) select *, row_number() over (order by lower(value) = 'unknown', lower(value), value)::integer as position from g"),
    "comparison_order": (comparison_order, "with s as (select s_name as model, case when s_suppkey % 4 <> 0 then s_suppkey % 7 end as rank, case when s_suppkey % 9 <> 0 then s_acctbal end as score from supplier) select *, row_number() over (order by rank nulls last, score desc nulls last, model)::integer as position from s"),
    "ordered_distinct": (ordered_distinct, "select event_type, min(event_id) as first, count(*) as n from events group by 1"),
    "sorted_sets": (sorted_sets, f"{P} select model, string_agg(distinct status, ',' order by status) as status, string_agg(distinct pass::varchar, ',' order by pass::varchar) as pass, string_agg(distinct content_type, ',' order by content_type) as content_type from results group by 1"),
    "token_rates": (token_rates, f"{P} select model, pass, sample_id, case when latency_seconds > 0 then round(output_tokens::double / latency_seconds, 6) end as rate from results"),
    "load_durations": (load_durations, """select user_id % 5 as model, count(*) as warmups, count(*) filter (event_type = 'error') as failed, round(sum(case event_id % 3 when 0 then event_id / 1000.0::double when 1 then 0.5::double end) filter (event_type = 'view'), 6) as load_seconds,
        count(*) filter (event_type = 'view' and event_id % 3 <> 2) as measured from events where event_type in ('view', 'error') group by 1"""),
    "track_status": (track_status, f"""{P}, t as (select distinct content_type as track from samples), mo as (select model from models union all select 'm_idle'), el as (select content_type as track, count(*) as n from samples where content_type <> 'word' group by 1),
        g as (select content_type as track, model, count(*) filter (status = 'success') as s, count(*) filter (status = 'unsupported') as u, count(*) as r from results where pass = 1 and content_type <> 'word' and (model <> 'm_sub' or content_type <> 'equation') group by all)
        select track, model, coalesce(n, 0)::bigint as eligible, coalesce(s, 0)::bigint as scored, coalesce(r, 0)::bigint as recorded, case when n is null then 'no_eligible_samples' when r is null then 'not_run' when u = n then 'unsupported' when s = n then 'complete' else 'incomplete' end as status from t cross join mo left join el using (track) left join g using (track, model)"""),
    "paired_models": (paired_models, f"""{SCORED}, o as (select r.model, r.pass, r.sample_id, exact_match as x, char_edits::double / reference_chars as cer from results r join m using (model, sample_id) where status = 'success')
        select a.model as left_model, b.model as right_model, count(*) as n, count(*) filter (a.x and b.x) as both_correct, count(*) filter (a.x and not b.x) as left_only, count(*) filter (not a.x and b.x) as right_only, count(*) filter (not a.x and not b.x) as both_wrong, round(avg(b.cer - a.cer), 6) as mean_difference
        from o a join o b on a.sample_id = b.sample_id and a.pass = b.pass and a.model < b.model group by all"""),
    "pass_contrast": (pass_contrast, f"""{P}, a as (select * from results where pass = 1), b as (select * from results where pass = 2) select coalesce(a.model, b.model) as model, coalesce(a.status, 'missing') as "left", coalesce(b.status, 'missing') as "right", count(*) as n from a full join b on a.model = b.model and a.sample_id = b.sample_id group by all"""),
    "sampling_runs": (sampling_runs, f"{P} select sample_id, difficulty from samples where sample_id not in (select sample_id from results where model = 'm_sub' and pass = 1 and status = 'success' and sample_id % 3 <> 0) order by md5('7|' || sample_id), sample_id limit 40"),
}
QUERIES["bounded_details"] = (bounded_details, f"""with f as ({{findings}}), r as (select *, row_number() over (partition by type order by subject) as turn from f) select type, count(*) as n, string_agg(subject, '; ' order by turn) filter (turn <= 12) as details, greatest(count(*) - 12, 0) as omitted from r group by 1""".replace("with f as ({findings})", P + ", f as (" + roster.QUERIES["research_findings"][1].removeprefix(P) + ")"))
