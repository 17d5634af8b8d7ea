"""Queries over costs, comparisons, checks and task metrics, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import checks, compare, costs, quantiles, scoring, task_metrics
from glyphmill.plans.scores import CELLS, SCORED, P, _all, _by_run, _cells, _dealt, _round, norm
from glyphmill.sources import evidence as e

RATES = costs.Rates(3.0, 15.0, 0.3)
_COST = "((input_tokens - cached_tokens) * 3.0::double + cached_tokens * 0.3::double + output_tokens * 15.0::double) / 1000000"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _one(spark, sf_dir):
    return scoring.scored(_dealt(spark, sf_dir))


def unit_cost(spark, sf_dir):
    r = e.results(spark, sf_dir)
    whole = r.where("output_tokens is not null").withColumn("model", F.concat("model", F.lit("+usage")))
    return _round(costs.unit_cost(r.unionByName(whole), RATES).withColumn("observed_cost", F.round("observed_cost", 3)))


def cost_scenarios(spark, sf_dir):
    u = costs.unit_cost(e.results(spark, sf_dir).where("output_tokens is not null"), RATES)
    return _round(costs.scenarios(u, [100, 1000, 10000], 20.0, 0.001))


def spend_ledger(spark, sf_dir):
    return costs.spend_ledger(e.results(spark, sf_dir).where("model <> 'm_sub' or output_tokens is not null"), RATES, 1.0).withColumn("spent", F.round(F.col("spent") * 1e7).cast("long"))


def usage_summary(spark, sf_dir):
    return _round(costs.usage_summary(e.results(spark, sf_dir)))


def timing_rollup(spark, sf_dir):
    r = e.results(spark, sf_dir)
    obs = F.explode(F.array(F.struct(F.lit("request").alias("metric_name"), F.col("latency_seconds").alias("value")), F.struct(F.lit("load").alias("metric_name"), F.col("load_duration_seconds").alias("value")))).alias("x")
    o = r.select(obs, F.when(F.col("cache_hit"), "cache").otherwise("client").alias("source")).select("x.metric_name", "x.value", "source", F.lit("seconds").alias("unit"), F.when(F.col("x.value").isNull(), "not_observed").alias("unavailable_reason"))
    return _round(costs.timing_rollup(o))


def throughput(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _round(costs.throughput(ev.select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 997 != 0, F.col("value")).alias("wall_seconds"), (F.col("event_id") % 40).alias("terminal"))))


def run_status(spark, sf_dir):
    s, m, _, r = _all(spark, sf_dir)
    return _round(costs.run_status(r, m, s))


def latency_stats(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _round(ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"), F.try_divide(60.0 * F.count("value"), F.sum("value")).alias("per_minute")))


def selected_percentiles(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("price", F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")))
    return _round(quantiles.percentiles(li, ["l_returnflag", "l_linestatus"], "price", {"p05": 0.05, "median": 0.5, "p95": 0.95, "p999": 0.999}))


def merge_runs(spark, sf_dir):
    r = e.results(spark, sf_dir)
    return compare.merge_runs({"a": r.where("pass = 1"), "b": r.where("pass = 2"), "c": r.where("pass = 3")}).groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


def paired_contingency(spark, sf_dir):
    one = scoring.scored(_dealt(spark, sf_dir).where("model in ('m_exact', 'm_drop')"))
    return compare.contingency(one, e.samples(spark, sf_dir).crossJoin(e.passes(spark)), "m_exact", "m_drop", ["pass"])


_TWICE = "(conv_id * 1000 + turn + 3) % 29 <> 0 and (conv_id * 1000 + turn + 6) % 29 <> 0"


def suite_variability(spark, sf_dir):
    s, m, p, r = e.samples(spark, sf_dir), e.models(spark), e.passes(spark), _dealt(spark, sf_dir)
    twice = _TWICE.replace("conv_id * 1000 + turn", "sample_id")  # passes 1 and 2 have all of these samples, pass 3 hasn't
    return _round(compare.variability(scoring.pass_table(scoring.cells(s.where(twice), m, p, r.where(twice)))))


def condition_pairs(spark, sf_dir):
    return _round(compare.condition_pairs(scoring.pass_table(_cells(spark, sf_dir))))


def threshold_sweep(spark, sf_dir):
    return _round(compare.threshold_sweep(_one(spark, sf_dir), F.col("reference_chars"), [0, 100, 200, 400, 800]))


def overlapping_subgroups(spark, sf_dir):
    g = {"long": F.col("reference_chars") >= 400, "wrong": ~F.col("exact_match"), "even": F.col("sample_id") % 2 == 0}
    return _round(compare.overlapping_subgroups(_one(spark, sf_dir), g))


def nearest_rank_p95(spark, sf_dir):
    return compare.nearest_rank(e.results(spark, sf_dir).where("not cache_hit"), ["model", "pass"], "latency_seconds", 0.95)


def worst_n(spark, sf_dir):
    return _round(compare.worst(_by_run(_dealt(spark, sf_dir)), 25).drop("flags"))


def review_queue(spark, sf_dir):
    return compare.review_queue(e.results(spark, sf_dir), "status", 20)


def flag_histogram(spark, sf_dir):
    return compare.flag_histogram(e.results(spark, sf_dir))


def missing_results(spark, sf_dir):
    return checks.missing_results(*_all(spark, sf_dir))


def orphan_metadata(spark, sf_dir):
    return checks.orphans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


def full_outer_pairing(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") * 2).alias("id"))
    return checks.pairing(p, v, "id", "missing_image", "missing_reference")


def reference_override(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return checks.overridden(d.select("doc_id", F.col("lang").alias("value")), d.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.col("source")).otherwise(F.lit(" ")).alias("value")), "doc_id", "value")


def constraint_violations(spark, sf_dir):
    from glyphmill.plans.audits import PLANTED

    s, _, _, r = _all(spark, sf_dir)
    planted = spark.sql(PLANTED.replace("from results", "from {results}"), results=r)
    return checks.violations(s.union(s.where("sample_id % 71 = 0")).where("sample_id % 79 <> 0"), planted, 2)


def same_roster(spark, sf_dir):
    return checks.same_roster(_by_run(e.results(spark, sf_dir)))


def _annotated(spark, sf_dir):
    w = F.split("reference", " ")
    return e.results(spark, sf_dir).where("status = 'success'").withColumns({"expressions": F.when(F.col("sample_id") % 3 != 0, F.array(F.get(w, F.lit(0)), F.lit("the"))), "earlier": F.get(w, F.lit(0)), "later": F.get(w, F.lit(1))})


def critical_expressions(spark, sf_dir):
    return task_metrics.critical_expressions(_annotated(spark, sf_dir))


def reading_order(spark, sf_dir):
    return task_metrics.reading_order(_annotated(spark, sf_dir))


def task_metric_rollup(spark, sf_dir):
    return _round(task_metrics.rollup(critical_expressions(spark, sf_dir)))


def repeated_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.has_repeated_text(F.col("text")).alias("repeated"))


def commentary_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.has_commentary(F.col("text")).alias("commentary"))


def label_audit(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 9 == 0, "table").otherwise("prose")
    more = F.element_at(F.array(F.lit(" {a{b}}"), F.lit(" }{"), F.lit(" x^{2"), F.lit(" $y"), F.lit(" TODO"), F.lit("\x01"), F.lit(" e\u0301")), (F.col("doc_id") % 13 + 1).cast("int"))
    return _docs(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 13 < 7, more).otherwise(F.lit("")))).select("doc_id", F.array_join(t.label_issues(F.col("text"), kind), ",").alias("issues"))


def csv_guard(spark, sf_dir):
    first = F.element_at(F.array(*map(F.lit, ("=", " +", "-", "\ufeff@", "\t=", "a="))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", t.csv_guard(F.concat(first, F.col("text"))).alias("guarded"))


def row_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws("|", F.lit("v1"), "doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256)), 256).alias("fingerprint"))


def snapshot_fingerprint(spark, sf_dir):
    part = F.conv(F.substr(F.col("fingerprint"), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return row_fingerprint(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.sum(part).cast("string"), 256).alias("fingerprint"))


_OCC = "(length({t}) - length(replace({t}, {x}, ''))) // length({x})"
_N_P, _N_R = norm("prediction"), norm("reference")
_ANN = f"{P}, an as (select model, sample_id, {_N_P} as p, {_N_R} as r, string_split(reference, ' ') as w, sample_id % 3 <> 0 as has from results where status = 'success'), ab as (select *, {norm('w[1]')} as a, {norm('w[2]')} as b from an)"
_CRIT = f"""{_ANN}, cr as (select sample_id, model, case when not has then 'not_annotated' when a = '' or {_OCC.format(t='r', x='a')} < 1 or {_OCC.format(t='r', x="'the'")} < 1 then 'error' else 'scored' end as status,
    (({_OCC.format(t='p', x='a')}) = ({_OCC.format(t='r', x='a')}))::int + (({_OCC.format(t='p', x="'the'")}) = ({_OCC.format(t='r', x="'the'")}))::int as ok from ab),
    cs as (select sample_id, model, status, case when status = 'scored' then ok end::bigint as passed, case when status = 'scored' then 2 end::bigint as total from cr)"""


def _fine(x: str) -> str:
    return f"({_OCC.format(t=x, x='a')} = 1 and {_OCC.format(t=x, x='b')} = 1 and strpos({x}, a) < strpos({x}, b))"


QUERIES = {
    "selected_percentiles": (selected_percentiles, "select l_returnflag, l_linestatus, count(p) as n, " + ", ".join(f"round(quantile_cont(p, {q}), 6) as {name}" for name, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95), ("p999", 0.999))) + " from (select *, case when l_linenumber < 7 then l_extendedprice end as p from lineitem) group by 1, 2 having count(p) > 0"),
    "unit_cost": (unit_cost, f"""{P}, u as (select * from results union all select model || '+usage' as model, * exclude (model) from results where output_tokens is not null), c as (select model, {_COST} as cost from u where not cache_hit and status <> 'unsupported'),
        a as (select model, count(cost) as usage_record_count, count(*) filter (cost is null) as unpriced_count, sum(cost) as o from c group by 1) select model, usage_record_count, unpriced_count, case when unpriced_count = 0 then round(o, 3) end as observed_cost, case when unpriced_count = 0 then round(o / usage_record_count, 6) end as unit_cost from a"""),
    "cost_scenarios": (cost_scenarios, f"""{P}, c as (select model, {_COST} as cost from results where output_tokens is not null and not cache_hit and status <> 'unsupported'), u as (select model, avg(cost) as unit from c group by 1)
        select model, v as sample_volume, round(20 + 0.001::double * v, 6) as local_total, round(unit * v, 6) as api_total, round(20 + 0.001::double * v - unit * v, 6) as local_minus_api, case when unit > 0.001 then 'available' else 'local_variable_cost_not_lower' end as break_even_status,
        case when unit > 0.001 then greatest(0, ceil(20 / (unit - 0.001::double))) end::bigint as break_even_samples from u cross join (values (100::bigint), (1000), (10000)) t(v)"""),
    "spend_ledger": (spend_ledger, f"""{P}, c as (select model, pass, sample_id, case when output_tokens is not null then (greatest(input_tokens - cached_tokens, 0) * 3.0::double + cached_tokens * 0.3::double + output_tokens * 15.0::double) / 1000000 end as cost from results where (model <> 'm_sub' or output_tokens is not null) and status <> 'unsupported'),
        s as (select model, pass, sample_id, sum(coalesce(cost, 0)) over w as spent, count(*) filter (cost is null) over w as unknown from c window w as (partition by model order by pass, sample_id)) select model, pass, sample_id, round(spent * 10000000)::bigint as spent, unknown, unknown > 0 or spent > 1.0 as blocked from s"""),
    "usage_summary": (usage_summary, f"{P} select model, count(*) as requests, count(*) filter (input_tokens is not null and output_tokens is not null) as with_usage, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cached_tokens)::bigint as cached_tokens, round(count(output_tokens)::double / count(*), 6) as coverage from results group by model"),
    "timing_rollup": (timing_rollup, f"""{P}, o as (select 'request' as metric_name, latency_seconds as value, cache_hit from results union all select 'load', load_duration_seconds, cache_hit from results)
        select metric_name, 'seconds' as unit, case when cache_hit then 'cache' else 'client' end as source, case when value is null then 'not_observed' end as unavailable_reason, count(*) as n, count(value) as measured, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from o group by all"""),
    "throughput": (throughput, """with i as (select user_id % 50 as run, event_id, case when event_id % 997 <> 0 then value end as w, event_id % 40 as t from events), a as (select run, count(*) as invocations, count(w) as timed, sum(w) as wall, max_by(t, event_id) as terminal from i group by 1)
        select run, invocations, terminal, case when timed = invocations then round(wall, 6) end as wall_seconds, case when timed = invocations then round(60.0::double * terminal / nullif(wall, 0), 6) end as samples_per_minute from a"""),
    "run_status": (run_status, f"{P} select model, pass, count(*) as present, count(*) filter (status = 'success') as success, count(*) filter (status = 'error') as error, count(*) filter (status = 'unsupported') as unsupported, (select count(*) from samples) as planned, (select count(*) from samples) - count(*) as missing, round(count(*)::double / (select count(*) from samples), 6) as coverage from results group by model, pass"),
    "latency_stats": (latency_stats, "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(60.0::double * count(value) / nullif(sum(value), 0), 6) as per_minute from events group by 1"),
    "merge_runs": (merge_runs, f"{P} select model || case pass when 1 then '@a' when 2 then '@b' else '@c' end as model, status, count(*) as n from results group by 1, 2"),
    "paired_contingency": (paired_contingency, f"""{SCORED}, one as (select r.model, r.pass, r.sample_id, exact_match from results r join m using (model, sample_id) where status = 'success'), j as (select p.pass, l.exact_match as l, r.exact_match as r from samples s cross join passes p left join one l on l.sample_id = s.sample_id and l.pass = p.pass and l.model = 'm_exact' left join one r on r.sample_id = s.sample_id and r.pass = p.pass and r.model = 'm_drop')
        select pass, count(*) filter (l and r) as both_correct, count(*) filter (l and not r) as left_only, count(*) filter (not l and r) as right_only, count(*) filter (not l and not r) as both_wrong, count(*) filter (l is null or r is null) as missing_pair from j group by pass"""),
    "suite_variability": (suite_variability, CELLS.replace("from conversations", f"from conversations where {_TWICE}") + " select track, model, count(*) as passes, round(avg(corpus_cer), 6) as mean_cer, round(stddev_samp(corpus_cer), 6) as stddev_cer, round(min(corpus_cer), 6) as min_cer, round(max(corpus_cer), 6) as max_cer from pass_scores where missing_count = 0 group by all"),
    "condition_pairs": (condition_pairs, f"{CELLS} select a.track, a.model as left_model, b.model as right_model, count(*) as passes, round(avg(b.corpus_cer - a.corpus_cer), 6) as mean_difference from pass_scores a join pass_scores b on a.track = b.track and a.pass = b.pass and a.model < b.model where a.missing_count < a.eligible_sample_count and b.missing_count < b.eligible_sample_count group by all"),
    "threshold_sweep": (threshold_sweep, f"""{SCORED}, one as (select r.model, m.* exclude (model, sample_id) from results r join m using (model, sample_id) where status = 'success')
        select model, t as threshold, count(*) as n, count(*) filter (exact_match) as exact, sum(char_edits)::bigint as char_edits, sum(reference_chars)::bigint as reference_chars, round(sum(char_edits)::double / sum(reference_chars), 6) as cer from one join (values (0), (100), (200), (400), (800)) v(t) on reference_chars >= t group by all"""),
    "overlapping_subgroups": (overlapping_subgroups, f"""{SCORED}, one as (select r.model, r.sample_id, m.exact_match, reference_chars, char_edits::double / reference_chars as cer from results r join m using (model, sample_id) where status = 'success'),
        g as (select 'long' as subgroup, * from one where reference_chars >= 400 union all select 'wrong', * from one where not exact_match union all select 'even', * from one where sample_id % 2 = 0) select subgroup, model, count(*) as n, count(*) filter (exact_match) as exact, round(avg(cer), 6) as mean_cer from g group by all"""),
    "nearest_rank_p95": (nearest_rank_p95, f"{P} select model, pass, quantile_disc(latency_seconds, 0.95) as nearest_rank from results where not cache_hit group by all"),
    "worst_n": (worst_n, f"{SCORED}, one as (select r.model || '@' || r.pass as model, r.sample_id, r.status, char_edits::double / reference_chars as cer from results r left join m on m.model = r.model and m.sample_id = r.sample_id and r.status = 'success') select model, sample_id, status, round(cer, 6) as cer from one order by status = 'success', coalesce(one.cer, -1) desc, model, sample_id limit 25"),
    "review_queue": (review_queue, f"{P} select status, turn::integer as turn, model, pass, sample_id from (select *, row_number() over (partition by status order by model, pass, sample_id) as turn from results) order by turn, status limit 20"),
    "flag_histogram": (flag_histogram, None),
    "missing_results": (missing_results, f"{P} select s.sample_id, m.model, p.pass from samples s cross join models m cross join passes p where not exists (select 1 from results r where r.sample_id = s.sample_id and r.model = m.model and r.pass = p.pass)"),
    "orphan_metadata": (orphan_metadata, "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "full_outer_pairing": (full_outer_pairing, "select coalesce(p.page_id, v.id) as id, case when p.page_id is null then 'missing_image' else 'missing_reference' end as finding from pages p full join (select vec_id * 2 as id from embeddings) v on v.id = p.page_id where p.page_id is null or v.id is null"),
    "reference_override": (reference_override, "select doc_id, case when doc_id % 8 = 0 then source else lang end as value, doc_id % 8 = 0 as overridden from documents"),
    "constraint_violations": (constraint_violations, f"""{P}, p as (select model, pass, sample_id, 'ok' as kind from results union all select upper(model) || ' ', pass, sample_id, 'ok' from results where sample_id % 101 = 0 union all select model, pass, -1 - sample_id, 'ok' from results where sample_id % 97 = 0
            union all select 'm_other', pass, sample_id, 'ok' from results where sample_id % 89 = 0 and model = 'm_sub' union all select model, pass + 7, sample_id, 'differs' from results where sample_id % 83 = 0), s as (select sample_id, case when sample_id % 71 = 0 then 2 else 1 end as times from samples where sample_id % 79 <> 0)
        select 'duplicate_result' as "check", count(*) as n from (select 1 from p group by model, pass, sample_id having count(*) > 1) union all select 'unknown_sample', count(*) from p where sample_id not in (select sample_id from s) union all select 'pass_out_of_plan', count(*) from p where pass not between 1 and 2
        union all select 'reference_mismatch', coalesce(sum(times), 0)::bigint from p join s using (sample_id) where kind = 'differs' union all select 'duplicate_sample', count(*) from s where times > 1"""),
    "same_roster": (same_roster, f"{P} select model || '@' || pass as model, count(distinct sample_id) as samples, sum(('0x' || substr(md5(sample_id::varchar), 1, 8))::bigint)::bigint as checksum from results group by 1"),
    "critical_expressions": (critical_expressions, f"{_CRIT} select * from cs"),
    "reading_order": (reading_order, f"{_ANN}, o as (select sample_id, model, case when w[1] is null or w[2] is null then 'not_annotated' when a <> '' and b <> '' and {_fine('r')} then 'scored' else 'error' end as status, {_fine('p')} as ok from ab) select sample_id, model, status, case when status = 'scored' then ok end as passed from o"),
    "task_metric_rollup": (task_metric_rollup, f"{_CRIT} select model, count(*) filter (status = 'scored') as scored, count(*) filter (status = 'error') as error, count(*) filter (status = 'not_annotated') as not_annotated, count(*) as n, sum(passed)::bigint as passed, sum(total)::bigint as total, round(count(*) filter (status = 'scored')::double / count(*), 6) as coverage, round(sum(passed)::double / sum(total), 6) as accuracy from cs group by model"),
    "repeated_text": (repeated_text, f"""with w as (select doc_id, string_split({norm('text')}, ' ') as w from documents)
        select doc_id, len(list_filter(range(1, len(w)), lambda i: (i + 2 <= len(w) and w[i] = w[i + 1] and w[i] = w[i + 2]) or len(list_filter(range(2, 8), lambda n: i + 2 * n - 1 <= len(w) and w[i:i + n - 1] = w[i + n:i + 2 * n - 1])) > 0)) > 0 as repeated from w"""),
    "commentary_flags": (commentary_flags, r"""select doc_id, contains(text, '```') or regexp_matches(text, '\bhere(?:''s| is) (?:the )?(?:transcription|text)\b|\btranscription\s*:', 'i') or regexp_matches(text, '\bthe image (?:shows|contains|depicts)\b', 'i') or regexp_matches(text, '\bthe handwriting (?:says|reads)\b', 'i') or regexp_matches(text, '\b(?:i think|i can see|it appears to be)\b', 'i') as commentary from documents"""),
    "label_audit": (label_audit, r"""with d as (select doc_id, doc_id % 13 as m, text || case when doc_id % 13 < 7 then [' {a{b}}', ' }{', ' x^{2', ' $y', ' TODO', chr(1), ' e' || chr(769)][doc_id % 13 + 1] else '' end as text from documents)
        select doc_id, array_to_string(list_filter([case when trim(text) = '' then 'empty_reference' end, case when nfc_normalize(text) <> text then 'non_nfc_unicode' end, case when regexp_matches(text, '[\x00-\x08\x0b-\x1f]') then 'control_character' end, case when regexp_matches(text, '\x{FFFD}|\b(?:TODO|TBD|UNREADABLE|ILLEGIBLE)\b') then 'unresolved_label' end,
        case when m in (1, 2) then 'unbalanced_latex_braces' end, case when doc_id % 9 <> 0 and (length(text) - length(replace(text, '$', ''))) % 2 = 1 then 'unbalanced_inline_math' end, case when doc_id % 9 = 0 then 'unknown_content_type' end], lambda x: x is not null), ',') as issues from d"""),
    "csv_guard": (csv_guard, "select doc_id, case when doc_id % 6 < 5 then '''' else '' end || ['=', ' +', '-', chr(65279) || '@', chr(9) || '=', 'a='][doc_id % 6 + 1] || text as guarded from documents"),
    "row_fingerprint": (row_fingerprint, "select doc_id, sha256(concat_ws('|', 'v1', doc_id, lang, source, sha256(text))) as fingerprint from documents"),
    "snapshot_fingerprint": (snapshot_fingerprint, "select count(*) as n, sha256(sum(('0x' || substr(sha256(concat_ws('|', 'v1', doc_id, lang, source, sha256(text))), 1, 15))::bigint)::varchar) as fingerprint from documents"),
}
