"""Queries over the roster: eligibility, audits, resampling, with their DuckDB SQL."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import functions as F

from glyphmill.operators import audit, eligibility, neighbours, resample, scoring, splits
from glyphmill.plans.scores import CELLS, SCORED, P, _cells, _dealt, _round
from glyphmill.sources import evidence as e

_BIT = "'0x' || substr(md5({x}), 1, 8)"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def exclusion_reasons(spark, sf_dir):
    return eligibility.exclusions(e.samples(spark, sf_dir)).groupBy("content_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def research_findings(spark, sf_dir):
    return eligibility.findings(e.samples(spark, sf_dir))


def eligibility_summary(spark, sf_dir):
    return eligibility.eligibility_summary(e.samples(spark, sf_dir))


def track_classify(spark, sf_dir):
    return e.samples(spark, sf_dir).select("sample_id", eligibility.kind(F.col("content_type")).alias("kind"), scoring.track(F.col("content_type")).alias("track"), eligibility.split_name(F.col("split")).alias("split"), eligibility.tri_state(F.col("verification_status")).alias("verified"))


def document_id_resolution(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", eligibility.document(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("doc_id")).alias("document"))


def exact_duplicates(spark, sf_dir):
    return audit.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


def split_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "train").when(F.col("doc_id") % 10 == 1, "validation").otherwise("test")).withColumn("digest", F.md5("text"))
    return audit.cross_split_leakage(d, "digest", "split")


def _hashed(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when(i.isin(3, 40), -x).otherwise(x))  # a near copy of every vector
    return v.union(v.select(F.col("vec_id") + 10_000_000, turned)).withColumn("bits", audit.sign_hash("embedding"))


def hamming_lsh_pairs(spark, sf_dir):
    return audit.hamming_pairs(_hashed(spark, sf_dir), "vec_id", "bits")


def hamming_groups(spark, sf_dir):
    copies = _hashed(spark, sf_dir).select("vec_id", "bits")
    copies = copies.union(copies.where("vec_id % 3 = 0").select(F.col("vec_id") + 20_000_000, "bits"))
    return neighbours.groups(copies, "vec_id", "bits", 4).withColumnRenamed("key", "vec_id")


def duplicate_components(spark, sf_dir):
    found = neighbours.groups(_hashed(spark, sf_dir), "vec_id", "bits", audit.HASH_DISTANCE)
    shared = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(shared, "component").select(F.col("key").alias("node"), "component")


def near_text_links(spark, sf_dir):
    """Every item, and four copies that differ by a number, by turns in the one split and the other."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    copies = [b.select(F.col("item_id") + i * 10_000_001, F.concat(F.lit(f"Item {i}.5: "), "text")) for i in range(1, 5)]
    b = reduce(lambda x, y: x.union(y), copies, b).withColumn("split", F.when(F.col("item_id") % 2 == 0, "train").otherwise("test"))
    return _round(audit.near_text_links(b, "item_id", "text", "split"))


def near_text_pairs(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    b = b.union(b.select(F.col("item_id") + 10_000_001, F.concat(F.lit("Item 7.5: "), "text"))).withColumn("split", F.when(F.col("item_id") % 2 == 0, "train").otherwise("test"))
    return audit.near_text_pairs(b, "item_id", "text", "split")


def seeded_subset(spark, sf_dir):
    return audit.seeded_subset(e.samples(spark, sf_dir).select("sample_id", "difficulty"), "sample_id", 50, 42)


def stratified_round_robin(spark, sf_dir):
    return audit.stratified_round_robin(e.samples(spark, sf_dir).select("sample_id", "difficulty"), "sample_id", "difficulty", 30, 42)


def grouped_split(spark, sf_dir):
    s = e.samples(spark, sf_dir).withColumn("writer_id", F.floor(F.col("source_document") / 5))
    return splits.grouped_split(s, {"train": 0.7, "validation": 0.15, "test": 0.15}, 42)


def document_split(spark, sf_dir):
    return splits.grouped_split(e.samples(spark, sf_dir), {"train": 0.8, "validation": 0.1, "test": 0.1}, 7, writers=False)


def paired_difference(spark, sf_dir):
    one = scoring.scored(_dealt(spark, sf_dir).where("pass = 1"))
    return _round(resample.paired_difference(one, "m_exact", "m_sub"))


def joint_bootstrap(spark, sf_dir):
    return _round(resample.joint_bootstrap(_cells(spark, sf_dir)))


_DRAWS = """num as (select source_document, row_number() over (order by source_document) - 1 as place, count(*) over () as n from (select distinct source_document from {of})),
drawn as (select replicate, ('0x' || substr(md5('42|' || replicate || '|' || draw), 1, 8))::bigint % (select max(n) from num) as place from range({reps}) r(replicate), range((select max(n) from num)) d(draw)),
times as (select replicate, source_document, count(*) as times from drawn join num using (place) group by all)"""

_SIGN = "list_reduce(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then (1::ubigint << (64 - i)::ubigint) else 0::ubigint end), lambda a, b: a | b)"
_PAIRS = f"e2 as (select vec_id, embedding from embeddings union all select vec_id + 10000000, list_transform(embedding, lambda x, i: case when i in (4, 41) then -x else x end) from embeddings), v as (select vec_id, {_SIGN} as h from e2), p as (select a.vec_id as left_id, b.vec_id as right_id, bit_count(xor(a.h, b.h))::integer as distance from v a join v b on a.vec_id < b.vec_id where bit_count(xor(a.h, b.h)) <= 4)"

def _greedy(groups, node, ratios, seed):
    """The split that lacks most gets the next group, one by one."""
    order = list(ratios)
    random.Random(seed).shuffle(order)
    lack = [f"(n::double * {ratios[x]}::double - c{i})" for i, x in enumerate(order)]
    pick = f"case when {lack[0]} >= {lack[1]} and {lack[0]} >= {lack[2]} then 0 when {lack[1]} >= {lack[2]} then 1 else 2 end"
    step = f"case when o.at <= 3 then o.at - 1 else {pick} end"
    return f"""{P}, g as ({groups}), s as (select g, count(*) as size from samples join g on g.w = {node} group by g),
        p as (select *, row_number() over (order by md5('{seed}|' || g), g) as place from s),
        o as (select *, row_number() over (order by case when place <= 3 then place else 4 end, case when place > 3 then -size end, place) as at, sum(size) over () as n from p),
        t as (select 0::bigint as at, 0::bigint as c0, 0::bigint as c1, 0::bigint as c2, null::varchar as g, null::int as to_ union all
            select o.at, c0 + case when {step} = 0 then size else 0 end, c1 + case when {step} = 1 then size else 0 end, c2 + case when {step} = 2 then size else 0 end, o.g, {step} from t join o on o.at = t.at + 1)
        select sample_id, g as split_group, ['{"', '".join(order)}'][to_ + 1] as split from samples join g on g.w = {node} join t using (g)"""


QUERIES = {
    "exclusion_reasons": (exclusion_reasons, f"{P} select content_type, case when verification_status = 'unverified' then 'reference_unverified' when split <> 'test' then 'not_test_split' end as reason, count(*) as n from samples group by all"),
    "research_findings": (research_findings, f"""{P} select 'missing_verification_status' as type, sample_id::varchar as subject from samples where verification_status is null union all select 'reference_not_verified', sample_id::varchar from samples where verification_status = 'unverified'
        union all select 'not_test_split', sample_id::varchar from samples where split <> 'test'
        union all select 'document_split_overlap', source_document::varchar from samples group by source_document having count(distinct split) > 1 union all select 'writer_split_overlap', writer_id::varchar from samples group by writer_id having count(distinct split) > 1"""),
    "eligibility_summary": (eligibility_summary, f"""{P} select count(*) as sample_count, count(*) filter (split = 'train') as train_count, count(*) filter (split = 'validation') as validation_count, count(*) filter (split = 'test') as test_count, count(distinct source_document) as source_document_count,
        count(distinct writer_id) as writer_count, count(*) filter (verification_status = 'verified' and split = 'test' and trim(reference) <> '') as eligible_sample_count from samples"""),
    "track_classify": (track_classify, f"{P} select sample_id, content_type as kind, case when content_type = 'equation' then 'equation' else 'prose' end as track, split, case verification_status when 'verified' then true when 'unverified' then false end as verified from samples"),
    "document_id_resolution": (document_id_resolution, "select doc_id, coalesce(case when doc_id % 3 = 0 then lang end, case when doc_id % 2 = 0 then source end, doc_id::varchar) as document from documents"),
    "exact_duplicates": (exact_duplicates, "select sha256(text) as digest, count(*) as copies, min(doc_id) as least from documents group by all having count(*) > 1"),
    "split_overlap": (split_overlap, "select md5(text) as digest, string_agg(distinct s, ',' order by s) as splits, count(distinct s) as n_splits from (select text, case doc_id % 10 when 0 then 'train' when 1 then 'validation' else 'test' end as s from documents) group by 1 having count(distinct s) > 1"),
    "hamming_lsh_pairs": (hamming_lsh_pairs, f"with {_PAIRS} select * from p"),
    "duplicate_components": (duplicate_components, f"with recursive {_PAIRS}, q as (select left_id as u, right_id as v from p union all select right_id, left_id from p), r as (select u, u as v from q union select r.u, q.v from r join q on q.u = r.v) select u as node, min(v) as component from r group by u"),
    "near_text_links": (near_text_links, None),
    "near_text_pairs": (near_text_pairs, None),
    "seeded_subset": (seeded_subset, f"{P} select sample_id, difficulty from samples order by md5('42|' || sample_id), sample_id limit 50"),
    "stratified_round_robin": (stratified_round_robin, f"{P} select sample_id, difficulty, turn::integer as turn from (select sample_id, difficulty, row_number() over (partition by difficulty order by md5('42|' || sample_id), sample_id) as turn from samples) order by turn, difficulty limit 30"),
    "grouped_split": (grouped_split, _greedy("select source_document // 5 as w, min('d' || source_document) as g from samples group by 1", "source_document // 5", {"train": 0.7, "validation": 0.15, "test": 0.15}, 42)),
    "document_split": (document_split, _greedy("select source_document as w, 'd' || source_document as g from samples group by 1", "source_document", {"train": 0.8, "validation": 0.1, "test": 0.1}, 7)),
    "hamming_groups": (hamming_groups, f"""with recursive {_PAIRS}, c as (select vec_id, h from v union all select vec_id + 20000000, h from v where vec_id % 3 = 0), k as (select h, min(vec_id) as class_id from c group by h),
        q as (select a.class_id as u, b.class_id as w from k a join k b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 4), r as (select class_id as u, class_id as w from k union select r.u, q.w from r join q on q.u = r.w), f as (select u as class_id, min(w) as component from r group by 1)
        select vec_id, class_id, component from c join k using (h) join f using (class_id)"""),
    "paired_difference": (paired_difference, f"""{SCORED}, one as (select r.model, r.sample_id, r.source_document, m.char_edits, m.reference_chars from results r join m using (model, sample_id) where pass = 1 and status = 'success'),
        sums as (select a.source_document, sum(a.char_edits) as el, sum(a.reference_chars) as cl, sum(b.char_edits) as er, sum(b.reference_chars) as cr from one a join one b using (sample_id) where a.model = 'm_exact' and b.model = 'm_sub' group by 1),
        {_DRAWS.format(of='sums', reps=1000)}, de as (select replicate, sum(times * er)::double / sum(times * cr) - sum(times * el)::double / sum(times * cl) as delta from times join sums using (source_document) group by 1)
        select 'm_exact' as left_model, 'm_sub' as right_model, (select count(*) from sums) as documents, (select round(sum(er)::double / sum(cr) - sum(el)::double / sum(cl), 6) from sums) as difference, round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high, count(delta) as replicates from de"""),
    "joint_bootstrap": (joint_bootstrap, f"""{CELLS}, sums as (select track, model, pass, source_document, sum(char_edits) as e, sum(reference_chars) as c, count(*) filter (exact_match) as x, count(*) as n from cells where outcome <> 'unsupported' group by all),
        {_DRAWS.format(of='cells', reps=250)}, dr as (select track, model, pass, replicate, 100.0::double * (0.95::double * greatest(0::double, 1 - sum(times * e)::double / sum(times * c)) + 0.05::double * (sum(times * x)::double / sum(times * sums.n))) as score from times join sums using (source_document) group by all),
        sc as (select track, model, replicate, avg(score) as score from dr group by all) select track, model, round(quantile_cont(score, 0.025), 6) as ci_low, round(quantile_cont(score, 0.975), 6) as ci_high, count(score) as replicates from sc group by all"""),
}
