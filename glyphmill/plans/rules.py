"""Queries over rules about models, requests and settings, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import policies
from glyphmill.plans.scores import P, _round
from glyphmill.sources import evidence as e


def model_support(spark, sf_dir):
    c = spark.createDataFrame([("m_exact", None, None, None), ("m_sub", ["Prose"], None, None), ("m_drop", None, ["equation"], None), ("m_other", None, None, False)], "model string, allowed array<string>, denied array<string>, equations boolean")
    return policies.supported(c, e.samples(spark, sf_dir).select(F.col("content_type").alias("track")).distinct())


def selector_parse(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", policies.provider(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("API:"), "s_name")).otherwise(F.col("s_name"))).alias("p")).select("s_suppkey", "p.*")


def retry_classes(spark, sf_dir):
    code = F.element_at(F.array(F.lit(200), F.lit(429), F.lit(500), F.lit(404), F.lit(503), F.lit(None).cast("int")), (F.col("event_id") % 6 + 1).cast("int"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", policies.retry(code, F.when(F.col("event_id") % 4 == 1, 1.0)).alias("outcome"))
    return ev.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


def layered_settings(spark, sf_dir):
    """Suppliers as models: two options each, and for one in three a condition that changes one of them and adds another."""
    k = F.col("s_suppkey")
    m = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, F.col("s_name").alias("model"), F.col("s_nationkey").cast("string").alias("n"))
    g = m.select("model", F.create_map(F.lit("temperature"), "n", F.lit("tokens"), F.lit("512")).alias("options"))
    s = m.where(k % 3 == 0).select("model", F.create_map(F.lit("tokens"), k.cast("string"), F.lit("seed"), F.lit("1")).alias("options"))
    gone = m.where(k % 10 == 1).select(F.concat(F.lit("gone "), "model").alias("model"), F.create_map(F.lit("x"), F.lit("y")).alias("options"))
    return policies.settings(g, s.union(gone)).select("model", F.explode("options").alias("option", "value"))


def pixel_filter(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 60).cast("int").alias("h"))
    return policies.large_enough(p, "w", "h", 500)


def cache_keys(spark, sf_dir):
    r = e.results(spark, sf_dir).select("model", "pass", "sample_id", F.sha2(F.col("reference").cast("binary"), 256).alias("content"), "output_tokens", "cache_hit")
    return policies.cache_key(r, ["model", "content", "output_tokens"], "cache_hit").select("model", "pass", "sample_id", "bypass", "key")


def unique_labels(spark, sf_dir):
    return policies.unique_labels(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_custkey")


def running_progress(spark, sf_dir):
    return _round(policies.progress(e.results(spark, sf_dir), 2000).withColumn("eta_seconds", F.round(F.col("eta_seconds") + 1e-7, 3)))


def preview(spark, sf_dir):
    return policies.preview(e.samples(spark, sf_dir))


QUERIES = {
    "model_support": (model_support, f"""{P}, c as (select * from (values ('m_exact'), ('m_sub'), ('m_drop'), ('m_other')) v(model)), t as (select distinct content_type as track from samples)
        select model, track, case when model = 'm_sub' and track <> 'prose' or model in ('m_drop', 'm_other') and track = 'equation' then 'model_does_not_support_task' end as reason from c cross join t"""),
    "selector_parse": (selector_parse, "select s_suppkey, case when s_suppkey % 2 = 0 then 'api' else 'local' end as provider, s_name as model from supplier"),
    "retry_classes": (retry_classes, "select event_type, case when event_id % 6 in (2, 4, 5) then 'retry' when event_id % 6 = 1 and event_id % 4 = 1 then 'wait' else 'permanent' end as outcome, count(*) as n from events group by all"),
    "layered_settings": (layered_settings, """select s_name as model, 'temperature' as option, s_nationkey::varchar as value from supplier union all
        select s_name, 'tokens', case when s_suppkey % 3 = 0 then s_suppkey::varchar else '512' end from supplier union all select s_name, 'seed', '1' from supplier where s_suppkey % 3 = 0"""),
    "pixel_filter": (pixel_filter, "select p_partkey, p_size as w, (p_partkey % 60)::int as h, p_size::bigint * (p_partkey % 60) as pixels, p_size::bigint * (p_partkey % 60) >= 500 as kept from part"),
    "cache_keys": (cache_keys, f"{P} select model, pass, sample_id, case when cache_hit then 'repeated_measurement' when output_tokens is null then 'missing_output_tokens' end as bypass, case when not cache_hit and output_tokens is not null then sha256(concat_ws('|', model, sha256(reference), output_tokens)) end as key from results"),
    "unique_labels": (unique_labels, "select c_custkey, case when n = 1 then c_mktsegment else c_mktsegment || '-' || n end as unique_label from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer)"),
    "running_progress": (running_progress, f"{P}, w as (select model, pass, sample_id, row_number() over o as done, sum(latency_seconds) over o as seconds from results window o as (partition by model order by pass, sample_id)) select model, pass, sample_id, done, round(seconds, 6) as seconds, round(seconds / done * greatest(2000 - done, 0) + 1e-7, 3) as eta_seconds from w"),
    "preview": (preview, f"{P} select coalesce(verification_status, 'unknown') as verification_status, count(*) as n from samples group by 1"),
}
