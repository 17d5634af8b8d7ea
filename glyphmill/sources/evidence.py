"""The evaluation's relations derived from the test tables, by one SQL text that Spark and DuckDB read alike.

Each turn of a conversation is a sample with its whole text as the reference. Three systems make predictions in
three passes: one copies, one changes a letter, one drops a word. Some results are missing, failed or unsupported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = """
select conv_id * 1000 + turn as sample_id, text as reference,
  case when role = 'system' then 'equation' when role = 'assistant' and turn % 4 = 3 then 'word' else 'prose' end as content_type,
  conv_id as source_document, conv_id % 7 as writer_id,
  case conv_id % 10 when 0 then 'train' when 1 then 'validation' else 'test' end as split,
  case (conv_id + turn) % 5 when 0 then 'unverified' when 1 then null else 'verified' end as verification_status,
  case when length(text) < 100 then 'easy' when length(text) < 400 then 'medium' else 'hard' end as difficulty
from conversations
"""

MODELS = "select * from (values ('m_exact', 0), ('m_sub', 1), ('m_drop', 2)) as t(model, ord)"
PASSES = "select * from (values (1), (2), (3)) as t(pass)"

RESULTS = """
select model, ord, pass, sample_id, content_type, source_document, reference, status,
  case when status = 'success' then (case model when 'm_exact' then reference when 'm_sub' then replace(reference, 'e', 'c') else replace(reference, ' the ', ' ') end) end as prediction,
  sample_id % 13 = 0 as cache_hit, sample_id % 31 = 0 as truncated,
  cast((sample_id * 31 + pass * 17 + ord * 7) % 997 as double) / 1000 + cast(ord as double) / 100 as latency_seconds,
  case when sample_id % 17 = 0 then cast((sample_id % 50 + 1) as double) / 10 end as load_duration_seconds,
  length(reference) % 500 + 50 as input_tokens, case when sample_id % 11 <> 0 then length(reference) % 300 + 1 end as output_tokens,
  (length(reference) % 500 + 50) % 40 as cached_tokens
from (
  select m.model, m.ord, p.pass, s.sample_id, s.content_type, s.source_document, s.reference,
    case when m.model = 'm_drop' and s.content_type = 'equation' then 'unsupported' when (s.sample_id * 7 + p.pass) % 23 = 0 then 'error' else 'success' end as status
  from samples s cross join models m cross join passes p
  where (s.sample_id + 3 * p.pass) % 29 <> 0) as planned
"""

#: For DuckDB: the relations as common table expressions, to which a query's own are added.
PRELUDE = f"with recursive samples as ({SAMPLES}), models as ({MODELS}), passes as ({PASSES}), results as ({RESULTS})"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES.replace("from conversations", "from {conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def models(spark: SparkSession) -> DataFrame:
    return spark.sql(MODELS)


def passes(spark: SparkSession) -> DataFrame:
    return spark.sql(PASSES)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(samples(spark, sf_dir))


def results_of(samples: DataFrame) -> DataFrame:
    """Results lie where their samples do, those of a sample side by side: models and passes are broadcast."""
    spark = samples.sparkSession
    text = RESULTS.replace("from samples s cross join models m cross join passes p", "from {samples} s cross join {models} m cross join {passes} p")
    return spark.sql(text, samples=samples, models=F.broadcast(models(spark)), passes=F.broadcast(passes(spark)))
