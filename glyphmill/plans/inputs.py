"""Queries over streams, pages, sinks and equations, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphmill.functions import equations
from glyphmill.plans.cut import shared_folder
from glyphmill.plans.scores import _round
from glyphmill.sources import readers, sinks
from glyphmill.streaming import attempts, ordered


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_attempt_pairing(spark, sf_dir):
    return attempts.drained(attempts.pairing(attempts.log(spark, sf_dir)), "complete", _folder(spark))


def stream_window_latency(spark, sf_dir):
    return _round(ordered.drained(attempts.windows(attempts.log(spark, sf_dir)), _folder(spark), ("start",)))


def stream_dedup(spark, sf_dir):
    return attempts.drained(attempts.once(attempts.log(spark, sf_dir)), "append", _folder(spark)).select("event_id", "user_id", "event_type")


def page_text(spark, sf_dir):
    return readers.page_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def overflow_chunks(spark, sf_dir):
    return sinks.overflow_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 2000)


def equation_equivalence(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = F.col("p_size").cast("string")
    left = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(x+"), s, F.lit(")^2"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x*"), s)).otherwise(F.lit("x^2"))
    right = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x^2+2*"), s, F.lit("*x+"), s, F.lit("^2"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x+"), s)).otherwise(F.lit("x"))
    domain = F.create_map(F.lit("x"), F.array(F.lit(0.0), F.lit(1.0)))
    return p.select("p_partkey", equations.equivalence(left, right, domain).alias("e")).select("p_partkey", "e.status", "e.reason")


#: Pairs of expressions over a part's size s, with what is true of them; x is one of -1, 0, 1 and 2, and y is 3.
SHAPES = [
    ("(x+s)*(x-s)", "x^2-s^2", "equivalent", "same_exact_polynomial"),
    ("(x+y)^2", "x^2+2*x*y+y^2", "equivalent", "same_exact_polynomial"),
    ("(s*x+s)/s", "x+1", "equivalent", "same_exact_polynomial"),
    ("-(x-y)", "y-x", "equivalent", "same_exact_polynomial"),
    ("s/x", "s/x", "equivalent", "same_normalized_expression"),
    ("x^-1", "1/x", "undetermined", "no_counterexample_found"),
    ("x/0", "x/0", "undetermined", "division by zero"),
    ("x*s", "x*s+1", "different", "numeric_counterexample"),
    ("1/x", "x", "different", "numeric_counterexample"),
    ("x^3-x", "0", "different", "numeric_counterexample"),
    ("y^s", "y^s+z", "undetermined", "domain_missing"),
    ("x^13", "x^13+1", "undetermined", "no_counterexample_found"),
    ("s+", "s", "undetermined", "not arithmetic"),
    ("f(x)", "x", "undetermined", "unsupported expression"),
    ("----------------------------------x", "x", "undetermined", "expression too deep"),
    ("1000000000000000000*x", "x", "different", "numeric_counterexample"),
    (" ", "x", "undetermined", "empty_expression"),
]


def equation_shapes(spark, sf_dir):
    shapes = spark.createDataFrame([(i, left, right) for i, (left, right, _, _) in enumerate(SHAPES)], "shape int, l string, r string")
    domain = F.create_map(F.lit("x"), F.array(*[F.lit(float(v)) for v in (-1, 0, 1, 2)]), F.lit("y"), F.array(F.lit(3.0)))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("shape", (F.col("p_partkey") % len(SHAPES)).cast("int")).join(F.broadcast(shapes), "shape")
    said = lambda c: F.replace(c, F.lit("s"), F.col("p_size").cast("string"))
    return p.select("p_partkey", equations.equivalence(said(F.col("l")), said(F.col("r")), domain).alias("e")).select("p_partkey", "e.status", "e.reason")


QUERIES = {
    "equation_shapes": (equation_shapes, f"select p_partkey, status, reason from part join (values {', '.join(f"({i}, '{s}', '{r}')" for i, (_, _, s, r) in enumerate(SHAPES))}) v(i, status, reason) on p_partkey % {len(SHAPES)} = i"),
    "stream_attempt_pairing": (stream_attempt_pairing, "select user_id, count(*) filter (event_type = 'click') as starts, count(*) filter (event_type <> 'click') as finishes, count(*) filter (event_type = 'error') as failed, greatest(count(*) filter (event_type = 'click') - count(*) filter (event_type <> 'click'), 0) as uncertain from events group by 1"),
    "stream_window_latency": (stream_window_latency, "select date_trunc('hour', ts) as start, count(*) as n, count(*) filter (event_type = 'error') as errors, round(sum(value) / count(*), 6) as mean_latency from events where event_type <> 'click' group by 1"),
    "stream_dedup": (stream_dedup, "select distinct event_id, user_id, event_type from events"),
    "page_text": (page_text, r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title,
        trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages"""),
    "overflow_chunks": (overflow_chunks, "select doc_id, i::integer as piece, substr(text, i * 2000 + 1, 2000) as text from (select doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) as i from documents where length(text) > 2000)"),
    "equation_equivalence": (equation_equivalence, "select p_partkey, case p_partkey % 3 when 0 then 'equivalent' when 1 then 'different' else 'undetermined' end as status, case p_partkey % 3 when 0 then 'same_exact_polynomial' when 1 then 'numeric_counterexample' else 'no_counterexample_found' end as reason from part"),
}
