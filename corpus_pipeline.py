"""From documents to packed sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next one's docs. All but the last return the columns of documents; other columns are left behind.

Defined results: an empty table gives no row in every stage. A null or empty text has no words, so the quality rules
reject it; a stage that gets one anyway keeps it, but for language ID, which rejects what has no letter. Rows with a
null doc_id pass every stage like others; near duplicates keep the named one of a group. Equal rows are duplicates of
each other, of which one stays. Ties among near duplicates go to the least doc_id. Texts of any length go whole.
The folder of the run stays in the shared one, since the result is read from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import language_id, packing, quality_rules, secret_scan, simhash
from glyphmill.plans.cut import shared_folder

STAGES = [
    ("quality rules", quality_rules.stage),
    ("language id", language_id.stage),
    ("near duplicates", simhash.stage),
    ("secret scans", secret_scan.stage),
    ("packing", packing.stage),
]

#: Language ID and packing have no SQL. tests/llm/test_pipeline.py holds each stage and the whole run against a plain
#: version, by value.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
