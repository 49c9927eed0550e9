"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, byte-level BPE.

Each stage takes all rows that the one before it kept and returns their columns as they came, whatever their names; the
last returns doc_id, ids and n_tokens. Texts that are null or without letters go at the first stage, as no language
claims them. Of rows alike in all columns one stays; of rows that share a doc_id each is judged by its own text; rows
without a doc_id are judged by language, contamination and secrets, and stay at near-dedup, where they can't be told
apart. Of near copies the row with the smallest doc_id stays, then that with the smallest hash of its columns. Very
long texts are taken whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cupola.llm import bpe, decontaminate, langid, secrets, simhash
from cupola.llm.common import stored, table

#: (name, function): each function takes (spark, docs, sf_dir) and works on all that the one before it kept.
STAGES = [
    ("language_id", langid.stage),
    ("near_dedup_by_resemblance", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scan", secrets.stage),
    ("byte_bpe", bpe.stage),
]

#: Rows that Spark sends to a worker at once, at most: texts may be long, and a worker shares its executor's memory.
SENT = 1024

#: The stages learn a model, follow chains of links and encode by merge ranks, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of documents, each stage's result written and read again."""
    docs, setting = table(spark, sf_dir, "documents"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(SENT, int(before)) if int(before) > 0 else SENT)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(setting, before)
    return docs
