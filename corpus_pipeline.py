"""A corpus pipeline over `documents`: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glasspane.llm import common, decontaminate, langid, secrets, sentencepiece_codec, simhash

STAGES = [
    ("language_id", langid.stage_language),
    ("simhash_near_dedup", simhash.stage_near_duplicates),
    ("decontamination", decontaminate.stage_decontaminate),
    ("secret_scan", secrets.stage_redact),
    ("sentencepiece", sentencepiece_codec.stage_tokens),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.settle(docs, f"pipeline-{name}")
    return docs
