"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

quality   lines that fail the rules go, documents that lose too much text or fail the base rules go
language  documents of no known language, or mixed beyond recognition, go
near_dup  of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays
secrets   secrets are replaced by a mask, all documents stay
packing   the ids of all documents in sequences of 2048

All stages but the last return the columns of documents. Nulls, empty texts and tables are handled as each
operator says: empty texts and null texts fail the base rules; a null doc_id is never a copy of anything.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from candor.llm import jaccard, langid, packing, quality, secrets
from candor.llm.store import few_files, settle, written
from candor.llm.units import tune

#: Least mean posterior of a document's language.
LEAST_SCORE = 0.5
#: Bytes of an Arrow batch: five stages share the memory of one set of executors, so it is small.
BATCH = "4m"

#: No SQL expresses the field model, the components or the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def _begin(spark: SparkSession) -> None:
    tune(spark, BATCH)
    settle(spark)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return quality.clean(few_files(docs))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return langid.keep_known(few_files(docs), langid.train(docs), LEAST_SCORE)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return jaccard.one_of_each(few_files(docs), n=5, t=80)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return secrets.redact(few_files(docs))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return packing.pack(packing.pieces(few_files(docs), public_tokenizers.path("word_bpe_49k.json"), slice_bytes=2 << 20, kept=150_000))


STAGES = [
    ("quality", stage_quality),
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
