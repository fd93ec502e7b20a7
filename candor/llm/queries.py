"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, langid, lm, media, orc_tokens, packing, quality, secrets, sharding
from .store import few_files
from .units import tune


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nnls_packing(spark, sf_dir):
    return packing.pack(packing.pieces(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op2_ring_sharding(spark, sf_dir):
    return sharding.shard(_documents(spark, sf_dir))


def op3_tree_bpe(spark, sf_dir):
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_quality(spark, sf_dir):
    return quality.judge(_documents(spark, sf_dir))


def op5_tar_media(spark, sf_dir):
    return media.features(*media.store(_documents(spark, sf_dir)))


def op6_secret_scan(spark, sf_dir):
    return secrets.report(_documents(spark, sf_dir))


def op7_orc_tokens(spark, sf_dir):
    path = orc_tokens.write(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return orc_tokens.checked(orc_tokens.read(spark, path))


def op8_lbl_score(spark, sf_dir):
    return lm.score(_documents(spark, sf_dir))


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.groups(few_files(_documents(spark, sf_dir)), n=3, t=90)


def op10_crf_langid(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


QUERIES = {f.__name__: f for f in (op1_nnls_packing, op2_ring_sharding, op3_tree_bpe, op4_line_quality, op5_tar_media, op6_secret_scan, op7_orc_tokens, op8_lbl_score, op9_ngram_jaccard, op10_crf_langid)}
ORACLES: dict[str, str] = {}
