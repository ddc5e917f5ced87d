"""The registered queries of the corpus operators, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bottomk, chat_collapse, chunk_dedup, decontaminate, langid, masked_tokens, near_dups, packing, pii, pseudo_likelihood, quality, resample, \
    secrets, spelling
from touchline.llm.shared import documents

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.found(docs, pii.learn(docs))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.rendered(documents(spark, sf_dir, "conversations"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.learn(docs, documents(spark, sf_dir, "labels")))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), stretches=True).drop("row_key")


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(documents(spark, sf_dir))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated(documents(spark, sf_dir))


def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return masked_tokens.scored(docs, pseudo_likelihood.learn(docs), TOKENIZER)


def op8_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predicted(docs, langid.learn(docs, langid.public_pieces(PIECES)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), TOKENIZER)


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.fingerprints(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_personal_data, op2_snapshot_collapse, op3_compression_quality, op4_template_decontamination, op5_weighted_minhash,
    op6_chunk_dedup, op7_masked_pseudo_likelihood, op8_segmentation_langid, op9_best_fit_packing, op10_bottom_k_fingerprints,
    op11_spelling_variants, op12_secret_scan, op13_importance_resampling)}
ORACLES: dict[str, str] = {"op2_snapshot_collapse": chat_collapse.ORACLE,
                           "op11_spelling_variants": spelling.ORACLE, "op13_importance_resampling": resample.ORACLE}
