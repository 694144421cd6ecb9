"""The queries of this package, by the names that the entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, fingerprint, html_text, lm_score, ngram_join, pii, quality, secrets, shards
from tessera.llm._io import table


def tokenizer() -> tuple[str, str]:
    """Place and pattern of the public vocabulary that production runs use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Production reads its key from the session; the fixed one serves where none is set.
KEY_SETTING, KEY = "spark.tessera.pii.key", "tessera-surrogates"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_texts(table(spark, sf_dir, "documents"), pii_key(spark))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.pages_text(table(spark, sf_dir, "pages"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.corpus_scores(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.placement(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_html_text": op6_html_text,
    "op7_lm_scores": op7_lm_scores,
    "op8_secrets": op8_secrets,
    "op9_fingerprints": op9_fingerprints,
    "op10_shards": op10_shards,
}

ORACLE_SQL: dict[str, str] = {"op7_lm_scores": lm_score.oracle()}
