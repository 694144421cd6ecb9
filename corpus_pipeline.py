"""The corpus pipeline: quality, near duplicates, benchmarks, personal data, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows that the stage before kept and returns a DataFrame.  All but
the last return the columns of ``documents``; the last returns packed token
ids.  ``run`` writes each stage's rows as Parquet into the shared folder and
reads them back as the next one's input, so a stage can be run again by
itself and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, ngram_join, pii, quality
from tessera.llm._io import materialise, table
from tessera.llm.registry import pii_key, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id."""
    return ngram_join.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced."""
    return pii.without_pii(docs, pii_key(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and packed ids."""
    return bpe.encode(docs, *tokenizer())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("pii", surrogates),
    ("byte_bpe", token_ids),
]

#: Classifier, similarity classes, permutations and BPE can't be said in SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
