"""From raw documents to token ids: five stages, each on all that the one before has kept.

Every stage takes nulls in any column, empty texts, repeated rows, empty tables and columns of any
name; what it does with them stands with it. The first four return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapsewise.llm import decontaminate, jaccard, language, mixing, tokens
from lapsewise.session import configure, freeze

#: Stages learn, group, weigh and encode in ways that SQL does not express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable main language go: null texts, texts without a letter, jumbles
    of many languages. Repeated rows are judged alike."""
    return language.keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays, a null id last;
    repeated rows stay once, texts without words all by their ids."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null texts hold none."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, 0 to 2 times; a null source is one."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in the compressed binary table, and what its files say of every row; a null text has the end
    id alone."""
    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _configured(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


STAGES = [
    (stage.__name__, _configured(stage))
    for stage in (language_id, jaccard_join, decontamination, mix_sources, token_ids)
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
