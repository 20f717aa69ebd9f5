"""One registered query per operator, on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import audit, decontaminate, divergence, jaccard, language, mixing, passages, scoring, sharding, tokens, topk, url_filter, wrappers
from lapsewise.llm.common import read
from lapsewise.llm.oracle import ORACLE
from lapsewise.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

__all__ = ["ORACLE", "QUERIES"]

URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]
SHARDS = [f"shard-{n:02d}" for n in range(64)]


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    prepared.__name__ = fn.__name__
    QUERIES[fn.__name__] = prepared
    return fn


@query
def op1_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, folder, "pages"), rules)


@query
def op2_lm_scoring(spark, folder):
    return scoring.score(read(spark, folder, "documents"))


@query
def op3_language_id(spark, folder):
    found = language.identify(read(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_top_k(spark, folder):
    vectors = topk.quantized(read(spark, folder, "embeddings"), "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query
def op5_token_ids(spark, folder):
    return tokens.token_digests(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_substring_dedup(spark, folder):
    cleaned = passages.remove_repeats(read(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_sharding(spark, folder):
    placed = sharding.place(read(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


@query
def op8_mixing(spark, folder):
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op9_jaccard_join(spark, folder):
    return jaccard.similar_groups(read(spark, folder, "documents"))


@query
def op10_decontamination(spark, folder):
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op11_filter_audit(spark, folder):
    return audit.audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op13_source_divergence(spark, folder):
    return divergence.divergence(read(spark, folder, "documents"))


@query
def op12_html_extraction(spark, folder):
    return wrappers.extract(read(spark, folder, "pages"))
