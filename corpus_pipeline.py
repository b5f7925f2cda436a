"""Corpus pipeline: documents -> good, distinct, uncontaminated, mixed
documents -> token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet under the shared checkpoint folder and rereads it as the next
stage's documents.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_signal.llm import decontaminate, mixing, near_dedup, quality_pu, token_files
from cohort_signal.llm.common import materialise, small_batches, unused_name
from cohort_signal.llm.queries import MIX_LEVELS, MIX_WEIGHTS, with_domain

#: Share of the remaining tokens that the mix may use, each document once.
MIX_BUDGET_SHARE = 0.9
#: Similarity in per cent, on shingles of five words, from which on documents are near duplicates.
NEAR_PCT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_pu.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each near-duplicate group."""
    surplus_id = unused_name(docs, "surplus_id")
    surplus = near_dedup.near_duplicates(docs, threshold_pct=NEAR_PCT).filter(~F.col("kept")).select(F.col("doc_id").alias(surplus_id))
    return docs.join(surplus, F.col("doc_id").cast("long") == F.col(surplus_id), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target weights."""
    return mixing.take(docs, mixing.draw(with_domain(docs), MIX_LEVELS, MIX_WEIGHTS, MIX_BUDGET_SHARE, max_epochs=1), max_epochs=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files_with_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("mix", mix), ("tokens", tokens)]

#: The classifier and the tokenizer are not expressible in SQL; tests/llm hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for name, stage in STAGES:
            out = materialise(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
