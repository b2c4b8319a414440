"""A corpus pipeline of five stages over documents: filter by rules, filter by classifier, deduplicate lines, deduplicate documents, pack.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.

Defined cases: documents with a null or empty text have no words and go with the first stage; rows without id are told
apart by their texts, and go before others only as bad or as copies; rows that repeat are near duplicates of each other,
so one stays, that of the smallest id; lines that come again keep their first place in the order of ids; an empty table
runs through and packs to no pieces. Columns beside id and text pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession

from terrella.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from terrella.llm.common import materialise
from terrella.llm.queries import WORD_TOKENIZER
from terrella.session import batch_bytes, ship

#: Bytes of one Arrow batch. The stages share executors, whose memory of a batch, and of what is counted in it, adds up over the stages.
BATCH_BYTES = 1 << 19
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with batch_bytes(BATCH_BYTES):
            ship(spark)
            return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_small_batches
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs, quality_rules.fit(docs, _labels(spark, sf_dir)))


@_small_batches
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stats = materialise(quality_classifier.statistics(docs), "docstats")
    return quality_classifier.keep_documents(docs, quality_classifier.fit(stats, _labels(spark, sf_dir)))


@_small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


@_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, P.path(WORD_TOKENIZER))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("packing", pack)]
#: Trained models and MinHash bands cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
