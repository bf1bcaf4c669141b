"""A corpus from raw documents: language ID, quality rules, near-dedup, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, whatever further ones these have and however they are called.

No stage moves texts between tasks: they decide on measures, fingerprints and sizes, and decisions go to where the texts are.

Null, empty and letterless texts go in the first stage, texts of under ten words in the second; null languages don't teach; null languages and
sources are groups of their own; null ids are ids like any other, last in order. Texts of any length are read whole. Of rows that repeat, also under one
id, the third stage keeps one. Ties are as each operator's module says. Empty documents give no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandsift.llm import langid, mixing, packing, quality, simhash
from strandsift.llm.common import materialise
from strandsift.plans.planner import spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage learns a model, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
