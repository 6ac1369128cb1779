"""The corpus pipeline: from crawled documents to packed training sequences.

Each stage takes what its predecessor kept; run() writes nothing itself, so a driver may
write each stage's rows and hand them to the next, as the stages' contract has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact, neighbours, packing, similar, surrogates
from quadrille.llm.common import Written
from quadrille.llm.queries import PII_KEY, TOKENIZERS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes take for good ones."""
    space = neighbours.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return neighbours.score(docs, space, score_col="__score").where(F.col("__score") >= 0.7).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return similar.drop_similar(docs, width=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace(docs, PII_KEY, count_col=None, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json", capacity=2048)


STAGES = [("quality", quality), ("exact", exact_dedup), ("near", near_dedup), ("pii", private), ("pack", packed)]

#: Neighbours' votes and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Written(spark)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
