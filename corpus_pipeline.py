"""Pipeline from raw documents to token ids: filter, deduplicate, mix, encode.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, and returns documents
with all their columns; the last returns one row per copy in the mix with its ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tessellex.llm.common import use_checkpoints
from tessellex.plans.registry import ship_package

#: Documents with this score or more go.
TOXIC_FROM = 0.5
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: Distinct pre-tokens that a worker keeps encoded; the other stages of a session share the worker's memory.
KEPT_TOKENS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from ``labels`` doesn't call toxic."""
    ship_package(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, row=True).where(F.col("score") < TOXIC_FROM).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship_package(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, k=SHINGLE, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source, in a global random order."""
    ship_package(spark)
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy, and whether they decode to its text."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    named = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    carried = named.select(F.struct("doc_id", "lang", "source", "n_chars", "_text_sha").alias("row"), "text")
    coded = bpe.decode(bpe.encode(carried, ranks, public_tokenizers.PATTERN, id_col="row", cache=KEPT_TOKENS), ranks)
    return coded.select(
        "row.doc_id", "row.lang", "row.source", "row.n_chars", "n_tokens", "ids",
        (F.sha2("decoded", 256) == F.col("row._text_sha")).alias("decoded_equal"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("poisson_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

#: The learned filter can't be expressed in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    use_checkpoints(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return docs
