"""Input tables of the registered queries under the names the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.operators.sizing import spread
from tessellex.plans.statutes import statutes as statute_view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``chunk_id``."""
    return spread(table(spark, sf_dir, "documents")).withColumn("chunk_id", F.col("doc_id"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean vector of the label."""
    cells = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return (
        means.groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))
        .select(
            F.col("label").cast("bigint").alias("query_id"),
            F.transform("cells", lambda c: c["v"]).alias("embedding"),
        )
    )


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(statute_view(spark, sf_dir))
