"""Fusion of ranked candidate lists.

Inputs are already cut to a few candidates per query, so every step here moves
little data; payload columns join after the cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators.topk import top_k


def reciprocal_rank_fusion(
    lists: list[DataFrame], k: int = 10, rrf_k: int = fv.RRF_K
) -> DataFrame:
    """Sum of ``1 / (rrf_k + rank)`` over the lists; ties keep first-seen order."""
    parts = [
        df.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no"))
        for i, df in enumerate(lists)
    ]
    fused = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_id", "chunk_id")
        .agg(
            F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("raw"),
            F.min(F.struct("list_no", "rank")).alias("seen"),
        )
        .withColumn("score", tx.fixed(F.col("raw"), 6))
    )
    ranked = top_k(fused, ["query_id"], [tx.fixed(F.col("raw"), 12).desc(), F.col("seen")], k)
    return ranked.select(
        "query_id", "chunk_id", "score", "rank", F.lit("rrf_hybrid").alias("retrieval_method")
    )


def weighted_fusion(
    dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = fv.FUSION_ALPHA
) -> DataFrame:
    """``alpha * dense + (1 - alpha) * sparse``; a missing side scores 0."""
    keys = ["query_id", "chunk_id"]
    left = dense.select(*keys, F.col("score").alias("d"))
    right = sparse.select(*keys, F.col("score").alias("s"))
    zero = F.lit(0.0)
    fused = left.join(right, keys, "full_outer").select(
        *keys,
        tx.fixed(
            F.lit(alpha) * F.coalesce("d", zero) + F.lit(1.0 - alpha) * F.coalesce("s", zero), 4
        ).alias("score"),
    )
    ranked = top_k(fused, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return ranked.withColumn("retrieval_method", F.lit("weighted_hybrid"))
