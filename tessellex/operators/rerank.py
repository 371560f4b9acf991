"""Second-stage ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.functions import text as tx
from tessellex.operators.sizing import pick_rows
from tessellex.operators.topk import top_k


def pass_through(candidates: DataFrame, n: int) -> DataFrame:
    """Sort by score, cut at ``n``; equal scores keep their earlier order."""
    ranked = top_k(
        candidates.withColumnRenamed("rank", "earlier"),
        ["query_id"],
        [F.col("score").desc(), F.col("earlier"), F.col("chunk_id")],
        n,
    )
    return ranked.drop("earlier").withColumn("retrieval_method", F.lit("api_hybrid_pass_through"))


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    scorer: Callable[[Column, Column], Column],
    n: int,
    method: str = "rerank",
) -> DataFrame:
    """Replace the score by ``scorer(query text, passage text)`` and rank by it.

    ``scorer`` is a Column function: a SQL expression or a ``pandas_udf`` around
    any model. Only candidates reach it.
    """
    scored = (
        pick_rows(
            chunks.select("chunk_id", F.col("text").alias("passage")),
            candidates.drop("score", "rank", "retrieval_method"),
        )
        .join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        .where(tx.blank_to_null(F.col("query_text")).isNotNull())
        .withColumn("score", tx.fixed(scorer(F.col("query_text"), F.col("passage")), 4))
        .drop("query_text", "passage")
    )
    ranked = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], n)
    return ranked.withColumn("retrieval_method", F.lit(method))


def word_overlap(query: Column, passage: Column) -> Column:
    """Offline scorer: share of distinct query words that the passage has as words."""
    wanted = tx.token_set(query)
    return F.size(F.array_intersect(wanted, tx.token_set(passage))) / F.greatest(
        F.size(wanted), F.lit(1)
    )
