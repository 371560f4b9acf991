"""Hybrid retrieval: both channels, fusion, diversification, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators import bm25, embedding
from tessellex.operators.dense import dense_search
from tessellex.operators.fusion import reciprocal_rank_fusion, weighted_fusion
from tessellex.operators.mmr import mmr_bounded
from tessellex.operators.rerank import pass_through, rerank
from tessellex.operators.topk import top_k
from tessellex.sources.scratch import ensure_checkpoint_dir
from pyspark.sql import functions as F


class NoChannelError(RuntimeError):
    """Neither channel could be planned."""


def fetch_size(k: int, stages: int = 1) -> int:
    """Candidates fetched per channel: three times the result size per later stage."""
    return k * fv.OVERFETCH**stages


def run_channels(**channels: Callable[[], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Plan every channel; a failing one is left out, and its reason returned.

    Raises ``NoChannelError`` only when all of them fail.
    """
    planned, errors = {}, {}
    for name, build in channels.items():
        try:
            planned[name] = build()
        except Exception as exc:  # noqa: BLE001 - any planning failure counts
            errors[name] = str(exc)
    if not planned:
        raise NoChannelError("; ".join(f"{n}: {e}" for n, e in errors.items()))
    return planned, errors


def hybrid(
    chunks: DataFrame,
    dense: DataFrame | None,
    sparse: DataFrame | None,
    k: int = 5,
    fusion: str = "rrf",
    alpha: float = fv.FUSION_ALPHA,
    use_mmr: bool = True,
    lam: float = fv.MMR_LAMBDA,
) -> DataFrame:
    """Fuse two channels, each fetched with ``fetch_size(k)``, and diversify to k.

    An absent channel (None) is skipped; an empty one simply adds no rows.
    """
    lists = [c for c in (dense, sparse) if c is not None]
    if not lists:
        raise NoChannelError("no retrieval channel given")
    fetch = fetch_size(k)
    if fusion == "rrf":
        fused = reciprocal_rank_fusion(lists, fetch)
    elif len(lists) == 2:
        fused = weighted_fusion(dense, sparse, fetch, alpha)
    else:
        empty = lists[0].limit(0)
        fused = weighted_fusion(dense or empty, sparse or empty, fetch, alpha)
    method = "rrf_hybrid" if fusion == "rrf" else "weighted_hybrid"
    if use_mmr:
        result = mmr_bounded(fused, chunks, k, lam)
    else:
        result = top_k(fused.drop("retrieval_method").withColumnRenamed("rank", "r"), ["query_id"], [F.col("r")], k).drop("r")
    return result.withColumn("retrieval_method", F.lit(method))


def ask(
    chunks: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    embedder: embedding.Embedder,
    k: int = 5,
    threshold: float = 0.0,
    metric: str = "cosine",
) -> tuple[DataFrame, DataFrame]:
    """Results of both channels for ``questions(query_id, text)``, and how each question was answered.

    Questions are embedded here, with the model of ``vectors(chunk_id, embedding)``. A question whose embedding fails while
    the job runs is answered by the sparse channel alone; the others keep both. The second table has one row per question:
    ``status`` (``both``, ``dense_only``, ``sparse_only``, ``empty``: nothing found, ``blank``: nothing asked, ``failed``: no
    channel answered and one broke) and ``dense_error``. Each channel runs once; its lists, 3k rows a question, are checkpointed.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    fetch = fetch_size(k)
    named = questions.select("query_id", tx.blank_to_null(F.col("text")).alias("text"))
    asked = embedding.embed(named, embedder, isolate=True).checkpoint()
    columns = ["query_id", "chunk_id", "score", "rank"]
    lists = [
        dense_search(vectors, asked, fetch, metric, threshold=threshold).select(*columns).checkpoint(),
        bm25.search_corpus(chunks, asked.where("text IS NOT NULL").select("query_id", "text"), fetch).select(*columns).checkpoint(),
    ]
    heard = (
        lists[0].select("query_id", F.lit(True).alias("d"), F.lit(False).alias("s"))
        .unionByName(lists[1].select("query_id", F.lit(False).alias("d"), F.lit(True).alias("s")))
        .groupBy("query_id")
        .agg(F.bool_or("d").alias("d"), F.bool_or("s").alias("s"))
    )
    no = F.lit(False)
    dense, sparse = F.coalesce("d", no), F.coalesce("s", no)
    status = (
        F.when(F.col("text").isNull(), "blank")
        .when(dense & sparse, "both")
        .when(dense, "dense_only")
        .when(sparse, "sparse_only")
        .when(F.col("embed_error").isNotNull(), "failed")
        .otherwise("empty")
    )
    outcomes = asked.join(heard, "query_id", "left").select("query_id", status.alias("status"), F.col("embed_error").alias("dense_error"))
    return reciprocal_rank_fusion(lists, k), outcomes


def two_stage(
    chunks: DataFrame,
    queries: DataFrame,
    dense: DataFrame | None,
    sparse: DataFrame | None,
    n: int = 5,
    scorer: Callable[[Column, Column], Column] | None = None,
    **options,
) -> DataFrame:
    """Hybrid with 3n results, then reranked to n. Channels are fetched with 9n."""
    first = hybrid(chunks, dense, sparse, k=fetch_size(n), **options)
    if scorer is None:
        return pass_through(first, n)
    return rerank(first, queries, chunks, scorer, n)


def domain_or_unknown(domain: Column) -> Column:
    return F.when(domain.isin(*fv.DOMAINS), domain).otherwise(F.lit("unknown"))
