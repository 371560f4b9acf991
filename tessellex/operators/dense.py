"""Exact vector search: top-k of every query over a table of vectors.

``vectors(chunk_id, embedding)`` is read once and not shuffled when the query vectors were measured to fit one block:
each task holds them, scores whole Arrow batches with one matrix product and keeps a running top-k per query, so it emits
k rows per query however many vectors it reads. Larger query tables meet the vectors block by block in a
shuffled join (``vector_index.block_join``) and never pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.functions import text as tx
from tessellex.operators.filters import above
from tessellex.operators.sizing import is_small, pick_rows
from tessellex.operators.topk import top_k

BLOCK_BYTES = 16 * 1024 * 1024
SCORE_CELLS = 4_000_000
METRICS = ("cosine", "dot", "euclid")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _scores(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Higher is better for every metric; Euclid is negated distance."""
    if metric == "cosine":
        return queries @ _unit(vectors).T
    if metric == "dot":
        return queries @ vectors.T
    squares = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * queries @ vectors.T
    return -np.sqrt(np.maximum(squares, 0.0))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best per row; equal scores keep the lower column."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(scores, near, axis=1).min(axis=1, keepdims=True)
    tied = (scores >= kth).sum(axis=1) > k
    near[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    near = np.sort(near, axis=1)
    order = np.argsort(-np.take_along_axis(scores, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def _task(metric: str, k: int, block):
    """Function for ``mapInArrow``: batches of vectors to k rows per query.

    Candidates are ordered by (score to nine digits, id), the order of the final
    ranking, so exact copies never make a task hold more than k of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        held_scores = held_ids = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype("U") if ids.dtype == object else ids
            by_id = np.argsort(ids, kind="stable")
            ids, vectors = ids[by_id], _matrix(batch.column(1))[by_id]
            step = max(1, SCORE_CELLS // len(ids))
            new_scores, new_ids = [], []
            for at in range(0, len(queries), step):
                scores = np.round(_scores(metric, queries[at : at + step], vectors), 9)
                best = _best(scores, k)
                new_scores.append(np.take_along_axis(scores, best, axis=1))
                new_ids.append(ids[best])
            scores, found = np.vstack(new_scores), np.vstack(new_ids)
            if held_scores is not None:
                scores, found = np.hstack([held_scores, scores]), np.hstack([held_ids, found])
                order = np.lexsort((found, -scores), axis=1)[:, :k]
                scores = np.take_along_axis(scores, order, axis=1)
                found = np.take_along_axis(found, order, axis=1)
            held_scores, held_ids = scores, found
        if held_scores is not None:
            n = held_scores.shape[1]
            owners = np.repeat(np.arange(len(query_ids)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(query_ids).take(pa.array(owners)),
                    pa.array(held_ids.ravel().tolist(), type=id_type),
                    pa.array(held_scores.ravel()),
                ],
                names=["query_id", "chunk_id", "score"],
            )

    return run


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Reject vectors of another size when they are read; a search never writes."""
    bad = F.concat(
        F.lit(f"vector size differs from {dimension}: "), F.size("embedding").cast("string")
    )
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(
        F.raise_error(bad).cast(vectors.schema["embedding"].dataType)
    )
    return vectors.withColumn("embedding", checked)


def dense_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    where: Column | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """``candidates`` of every query; ``where`` filters vectors before scoring."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    source = vectors if where is None else vectors.where(where)
    source = source.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    if not is_small(asked, F.size("embedding") * 8, BLOCK_BYTES):
        from tessellex.operators.vector_index import block_join

        one = F.lit(0)
        return ranked(block_join(source.withColumn("list", one), asked.withColumn("list", one), k, metric), k, metric, threshold)
    types = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {types[0]}, chunk_id {types[1]}, score double"
    table = asked.toArrow()  # BLOCK_BYTES at most
    if not table.num_rows:
        return ranked(vectors.sparkSession.createDataFrame([], schema), k, metric)
    matrix = _matrix(table.column(1).combine_chunks())
    ready = _unit(matrix) if metric == "cosine" else matrix
    block = vectors.sparkSession.sparkContext.broadcast((table.column(0).to_pylist(), ready))
    scored = check_dimension(source, matrix.shape[1]).mapInArrow(_task(metric, k, block), schema)
    return ranked(scored, k, metric, threshold)


def ranked(scored: DataFrame, k: int, metric: str = "cosine", threshold: float = 0.0) -> DataFrame:
    """The k best of each query among scored candidates, of which each task gave its own k best.

    A threshold of a similarity is a least score, of a distance a largest one; either only cuts the end of a ranked list.
    """
    if metric == "euclid":
        scored = scored.withColumn("score", -F.col("score"))
        kept = scored.where(F.col("score") <= threshold) if threshold > 0 else scored
        order = F.col("score").asc()
    else:
        kept = scored.where(above(F.col("score"), threshold))
        order = F.col("score").desc()
    best = top_k(kept, ["query_id"], [order, F.col("chunk_id")], k)
    return best.withColumn("retrieval_method", F.lit("dense"))


def text_blend(
    dense: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.5
) -> DataFrame:
    """Re-score dense candidates with the share of query words found in the passage.

    ``dense`` holds about 2k candidates per query; the passage text joins after
    the cut. Words longer than two letters count, repeats included, and are
    looked for as substrings.
    """
    terms = F.filter(tx.words(F.lower(F.col("text"))), lambda w: F.length(w) > 2)
    asked = queries.select("query_id", terms.alias("terms"))
    picked = pick_rows(
        chunks.select("chunk_id", F.col("text").alias("passage")),
        dense.select("query_id", "chunk_id", "score"),
    ).withColumn("passage", F.lower("passage"))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("passage"), t)))
    share = F.least(hits / F.greatest(F.size("terms"), F.lit(1)), F.lit(1.0))
    scored = (
        picked.join(asked, "query_id").select(
            "query_id",
            "chunk_id",
            tx.fixed(F.lit(alpha) * F.col("score") + F.lit(1.0 - alpha) * share, 4).alias("score"),
        )
    )
    ranked = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return ranked.withColumn("retrieval_method", F.lit("hybrid"))
