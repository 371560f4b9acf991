"""Vector search by blocks: an exact join of blocks, and an inverted-file index whose lists are such blocks.

Both sides of a join are cut into blocks whose size was measured, and every pair of blocks of one list meets in one task as a
cogroup: all queries against all vectors of the list, scored by one matrix product, k rows per query out. Neither side passes
the driver, and a list or a query table of any size is just more pairs.

The index has coarse centroids fitted on a bounded sample; every vector is stored with the list of its nearest centroid.
A search asks the ``probes`` nearest lists of each query and scores their vectors exactly; with all lists it is the
exact search. ``recall`` measures what the probes find of the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessellex.operators import dense

#: Bytes of the vectors of one block of a join.
PAIR_BYTES = 32 * 1024 * 1024
#: Vectors that the centroids are fitted on, those with the least hash of their id, whatever the size of the table.
SAMPLE = 20_000
#: Most lists of an index; the table of centroids is bounded by it.
LISTS = 4096
ROUNDS = 12
SEED = 20


def _pair_scores(metric: str, k: int, names: tuple[str, str], types: tuple[pa.DataType, pa.DataType]):
    schema = pa.schema([("query_id", types[0]), ("chunk_id", types[1]), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return schema.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors[names[1]]))  # equal scores keep the lower id
        asked = dense._matrix(queries["embedding"].combine_chunks())
        held = dense._matrix(vectors["embedding"].combine_chunks())
        if asked.shape[1] != held.shape[1]:
            raise ValueError(f"vector size differs from {asked.shape[1]}: {held.shape[1]}")
        if metric == "cosine":
            asked = dense._unit(asked)
        rows, columns, scores = [], [], []
        step = max(1, dense.SCORE_CELLS // len(held))
        for at in range(0, len(asked), step):
            cells = np.round(dense._scores(metric, asked[at : at + step], held), 9)
            best = dense._best(cells, k)
            rows.append(np.repeat(np.arange(at, at + len(cells)), best.shape[1]))
            columns.append(best.ravel())
            scores.append(np.take_along_axis(cells, best, axis=1).ravel())
        found = [queries[names[0]].take(pa.array(np.concatenate(rows))), vectors[names[1]].take(pa.array(np.concatenate(columns)))]
        return pa.Table.from_arrays([*found, pa.array(np.concatenate(scores))], schema=schema)

    return run


def _blocks(rows: DataFrame, limit: int, name: str) -> DataFrame:
    """``(list, name)``: the number of blocks that the rows of each list need."""
    size = F.sum(F.size("embedding").cast("bigint") * 8 + 64)
    return rows.groupBy("list").agg(F.ceil(size / limit).alias(name))


def block_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", limit: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, score)``: at most k candidates per query and pair of blocks.

    ``vectors(chunk_id, embedding, list)`` meet ``queries(query_id, embedding, list)`` of the same list; lists are few
    (LISTS at most), so the numbers of their blocks are broadcast. A vector is sent once per block of queries
    and a query once per block of vectors, and no task holds more than one block of each.
    """
    limit = limit or PAIR_BYTES
    vectors = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", "list")
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", "list")
    cuts = F.broadcast(_blocks(vectors, limit, "_nv").join(_blocks(queries, limit, "_nq"), "list"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = vectors.join(cuts, "list").withColumns({"_v": F.pmod(F.xxhash64("chunk_id"), F.col("_nv")), "_q": each("_nq")})
    right = queries.join(cuts, "list").withColumns({"_q": F.pmod(F.xxhash64("query_id"), F.col("_nq")), "_v": each("_nv")})
    by = ["list", "_v", "_q"]
    kinds = queries.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    score = _pair_scores(metric, k, ("query_id", "chunk_id"), tuple(to_arrow_type(t) for t in kinds))
    pairs = left.select(*by, "chunk_id", "embedding").groupBy(*by).cogroup(right.select(*by, "query_id", "embedding").groupBy(*by))
    return pairs.applyInArrow(score, f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double")


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE) -> DataFrame:
    """``(list, centroid)`` by spherical k-means on at most ``sample`` vectors, in one task."""
    if not 0 < lists <= LISTS:
        raise ValueError(f"lists must be 1 to {LISTS}")
    named = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", F.xxhash64("chunk_id").alias("_h"))
    chosen = named.orderBy("_h", "chunk_id").limit(sample).select("embedding")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [dense._matrix(b.column(0)) for b in batches if b.num_rows]
        if not parts:
            return
        points = dense._unit(np.vstack(parts))
        points = points[np.lexsort(points.T[::-1])]  # whatever order they came in
        rng = np.random.default_rng(SEED)
        centers = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(ROUNDS):
            nearest = (points @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, points)
            filled = np.bincount(nearest, minlength=len(centers)) > 0
            centers = np.where(filled[:, None], dense._unit(sums), centers)
        numbers = pa.array(range(len(centers)), pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, pa.array(centers.tolist(), pa.list_(pa.float64()))], names=["list", "centroid"])

    return chosen.coalesce(1).mapInArrow(fit, "list int, centroid array<double>")


@dataclass
class VectorIndex:
    """``vectors(chunk_id, embedding, list)`` and ``centroids(list, centroid)`` as stored."""

    vectors: DataFrame
    centroids: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VectorIndex":
        return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids"))


def _with_lists(rows: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """Rows once for each of their ``probes`` nearest lists, by the cosine to the centroid; ``probe`` counts these from 1."""
    table = centroids.orderBy("list").toArrow()  # LISTS rows at most
    numbers = table.column("list").to_numpy()
    centers = dense._matrix(table.column("centroid").combine_chunks()) if len(table) else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((numbers, centers))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centers = shared.value
        at = None
        for batch in batches:
            if at is None:
                at = batch.schema.get_field_index("embedding")
            if not batch.num_rows or not len(centers):
                continue
            best = dense._best(dense._matrix(batch.column(at)) @ centers.T, min(probes, len(centers)))
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
            probe = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), batch.num_rows)
            more = [pa.array(numbers[best.ravel()], pa.int32()), pa.array(probe, pa.int32())]
            yield pa.RecordBatch.from_arrays([*again.columns, *more], names=[*batch.schema.names, "list", "probe"])

    kept = rows.where(F.col("embedding").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return kept.mapInArrow(nearest, f"{schema}, list int, probe int")


def write_index(vectors: DataFrame, path: str, lists: int, sample: int = SAMPLE) -> VectorIndex:
    """Fit the centroids and store every vector with its list.

    Files are ranges of (list, id): a search of some lists reads only their row groups, and a list that holds a third of
    all vectors fills a third of the files.
    """
    spark = vectors.sparkSession
    fit_centroids(vectors, lists, sample).write.mode("overwrite").parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    listed = _with_lists(vectors.select("chunk_id", "embedding"), centroids, 1).drop("probe")
    ranged = listed.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id")
    ranged.write.mode("overwrite").parquet(f"{path}/vectors")
    return VectorIndex.load(spark, path)


def search_index(
    index: VectorIndex, queries: DataFrame, k: int = 5, probes: int = 8, metric: str = "cosine", limit: int | None = None
) -> DataFrame:
    """Candidates of every query from its ``probes`` nearest lists, in the order and form of ``dense.dense_search``."""
    asked = _with_lists(queries.select("query_id", "embedding"), index.centroids, probes)
    return dense.ranked(block_join(index.vectors, asked, k, metric, limit), k, metric)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.9) -> int:
    """Least number of probes with which the queries, a sample, have that recall.

    The exact neighbours are found once; which of its query's nearest lists holds each says what any number of probes would find.
    """
    exact = dense.dense_search(index.vectors, queries, k).select("query_id", "chunk_id")
    order = _with_lists(queries.select("query_id", "embedding"), index.centroids, LISTS).select("query_id", "list", "probe")
    held = exact.join(index.vectors.select("chunk_id", "list"), "chunk_id").join(order, ["query_id", "list"])
    counts = {r["probe"]: r["count"] for r in held.groupBy("probe").count().collect()}  # LISTS rows at most
    total, hits = sum(counts.values()), 0
    for probe in sorted(counts):
        hits += counts[probe]
        if hits >= target * total:
            return probe
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, expected, hits, recall)`` of every query of ``exact``."""
    both = exact.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left"
    )
    return both.groupBy("query_id").agg(
        F.count("*").alias("expected"), F.count("_hit").alias("hits"), (F.count("_hit") / F.count("*")).alias("recall")
    )
