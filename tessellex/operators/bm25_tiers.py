"""BM25 over an impact-ordered index with dynamic pruning; the result is the exact top-k.

What a posting adds to a score is its impact, once for every time the query has the term; rarity, frequency and length fix the impact when the
index is written. Postings are stored in tiers of falling impact, so that rare terms come first and common ones last, and the largest
impact of every (term, tier) block beside them. A search reads the upper tiers of the asked terms only and sums what it finds. A chunk that was not met scores
at most the sum of the best unread blocks, and a chunk that was met at most that much more than its sum. As soon as the k-th best sum is
above what unmet chunks can reach, the query is closed: its candidates, the chunks that can still reach the k-th best sum, get
the rest of their postings from the lower tiers, and nobody else does. Queries that stay open read on, in the end all tiers.

Files are ranges of (tier, term, chunk), or of terms dealt by hash if these are too many to broadcast, sorted alike: a round reads the
folders of its tiers and the row groups of its terms, and a term that every chunk has fills as many files as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.operators import bm25
from tessellex.operators.sizing import is_small, join_measured, tasks_for
from tessellex.sources.scratch import ensure_checkpoint_dir, tidy

#: Tiers of an index; the impacts of one differ by a factor of RATIO at most, but for the last, which has all that is left.
TIERS = 14
RATIO = 1.5
#: Last tier that each round reads; after the last round all are read.
ROUNDS = (4, 6, 8, TIERS - 1)
#: Scores are compared to nine digits, so bounds closer than this count as equal.
MARGIN = 1e-6


@dataclass
class TieredIndex:
    """``postings(term, chunk_id, impact, tier)``, ``blocks(term, tier, postings, max_impact)``, ``terms(term, df, idf)``."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TieredIndex":
        return TieredIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "blocks", "terms")))


def tier_of(impact: Column, most: Column) -> Column:
    """Tier of an impact when ``most`` is the largest possible one."""
    depth = F.floor(F.log(most / impact) / F.log(F.lit(RATIO)))
    return F.greatest(F.least(depth, F.lit(TIERS - 1)), F.lit(0)).cast("int")


def write_index(chunks: DataFrame, path: str, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> TieredIndex:
    """Build the index once; the corpus is tokenised once, all else comes from the stored frequencies."""
    spark = chunks.sparkSession
    bm25.term_frequencies(chunks).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/frequencies")
    tidy(spark)
    counted = spark.read.parquet(f"{path}/frequencies")
    stats = bm25.corpus_stats(counted)
    bm25.term_stats(counted, stats).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    most = terms.agg((F.max("idf") * (k1 + 1.0)).alias("most"))
    gain = bm25._term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    small = is_small(terms, F.length("term"))
    gained = (
        join_measured(counted, terms, "term", small)
        .join(F.broadcast(stats))  # one row
        .join(F.broadcast(most))  # one row
        .select("term", "chunk_id", (F.col("idf") * gain).alias("impact"), "most")
        .withColumn("tier", tier_of(F.col("impact"), F.col("most")))
        .drop("most")
    )
    order = ["tier", "term", "chunk_id"]
    # Postings that the join has dealt by term stay there, and only partitions that are too large are split: they move once either way.
    dealt = gained.repartitionByRange(*order) if small else gained
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy("tier").parquet(f"{path}/postings")
    tidy(spark)
    blocks = spark.read.parquet(f"{path}/postings").groupBy("term", "tier").agg(F.count("*").alias("postings"), F.max("impact").alias("max_impact"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    return TieredIndex.load(spark, path)


def _weights(index: TieredIndex, queries: DataFrame, small: bool) -> DataFrame:
    asked = bm25.query_terms(queries)
    return join_measured(index.terms, asked, "term", small).select("query_id", "term", F.col("qtf").cast("double").alias("weight"))


def _unread(index: TieredIndex, weights: DataFrame, last: int, small: bool) -> DataFrame:
    """``(query_id, unread)``: what the tiers behind ``last`` can add to one chunk at most."""
    best = index.blocks.where(F.col("tier") > last).groupBy("term").agg(F.max("max_impact").alias("impact"))
    return join_measured(best, weights, "term", small).groupBy("query_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("unread"))


def _sums(index: TieredIndex, weights: DataFrame, last: int, small: bool) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the tiers up to ``last``; postings move once, by chunk, and only those of asked terms."""
    read = F.col("tier") <= last
    lists = join_measured(index.blocks.where(read), weights, "term", small)
    partitions = tasks_for(weights.sparkSession, lists.agg(F.sum("postings")).first()[0] or 0)
    postings = index.postings.where(read)
    if small:
        postings = postings.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    met = join_measured(postings.repartition(partitions, "chunk_id"), weights, "term", small)
    return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def _flagged(sums: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``sums`` with ``kept``: whether the chunk is allowed."""
    if allowed is None:
        return sums.withColumn("kept", F.lit(True))
    named = allowed.select("chunk_id").distinct().withColumn("kept", F.lit(True))
    return sums.join(named.hint("merge"), "chunk_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def candidates(
    index: TieredIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, rounds: tuple[int, ...] = ROUNDS
) -> tuple[DataFrame, DataFrame, bool]:
    """``(query_id, chunk_id, kept, score, last)``: chunks that can be among the k best, with their sums over tiers up to ``last``.

    Also the weights of the queries' terms, and whether the queries were measured small.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    small = is_small(queries, F.length("text"))
    weights = _weights(index, queries, small).checkpoint()
    asking, parts = weights, []
    for last in rounds:
        flagged = _flagged(_sums(index, asking, last, small), allowed)
        if last == rounds[-1]:
            parts.append(flagged.withColumn("last", F.lit(last)).select("query_id", "chunk_id", "kept", "score", "last"))
            break
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        kth = flagged.where("kept").withColumn("_p", place).where(F.col("_p") <= k).where(F.col("_p") == k).select("query_id", F.col("score").alias("kth"))
        bounds = kth.join(_unread(index, asking, last, small), "query_id", "left").na.fill(0.0, ["unread"])
        closed = bounds.where(F.col("unread") < F.col("kth") - MARGIN).checkpoint()  # one row a query at most
        tidy(weights.sparkSession)
        if closed.isEmpty():
            continue
        # Summed again for the closed queries; the sums of all, a row per query and chunk, are never stored.
        own = join_measured(asking, closed.select("query_id"), "query_id", small, "left_semi")
        met = join_measured(_flagged(_sums(index, own, last, small), allowed), closed, "query_id", small)
        able = met.where(F.col("score") + F.col("unread") >= F.col("kth") - MARGIN)
        parts.append(able.withColumn("last", F.lit(last)).select("query_id", "chunk_id", "kept", "score", "last").checkpoint())
        tidy(weights.sparkSession)
        asking = join_measured(asking, closed.select("query_id"), "query_id", small, "left_anti").checkpoint()
        if asking.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts), weights, small


def search(
    index: TieredIndex, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, rounds: tuple[int, ...] = ROUNDS
) -> DataFrame:
    """BM25 top-k as ``bm25.search_index`` gives it. ``allowed(chunk_id)`` restricts results, not the normaliser."""
    found, weights, small = candidates(index, queries, k, allowed, rounds)
    # Sums over all tiers are whole, so only the best of each query and flag are stored, as the ranking below cuts them.
    best = bm25.cut(found.where(F.col("last") == rounds[-1]), k).select(found.columns)
    found = found.where(F.col("last") < rounds[-1]).unionByName(best).checkpoint()
    wanted = found.where(F.col("last") < rounds[-1]).select("query_id", "chunk_id", "last")
    few = is_small(wanted, F.lit(48))
    lower = index.postings
    if small:
        lower = lower.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    # Postings meet their chunk's candidates first: a posting moves once at most, not once for every query that has its term.
    named = join_measured(lower, wanted, "chunk_id", few).where(F.col("tier") > F.col("last"))
    rest = (
        join_measured(named, weights, ["query_id", "term"], small)
        .groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("more"))
    )
    whole = found.join(rest, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return bm25._rank(whole.select("query_id", "chunk_id", "kept", "score"), k)


def reading(index: TieredIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, postings, read, candidates)``: postings of the query's terms, those read in tiers, and chunks that needed the rest."""
    found, weights, small = candidates(index, queries, k)
    depth = found.groupBy("query_id").agg(F.max("last").alias("last"), F.count("*").alias("candidates"))
    lists = join_measured(index.blocks, weights, "term", small).join(depth, "query_id")
    read = F.sum(F.when(F.col("tier") <= F.col("last"), F.col("postings")).otherwise(0))
    return lists.groupBy("query_id").agg(F.sum("postings").alias("postings"), read.alias("read"), F.first("candidates").alias("candidates"))
