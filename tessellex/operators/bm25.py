"""BM25 retrieval: ad-hoc search over a corpus and search over a stored index.

Corpus tables have ``chunk_id`` and ``text``; query tables ``query_id`` and
``text``. Results are ``candidates(query_id, chunk_id, score, rank,
retrieval_method)``: ``score`` is normalised by the best score of the query over
the whole corpus, before any filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators.sizing import is_small, join_measured, tasks_for, text_size
from tessellex.operators.topk import top_k

# One row per document carries this term. No token is empty, so it never matches
# a query; it makes corpus size and average length part of the same aggregate.
DOC_MARK = ""


def _raw_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    tokens = F.filter(F.split(F.lower(F.col(text)), fv.NON_WORD), lambda w: F.length(w) > 1)
    return df.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<string>")))


def _terms(df: DataFrame, keys: list[str], mark: bool) -> DataFrame:
    """Explode tokens, and every token's stem, to rows ``(*keys, term)``."""
    source = F.concat(F.array(F.lit(DOC_MARK)), F.col("tokens")) if mark else F.col("tokens")
    token = F.col("token")
    both = F.when(tx.has_stem(token), F.array(token, tx.stem(token))).otherwise(F.array(token))
    return (
        df.select(*keys, F.explode(source).alias("token"))
        .select(*keys, F.explode(both).alias("term"))
        .where(F.col("term").isNotNull())
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``; repeats count, blank queries vanish."""
    return (
        _terms(_raw_tokens(queries), ["query_id"], mark=False)
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _with_length(chunks: DataFrame) -> DataFrame:
    """Token arrays and document length (tokens plus stems)."""
    toks = F.col("tokens")
    return _raw_tokens(chunks).withColumn(
        "dl", F.size(toks) + F.size(F.filter(toks, tx.has_stem))
    )


def term_frequencies(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(chunk_id, dl, term, tf)``, with one ``DOC_MARK`` row per chunk.

    Texts are dealt by chunk to as many tasks as their length asks for, so that the terms counted in one task are bounded.
    """
    keys = ["chunk_id", "dl"]
    partitions = partitions or tasks_for(chunks.sparkSession, chars=text_size(chunks)[1])
    dealt = chunks.select("chunk_id", "text").repartition(partitions, "chunk_id")
    terms = _terms(_with_length(dealt).select(*keys, "tokens"), keys, mark=True)
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _asked_frequencies(chunks: DataFrame, vocabulary: DataFrame | None, partitions: int) -> DataFrame:
    """``(chunk_id, dl, kept, term, tf)``, partitioned by chunk.

    Only tokens of ``vocabulary(term)``, measured small by the caller, reach the
    exchange. It is partitioned by chunk alone, so counting terms here and
    summing scores later add no further shuffle.
    """
    keys = ["chunk_id", "dl", "kept"]
    terms = _terms(_with_length(chunks).select(*keys, "tokens"), keys, mark=True)
    if vocabulary is not None:
        terms = terms.join(F.broadcast(vocabulary), "term", "left_semi")
    return terms.repartition(partitions, "chunk_id").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1.0), F.lit(fv.IDF_FLOOR))


def _term_weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    length = F.lit(1.0 - b) + F.lit(b) * (dl / F.greatest(avgdl, F.lit(1e-4)))
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * length)


def cut(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows, with ``rank``, of every query and kept flag."""
    return top_k(scores, ["query_id", "kept"], [tx.fixed(F.col("score"), 9).desc(), F.col("chunk_id")], k)


def _rank(scores: DataFrame, k: int) -> DataFrame:
    """Cut to the k best kept rows per query, normalised by the unfiltered maximum.

    ``scores(query_id, chunk_id, kept, score)`` is cut per (query, kept flag), so
    the best row of a query survives whether or not the filter keeps it, and the
    maximum is read from the at most 2k survivors of each query.
    """
    survivors = cut(scores, k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return (
        survivors.withColumn("best", best)
        .where("kept")
        .select(
            "query_id",
            "chunk_id",
            F.least(F.col("score") / F.col("best"), F.lit(1.0)).alias("score"),
            "rank",
            F.lit("bm25_sparse").alias("retrieval_method"),
        )
    )


def _score(tf: DataFrame, weights: DataFrame, keys: list[str], small: bool, k1: float, b: float) -> DataFrame:
    gain = _term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return (
        join_measured(tf, weights, "term", small)
        .groupBy("query_id", *keys)
        .agg(F.sum(F.col("weight") * gain).alias("score"))
    )


def search_corpus(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    where: Column | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """BM25 top-k of every query in one pass over the corpus, no index needed.

    The corpus is tokenised once. Only tokens that occur in some query (and one
    marker per document) reach the first shuffle; corpus size, average length,
    document frequencies and scores are all computed from that one exchange,
    which Spark reuses. It is partitioned by chunk, so scores are summed where
    they are and only each partition's k best per query are shuffled. ``where``
    is evaluated on the chunk row at scan time and travels as a flag, so a
    metadata filter adds no join. The exchange has as many partitions as
    ``size``, rows and characters of the chunks (measured when not given), asks
    for, so that terms and scores of one task are bounded.
    """
    spark = queries.sparkSession
    small = is_small(queries, F.length("text"))
    n, chars = size or text_size(chunks)
    partitions = tasks_for(spark, n * queries.count(), chars)
    asked = query_terms(queries)
    vocabulary = None
    if small:
        mark = spark.range(1).select(F.lit(DOC_MARK).alias("term"))
        vocabulary = asked.select("term").union(mark).distinct()
    flag = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    tf = _asked_frequencies(chunks.withColumn("kept", flag), vocabulary, partitions)
    # Each consumer reads tf itself, so that all of them plan the same exchange.
    one = F.when(F.col("tf") > 0, F.lit(1))
    mark_row = F.when((F.col("term") == DOC_MARK) & (F.col("tf") > 0), F.lit(1))
    corpus = tf.agg(
        F.sum(mark_row).alias("n"), (F.sum(mark_row * F.col("dl")) / F.sum(mark_row)).alias("avgdl")
    )
    frequency = tf.groupBy("term").agg(F.sum(one).alias("df"))
    weights = (
        join_measured(frequency, asked, "term", small)
        .join(F.broadcast(corpus))  # one row
        .select(
            "query_id",
            "term",
            "avgdl",
            (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"),
        )
    )
    return _rank(_score(tf, weights, ["chunk_id", "kept"], small, k1, b), k)


@dataclass
class Bm25Index:
    """``postings(term, chunk_id, dl, tf)``, ``terms(term, df, idf)``, ``stats(n, avgdl)``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bm25Index":
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Bm25Index(read("postings"), read("terms"), read("stats"))


def corpus_stats(postings: DataFrame) -> DataFrame:
    """One row ``(n, avgdl)``; chunks without tokens count."""
    marks = postings.where(F.col("term") == DOC_MARK)
    return marks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``."""
    return (
        postings.where(F.col("term") != DOC_MARK)
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .join(F.broadcast(stats))  # one row
        .select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    )


def write_index(chunks: DataFrame, path: str, partitions: int | None = None, salts: int = 16) -> Bm25Index:
    """Build the inverted index once and store it as parquet.

    Postings are spread by (term, salt), so a term found in a third of all
    chunks fills ``salts`` partitions instead of one, and sorted by term, so a
    search reads only the row groups of its terms. The other two tables are
    derived from the stored postings: the corpus is tokenised once.
    """
    spark = chunks.sparkSession
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(salts))
    keys = [F.col("term"), salt]
    tasks = tasks_for(spark, chars=text_size(chunks)[1])
    spread = term_frequencies(chunks, tasks).repartition(partitions or tasks, *keys)
    spread.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    corpus_stats(stored).write.mode("overwrite").parquet(f"{path}/stats")
    term_stats(stored, spark.read.parquet(f"{path}/stats")).write.mode("overwrite").parquet(f"{path}/terms")
    return Bm25Index.load(spark, path)


def search_index(
    index: Bm25Index,
    queries: DataFrame,
    k: int = 5,
    allowed: DataFrame | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
) -> DataFrame:
    """BM25 top-k from a stored index. ``allowed(chunk_id)`` restricts results, not the normaliser."""
    small = is_small(queries, F.length("text"))
    weights = (
        join_measured(index.terms, query_terms(queries), "term", small)
        .join(F.broadcast(index.stats))  # one row
        .select("query_id", "term", "avgdl", (F.col("qtf") * F.col("idf")).alias("weight"), "df")
    )
    met = weights.agg(F.sum("df")).first()[0] or 0  # postings times queries
    weights = weights.drop("df")
    postings = index.postings
    if small:
        postings = postings.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    # Asked postings move once, by chunk: scores and the filter join need no further shuffle.
    partitions = tasks_for(queries.sparkSession, met)
    dealt = postings.repartition(partitions, "chunk_id")
    scores = _score(dealt, weights, ["chunk_id"], small, k1, b)
    if allowed is None:
        return _rank(scores.withColumn("kept", F.lit(True)), k)
    # Dealt like the postings, so that the scores stay where they are.
    kept = allowed.select("chunk_id").repartition(partitions, "chunk_id").distinct().withColumn("kept", F.lit(True))
    flagged = scores.join(kept.hint("merge"), "chunk_id", "left")
    return _rank(flagged.withColumn("kept", F.coalesce("kept", F.lit(False))), k)
