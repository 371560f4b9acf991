"""Chunk table maintenance: merge, delete, replace, statistics, exports.

A chunk table is a folder of parquet batches, ``batch=<n>``, partitioned by
domain below it. Writing a batch again replaces only that batch, and readers take
the newest row of every id, so an interrupted or repeated write is harmless and
an upsert never rewrites the rest of the table.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators.filters import compile_filter


def latest(versions: DataFrame, key: str = "chunk_id", seq: str = "batch") -> DataFrame:
    """Newest version of every key.

    ``row_number() = 1`` is cut in every input partition before the shuffle, so
    many versions of one key do not meet in one task.
    """
    window = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return versions.withColumn("_v", F.row_number().over(window)).where("_v = 1").drop("_v")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` with the rows of ``new`` added or replaced; new rows without embedding are skipped.

    When ``new`` repeats a key, its row with the largest ``seq`` wins, if it has
    that column; repeating an upsert changes nothing.
    """
    fresh = new.where(F.col("embedding").isNotNull())
    seq = F.col("seq").cast("bigint") if "seq" in new.columns else F.lit(0).cast("bigint")
    a = old.withColumn("_seq", F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("s")))
    b = fresh.withColumn("_seq", F.struct(F.lit(1).alias("n"), seq.alias("s"))).select(*a.columns)
    return latest(a.unionByName(b), key, "_seq").drop("_seq")


def write_batch(chunks: DataFrame, path: str, batch: int) -> int:
    """Store one batch of chunks that have an embedding; returns their number."""
    rows = chunks.where(F.col("embedding").isNotNull())
    target = f"{path}/batch={batch}"
    writer = rows.write.mode("overwrite")
    if "legal_domain" in rows.columns:
        writer = writer.partitionBy("legal_domain")
    writer.parquet(target)
    return chunks.sparkSession.read.parquet(target).count()


def delete_ids(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(ids.select(key).distinct(), key, "left_anti")


def delete_where(chunks: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Drop rows that match the filter; an empty filter drops nothing."""
    condition = compile_filter(filters)
    if condition is None:
        return chunks
    return chunks.where(~F.coalesce(condition, F.lit(False)))


def replace_table(chunks: DataFrame, path: str) -> None:
    """Drop the stored table and write ``chunks``, which must not read from ``path``."""
    rows = chunks.where(F.col("embedding").isNotNull()).withColumn("batch", F.lit(0))
    parts = ["batch", "legal_domain"] if "legal_domain" in rows.columns else ["batch"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(path)


def collection_info(chunks: DataFrame) -> DataFrame:
    """Per-domain points, vector count and size, with the total in the NULL domain row."""
    return chunks.rollup("legal_domain").agg(
        F.count("*").alias("points_count"),
        F.count("embedding").alias("vectors_count"),
        F.max(F.size("embedding")).alias("vector_size"),
    )


def is_indexed(spark: SparkSession, path: str) -> bool:
    """True when a stored chunk table exists and has rows."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def ingestion_metrics(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters from ``files(path, status, words, error)`` and the chunk table."""
    done = F.col("status") == "completed"
    per_file = files.agg(
        F.count("*").alias("total_files_found"),
        F.count_if(done).alias("files_processed"),
        F.count_if(~done).alias("files_failed"),
        F.count_if(done).alias("total_documents"),
        F.coalesce(F.sum(F.when(done, F.col("words"))), F.lit(0)).alias("total_words"),
    )
    per_chunk = chunks.agg(
        F.count("*").alias("total_chunks"), F.count("embedding").alias("total_vectors_indexed")
    )
    return per_file.join(F.broadcast(per_chunk))  # one row each


def ingestion_errors(files: DataFrame) -> DataFrame:
    """One row per failed file."""
    name = tx.base_name(F.col("path"))
    return files.where(F.col("status") != "completed").select(
        name.alias("file"),
        F.concat(F.lit("Failed to ingest '"), name, F.lit("': "), F.col("error")).alias("error"),
    )


def result_row(passages: DataFrame, extra: list[str]) -> DataFrame:
    """Candidates joined with metadata as flat rows; extra keys win over base keys."""
    base: dict[str, Column] = {
        "chunk_id": F.col("chunk_id"),
        "document_id": F.col("doc_id"),
        "score": F.col("score"),
        "rank": F.col("rank"),
        "retrieval_method": F.col("retrieval_method"),
        "source": F.col("source_file"),
        "title": F.col("title"),
        "legal_domain": F.when(F.col("legal_domain").isin(*fv.DOMAINS), F.col("legal_domain")).otherwise("unknown"),
        "year": F.col("year"),
        "jurisdiction": F.col("jurisdiction"),
    }
    base.update({name: F.col(name) for name in extra})
    return passages.select("query_id", *[c.alias(n) for n, c in base.items()])


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write the ``line`` column as text files that are in order when read by name."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode(
        "overwrite"
    ).text(path)
