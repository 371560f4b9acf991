"""Incremental ingest: new files to described, chunked, embedded, stored rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellex.functions import text as tx
from tessellex.operators.chunking import chunk_id, enrich_sections, section_chunks
from tessellex.operators.documents import describe_documents
from tessellex.operators.embedding import Embedder, embed, hashing_embedder
from tessellex.sources import files as fl
from tessellex.sources import sinks
from tessellex.sources.store import BUCKETS, ChunkStore


def ingest_documents(docs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``docs(doc_id, source_file, text)`` to storable chunk rows. Narrow from end to end."""
    described = describe_documents(docs).where(F.col("status") == "completed")
    chunks = enrich_sections(
        section_chunks(
            described.select(
                "doc_id", "source_file", "text", "title", "year", "tags", "legal_domain",
                "document_type", "jurisdiction", "language", "content_hash", "total_pages",
                "total_sections", "act_number",
            )
        )
    )
    named = chunks.withColumn("chunk_id", chunk_id(F.col("content_hash"), F.col("chunk_index")))
    return embed(named, embedder or hashing_embedder(), "content")


def file_status(files: DataFrame) -> DataFrame:
    """``(path, status, words, error)`` of scanned plain-text files."""
    text = fl.decode(F.col("content"))
    filled = F.coalesce(tx.blank_to_null(text).isNotNull(), F.lit(False))
    return files.select(
        "path",
        F.when(filled, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        tx.word_count(text).alias("words"),
        F.when(~filled, F.lit("extracted text is empty")).alias("error"),
    )


def rejections(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(item, reason)``: files of other types, files without text, and chunks whose embedding failed."""
    supported, refused = fl.split_supported(files)
    blank = file_status(supported.where(F.col("parser") == "txt")).where("status = 'failed'")
    other = supported.where(F.col("parser") != "txt").select("path", F.lit("needs an extractor").alias("reason"))
    failed = chunks.where("embedding is null").select("chunk_id", F.coalesce("embed_error", F.lit("no embedding")))
    return (
        refused.select(F.col("path").alias("item"), "reason")
        .unionByName(other.withColumnRenamed("path", "item"))
        .union(blank.select("path", "error"))
        .union(failed)
    )


def ingest_files(files: DataFrame, store: ChunkStore, batch: int, embedder: Embedder | None = None, replace: bool = False) -> None:
    """Store what files give as one batch and what they don't as its rejected rows; running it again replaces both."""
    supported, _ = fl.split_supported(files)
    chunks = ingest_documents(fl.text_documents(supported), embedder).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        store.write(chunks, batch, [F.col("source_file").desc()], replace)
        store.reject(rejections(files, chunks), batch)
    finally:
        chunks.unpersist()


def ingest_folder(
    spark: SparkSession, folder: str, table: str, recreate: bool = False, embedder: Embedder | None = None, buckets: int = BUCKETS
) -> int:
    """Batch ingest of a folder as the next batch of the table; returns the number of vectors stored by it."""
    store = ChunkStore(spark, table, buckets)
    batch = store.claim("folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ingest_files(files, store, batch, embedder, replace=recreate)
    return store.size(batch)


def ensure_indexed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stored chunks; a full ingest first when there are none."""
    if not sinks.is_indexed(spark, table):
        ingest_folder(spark, folder, table)
    return fl.chunk_table(spark, table)


def ingest_stream(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    embedder: Embedder | None = None,
) -> StreamingQuery:
    """Ingest every new file of a folder once.

    The checkpoint remembers files. A batch that is run again keeps its number in the table's sequence and
    overwrites its own rows and rejected files, so results are exactly-once.
    """
    source = (
        spark.readStream.format("binaryFile")
        .schema(fl.BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    store = ChunkStore(spark, table)

    def keep(batch: DataFrame, batch_id: int) -> None:
        ingest_files(batch, store, store.claim(f"stream {checkpoint}", batch_id), embedder)

    return (
        source.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
