"""Corpus files: scan, parser dispatch, decoding, plain-text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.sources.scratch import ensure_checkpoint_dir

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.[^./]+$", 0))


def with_parser(files: DataFrame) -> DataFrame:
    """Add ``parser`` by file extension; NULL when the type is not supported."""
    pairs = [F.lit(x) for item in fv.PARSER_BY_EXTENSION.items() for x in item]
    return files.withColumn("parser", F.try_element_at(F.create_map(*pairs), extension(F.col("path"))))


def split_supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(supported, rejected)``; rejected rows carry a reason."""
    tagged = with_parser(files)
    reason = F.concat(F.lit("unsupported file type: "), extension(F.col("path")))
    return (
        tagged.where(F.col("parser").isNotNull()),
        tagged.where(F.col("parser").isNull()).drop("parser").withColumn("reason", reason),
    )


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with a supported extension; content is read only when used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return split_supported(files)[0]


def numbered(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``file_no``, the 1-based place of every file in the order of paths; equal paths are numbered in any order.

    The rows are dealt out by ranges of paths and numbered within; what lies before a range is the sum of the counts of
    the earlier ones, a table of one row per partition. No task sees more than its range.
    """
    spark = files.sparkSession
    ranged = files.repartitionByRange(path).sortWithinPartitions(path).withColumns(
        {"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}
    )
    ensure_checkpoint_dir(spark)
    settled = ranged.checkpoint()  # ranges are sampled: another run of the plan might cut them elsewhere
    counts = settled.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    placed = settled.join(F.broadcast(offsets), "_part")
    return placed.select(*files.columns, (F.col("_id") + F.col("_offset")).alias("file_no"))


def decode(content: Column) -> Column:
    """UTF-8 text, else Latin-1; all line ends become \\n. A byte-order mark is kept."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def text_documents(files: DataFrame) -> DataFrame:
    """``(doc_id, source_file, text)`` of the plain-text files of a scan.

    The id is the hash of the text, so that ingesting a file again changes
    nothing.
    """
    text = decode(F.col("content"))
    return (
        files.where(F.col("parser") == "txt")
        .select(F.col("path").alias("source_file"), text.alias("text"))
        .withColumn("doc_id", tx.content_hash(F.col("text")))
        .select("doc_id", "source_file", "text")
    )


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks, newest version of every id."""
    from tessellex.sources.sinks import latest
    from tessellex.sources.store import ChunkStore

    store = ChunkStore(spark, path)
    return store.read() if store.exists() else latest(spark.read.parquet(path))
