"""Helpers that several operators share: word rules, folds, hot keys, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.sources.scratch import tidy  # noqa: F401

#: A group is hot when it holds at least one in so many rows; so there are at most as many hot groups.
HOT_SHARE = 1000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(text: Column) -> Column:
    """The text in UTF-8, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D with only A-Z lower-cased; bytes methods know ASCII alone."""
    return (text or b"").lower().split()


def join_groups(rows: DataFrame, groups: DataFrame, keys: str | list[str], size: str, spread: Column) -> DataFrame:
    """Left join of rows with one row per group, when some groups may hold a third of all rows.

    ``groups`` has ``keys``, the rows of the group in ``size``, and values. A group with 1/1000 of
    the rows or more is hot; there can be 1000 of them at most, so they are broadcast, and their
    rows are dealt out by ``spread`` (any column that differs between rows) instead of by the key.
    The others meet in a shuffled join in which no key has more than 1/1000 of the rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size).alias("_total"))
    sized = groups.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(size) * HOT_SHARE >= F.col("_total"))
    hot = sized.where("_hot").select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.struct(*values).alias("_hot_v"))
    cold = sized.where("not _hot").select(
        F.hash(*keys).alias("_cold_h"), *(F.col(k).alias(f"_cold_{k}") for k in keys), F.struct(*values).alias("_cold_v")
    )
    is_hot = reduce(and_, (F.col(k) == F.col(f"_hot_{k}") for k in keys))
    seen = rows.join(F.broadcast(hot), is_hot, "left").withColumn(
        "_h", F.when(F.col("_hot_v").isNull(), F.hash(*keys)).otherwise(F.hash(spread, F.lit("hot")))
    )
    is_cold = reduce(and_, (F.col(k) == F.col(f"_cold_{k}") for k in keys), F.col("_h") == F.col("_cold_h"))
    met = seen.join(cold, is_cold & F.col("_hot_v").isNull(), "left")
    value = F.coalesce("_hot_v", "_cold_v")
    return met.select(*rows.columns, *(value[c].alias(c) for c in values))


def use_checkpoints(spark: SparkSession) -> None:
    """The shared folder of spark.checkpoint.dir; a local one only where none is set and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def written(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder: cuts the lineage and is compressed and columnar."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def set_for(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting for jobs that run meanwhile, then what it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
