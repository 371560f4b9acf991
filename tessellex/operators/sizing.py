"""Size checks that choose a join strategy, and input spreading.

Spark's own size estimates do not see through explode, so a join hint is given
in both directions: broadcast when the side was measured to be small, sort-merge
(with adaptive skew splitting) when it was not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.sources.scratch import ensure_checkpoint_dir

BROADCAST_BYTES = 32 * 1024 * 1024


def is_small(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``sum(width)`` over ``df`` (one aggregate row reaches the driver)."""
    total = df.agg(F.sum(width.cast("long") + 16).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def join_measured(
    left: DataFrame, right: DataFrame, on: str | list[str], small: bool, how: str = "inner"
) -> DataFrame:
    """Join with ``right`` broadcast when it was measured small, else sort-merge."""
    return left.join(right.hint("broadcast" if small else "merge"), on, how)


def pick_rows(
    table: DataFrame, candidates: DataFrame, key: str = "chunk_id", how: str = "inner"
) -> DataFrame:
    """Rows of a large ``table`` that a candidate table names, joined with it.

    Candidates, k rows per query, are computed once, checkpointed and measured.
    When they are small, their keys are broadcast to the scan of the table, whose
    other rows then never move; texts are not shuffled to look up a few of them.
    ``how="left"`` keeps candidates that the table lacks.
    """
    ensure_checkpoint_dir(table.sparkSession)
    settled = candidates.checkpoint()
    small = is_small(settled, F.lit(64))
    if how == "inner":
        return join_measured(table, settled, key, small)
    named = join_measured(table, settled.select(key).distinct(), key, small, "left_semi")
    return settled.join(named, key, "left")


FEW_SPLITS = 64
#: Characters of text, and rows of a join or an aggregate, that one task of a sized exchange takes.
TASK_CHARS = 8_000_000
TASK_ROWS = 1_000_000


def text_size(chunks: DataFrame, text: str = "text") -> tuple[int, int]:
    """Measured rows and characters (one aggregate row reaches the driver)."""
    found = chunks.agg(F.count("*").alias("n"), F.sum(F.length(text).cast("long")).alias("chars")).first()
    return found["n"], found["chars"] or 0


def tasks_for(spark: SparkSession, rows: int = 0, chars: int = 0) -> int:
    """Partitions of an exchange whose tasks hold so many rows or characters, however large the input is."""
    few = min(spark.sparkContext.defaultParallelism, FEW_SPLITS)
    return max(few, math.ceil(rows / TASK_ROWS), math.ceil(chars / TASK_CHARS))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when a small input has fewer splits than cores.

    A single small file is one split. An input of many splits, which is large,
    passes through without a shuffle even on a cluster with more cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(min(cores, FEW_SPLITS)) if splits < min(cores, FEW_SPLITS) else df
