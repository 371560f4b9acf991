"""Stored chunk table: bucketed batches, one sequence of numbers, rejected rows beside it.

A store's folder has one bucketed partition ``batch=<n>`` per batch. The folder ``<name>.state`` beside it has ``batches``, which say
whose batch each number is, ``rejected/batch=<n>`` and ``table``, the number of buckets and the columns. Any Parquet reader sees all
versions of all rows; ``read`` gives the newest of each id.

Every batch has the same buckets by id, so the newest version of an id is found where the id is: an aggregate of ids and batch
numbers alone, joined with the rows bucket by bucket. No text and no vector is shuffled or sorted to read. To write, a batch is
shuffled once, by bucket. Writing a batch again replaces that batch only. Folder ingests and streams take their numbers from one
sequence, so what was written later wins, whoever wrote it; a repeated batch of a stream keeps its number. One writer at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
KEY = "chunk_id"
#: Columns that the store adds to those of the first batch.
REMOVED = "removed"
BATCHES = "batch bigint, source string, source_batch bigint"
REJECTED = "item string, reason string"


class ChunkStore:
    """The table in ``path``; a new one is made by its first batch, with ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "chunks_" + hashlib.md5(self.path.encode()).hexdigest()

    # ------------------------------------------------------------ table ----
    def _stored(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}.state/{part}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def exists(self) -> bool:
        return not self._stored("table", "columns string").isEmpty()

    def _define(self, columns: str, buckets: int) -> None:
        where = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{where}'"
        )

    def _open(self) -> list[str]:
        """Make the table known to the session; its columns."""
        row = self._stored("table", "buckets int, columns string").first()
        self._define(row["columns"], row["buckets"])
        self.spark.catalog.refreshTable(self.name)  # another session may have written
        self.buckets = row["buckets"]
        return [c for c in self.spark.table(self.name).columns if c != "batch"]

    def _create(self, rows: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("batch", "seq", REMOVED)]
        columns = ", ".join([*fields, f"{REMOVED} boolean"])
        made = self.spark.createDataFrame([(self.buckets, columns)], "buckets int, columns string")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}.state/table")
        self._define(columns, self.buckets)

    # ---------------------------------------------------------- batches ----
    def batches(self) -> DataFrame:
        """``(batch, source, source_batch)`` of all numbers given out."""
        return self._stored("batches", BATCHES)

    def claim(self, source: str, source_batch: int | None = None) -> int:
        """Number of a batch: the one it already has, if the source says which of its batches it is, else the next."""
        known = self.batches()
        if source_batch is not None:
            row = known.where((F.col("source") == source) & (F.col("source_batch") == source_batch)).agg(F.max("batch")).first()
            if row[0] is not None:
                return row[0]
        number = (known.agg(F.max("batch")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, source, source_batch)], BATCHES).coalesce(1).write.mode("append").parquet(f"{self.path}.state/batches")
        return number

    # ------------------------------------------------------------ write ----
    def write(self, rows: DataFrame, batch: int, order: list[Column] | None = None, replace: bool = False) -> None:
        """Store the rows that have an embedding as batch ``batch``, with ``replace`` as the only one.

        Of rows with one id the first by ``order`` stays; by default the one with the largest ``seq``, if there is such a column.
        """
        if replace or not self.exists():
            self._create(rows)
        columns = self._open()
        if order is None:
            order = [F.col("seq").desc()] if "seq" in rows.columns else [F.lit(0).asc()]
        one = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
        kept = rows.where(F.col("embedding").isNotNull()).repartition(self.buckets, KEY).withColumn("_one", one).where("_one = 1")
        self._insert(kept.withColumn(REMOVED, F.lit(False)).select(*columns), batch, replace)

    def _insert(self, rows: DataFrame, batch: int, replace: bool) -> None:
        session = rows.sparkSession  # a stream's batch has one of its own
        if replace:
            session.sql(f"INSERT OVERWRITE TABLE {self.name} SELECT *, CAST({batch} AS BIGINT) AS batch FROM {{rows}}", rows=rows)
        else:
            session.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT * FROM {{rows}}", rows=rows)

    def delete(self, ids: DataFrame, batch: int) -> None:
        """Store the removal of ``ids(chunk_id)`` as batch ``batch``; a later batch may add an id again."""
        columns = self._open()
        types = {f.name: f.dataType for f in self.spark.table(self.name).schema.fields}
        gone = ids.select(KEY).distinct().repartition(self.buckets, KEY)
        rows = gone.select(*(F.col(c) if c == KEY else F.lit(True if c == REMOVED else None).cast(types[c]).alias(c) for c in columns))
        self._insert(rows, batch, False)

    def reject(self, rows: DataFrame, batch: int) -> None:
        """Store ``rows(item, reason)`` that batch ``batch`` could not take; replaces those of the batch."""
        rows.select("item", "reason").write.mode("overwrite").parquet(f"{self.path}.state/rejected/batch={batch}")

    # ------------------------------------------------------------- read ----
    def read(self) -> DataFrame:
        """Newest version of every id that the newest batch with it didn't remove, with the number of that batch."""
        self._open()
        rows = self.spark.table(self.name)
        newest = rows.groupBy(F.col(KEY).alias("_id")).agg(F.max("batch").alias("_newest"))
        # The newest batch is the one that isn't older; an equality would be a second join key, by which nothing is bucketed.
        met = rows.join(newest.hint("shuffle_hash"), (F.col(KEY) == F.col("_id")) & (F.col("batch") >= F.col("_newest")))
        return met.where(~F.col(REMOVED)).drop("_id", "_newest", REMOVED)

    def size(self, batch: int) -> int:
        """Number of rows that a batch stored."""
        self._open()
        return self.spark.table(self.name).where(F.col("batch") == batch).count()

    def rejected(self) -> DataFrame:
        """``(item, reason, batch)`` of everything that no batch could take."""
        return self._stored("rejected", f"{REJECTED}, batch bigint")
