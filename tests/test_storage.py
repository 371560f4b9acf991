"""Batches of the chunk table: none is lost, recreation leaves nothing behind; distance thresholds."""

from pyspark.sql import functions as F

from tessellex.operators import dense
from tessellex.sources import files, sinks
from tessellex.sources.store import ChunkStore
from tessellex.streaming import ingest


def test_two_folders_and_recreate(spark, tmp_path):
    for name, text in (("a", "Alpha one two."), ("b", "Beta three four.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(text)
    table = str(tmp_path / "table")
    for name in "ab":
        ingest.ingest_folder(spark, str(tmp_path / name), table)
    both = spark.read.parquet(table).count()
    ingest.ingest_folder(spark, str(tmp_path / "b"), table, recreate=True)
    one = spark.read.parquet(table).count()
    assert both == 2 * one > 0
    ingest.ingest_folder(spark, str(tmp_path / "a"), table)
    assert spark.read.parquet(table).count() == both
    assert sinks.is_indexed(spark, table)


def test_euclid_threshold_keeps_near(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0])], "chunk_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    found = dense.dense_search(vectors, queries, metric="euclid", threshold=2.0).collect()
    assert sorted(r["chunk_id"] for r in found) == [1, 2]


def test_reading_a_store_shuffles_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    rows = spark.range(500).selectExpr("id as chunk_id", "concat('text ', id) as content", "array(cast(id as float)) as embedding")
    store.write(rows, store.claim("a"))
    second = rows.where("chunk_id % 2 = 0").withColumn("content", F.lit("new")).union(rows.where("chunk_id = 1").withColumn("embedding", F.lit(None).cast("array<float>")))
    for _ in range(2):
        store.write(second, 2)
    store.delete(rows.where("chunk_id < 100"), 3)
    store.write(rows.where("chunk_id = 7").withColumn("seq", F.lit(1)).union(rows.where("chunk_id = 7").withColumns({"content": F.lit("latest"), "seq": F.lit(2)})), 4)
    again = ChunkStore(spark.newSession(), str(tmp_path / "store"))
    found = again.read()
    got = {r["chunk_id"]: (r["content"], r["batch"]) for r in found.collect()}
    expected = {i: ("new", 2) if i % 2 == 0 else (f"text {i}", 1) for i in range(100, 500)} | {7: ("latest", 4)}
    assert got == expected and again.buckets == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan.replace("SortedBy", "").replace("SortOrder", "")


def test_folder_and_stream_share_a_sequence(spark, tmp_path):
    """A stream after a folder ingest replaces rows, and a batch that runs again keeps its number."""
    table, text = str(tmp_path / "table"), "Alpha one two."
    for name in ("old", "new"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_name.txt").write_text(text)
    (tmp_path / "new" / "sheet.csv").write_text("a,b")
    (tmp_path / "new" / "blank.txt").write_text(" ")
    ingest.ingest_folder(spark, str(tmp_path / "old"), table)
    ingest.ingest_stream(spark, str(tmp_path / "new"), table, str(tmp_path / "cp")).awaitTermination(120)
    rows = files.chunk_table(spark, table).collect()
    assert [(r["source_file"].rsplit("/", 1)[1], r["batch"]) for r in rows] == [("new_name.txt", 2)]
    store = ChunkStore(spark, table)
    assert store.claim(f"stream {tmp_path / 'cp'}", 0) == 2 and store.claim("folder") == 3
    refused = {(r["item"].rsplit("/", 1)[1], r["reason"], r["batch"]) for r in store.rejected().collect()}
    assert refused == {("sheet.csv", "unsupported file type: .csv", 2), ("blank.txt", "extracted text is empty", 2)}


def test_failed_embeddings_are_rejected(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Alpha one.")

    def broken(texts):
        raise RuntimeError("no model")

    table = str(tmp_path / "table")
    assert ingest.ingest_folder(spark, str(tmp_path / "in"), table, embedder=broken) == 0
    assert [r["reason"] for r in ChunkStore(spark, table).rejected().collect()] == ["RuntimeError: no model"]
    assert files.chunk_table(spark, table).count() == 0
