"""Queries over the maintenance of the chunk table and over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex.operators.chunking import section_chunks
from tessellex.operators.documents import describe_documents
from tessellex.operators.sessions import full_history
from tessellex.plans import sqlparts as sp
from tessellex.plans.extraction import DESCRIBED
from tessellex.plans.registry import query
from tessellex.plans.tables import statutes, table
from tessellex.sources import files as fl
from tessellex.sources import sinks
from tessellex.sources.scratch import scratch_path
from tessellex.sources.store import ChunkStore
from tessellex.streaming import ingest
from tessellex.streaming.sessions import session_memory, session_messages


def _points(spark, sf):
    """Stored chunks: documents joined with their vectors, where they have one."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("legal_domain"), "n_chars")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vecs, "chunk_id", "left")


_POINTS = """points AS (SELECT doc_id AS chunk_id, lang AS legal_domain, n_chars, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
_FRESH = """fresh AS (SELECT doc_id + quality * 7 AS chunk_id, 'label' AS legal_domain, toxic + doc_id AS n_chars,
  CASE WHEN doc_id % 5 <> 0 THEN [1.0::FLOAT, 2.0::FLOAT] END AS embedding, doc_id AS seq FROM labels)"""


def _fresh(spark, sf):
    """New versions, some repeated and some without vector, derived from the label table."""
    vector = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    return table(spark, sf, "labels").select(
        (F.col("doc_id") + F.col("quality") * 7).alias("chunk_id"),
        F.lit("label").alias("legal_domain"),
        (F.col("toxic") + F.col("doc_id")).alias("n_chars"),
        F.when(F.col("doc_id") % 5 != 0, vector).alias("embedding"),
        F.col("doc_id").alias("seq"),
    )


_MERGE = f"""merged AS (SELECT chunk_id, legal_domain, n_chars, embedding FROM (
  SELECT *, 0 AS v, 0 AS seq FROM points UNION ALL SELECT chunk_id, legal_domain, n_chars, embedding, 1, seq FROM fresh WHERE embedding IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY v DESC, seq DESC) = 1)"""


def _flat(df):
    return df.select("chunk_id", "legal_domain", "n_chars", F.size("embedding").cast("bigint").alias("vector_size"))


_FLAT = "SELECT chunk_id, legal_domain, n_chars, len(embedding)::BIGINT AS vector_size FROM "


@query("upsert_merge", sp.with_ctes([_POINTS, _FRESH, _MERGE], _FLAT + "merged"))
def _upsert(spark, sf):
    return _flat(sinks.upsert(_points(spark, sf), _fresh(spark, sf)))


@query(
    "stored_batches",
    sp.with_ctes(
        [_POINTS, _FRESH.replace("doc_id AS seq", "doc_id AS seq, row_number() OVER (PARTITION BY doc_id + quality * 7 ORDER BY doc_id DESC) AS rn"),
         """stored AS (SELECT chunk_id, legal_domain, n_chars, embedding, 0 AS b FROM points WHERE embedding IS NOT NULL
           UNION ALL SELECT chunk_id, legal_domain, n_chars, embedding, 1 FROM fresh WHERE embedding IS NOT NULL AND rn = 1)"""],
        _FLAT + "(SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY b DESC) = 1)",
    ),
)
def _stored_batches(spark, sf):
    """Two batches written to the shared folder, the second one twice, read back by newest version."""
    path = scratch_path(spark, "points")
    fresh = _fresh(spark, sf)
    newest = sinks.latest(fresh, "chunk_id", "seq").drop("seq")
    sinks.write_batch(_points(spark, sf), path, 0)
    for _ in range(2):
        sinks.write_batch(newest, path, 1)
    return _flat(sinks.latest(spark.read.parquet(path)))


@query("delete_ids", sp.with_ctes([_POINTS], _FLAT + "points WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def _delete_ids(spark, sf):
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return _flat(sinks.delete_ids(_points(spark, sf), toxic))


@query(
    "delete_by_filter",
    sp.with_ctes([_POINTS], _FLAT + "points WHERE NOT (legal_domain IN ('fr', 'es') AND n_chars > 800)"),
)
def _delete_where(spark, sf):
    kept = sinks.delete_where(_points(spark, sf), {"legal_domain": ["fr", "es"], "n_chars": {"gt": 800}})
    return _flat(sinks.delete_where(kept, {}))


@query(
    "collection_info",
    sp.with_ctes([_POINTS], "SELECT legal_domain, count(*) AS points_count, count(embedding) AS vectors_count, max(len(embedding))::INTEGER AS vector_size FROM points GROUP BY ROLLUP (legal_domain)"),
)
def _collection_info(spark, sf):
    return sinks.collection_info(_points(spark, sf))


_FILES = f"""files AS (SELECT doc_id, CASE WHEN doc_id % 12 = 5 THEN 'failed' ELSE status END AS status, word_count,
  CASE WHEN doc_id % 12 = 5 THEN 'unreadable' END AS error, source_file FROM described)"""


def _file_states(spark, sf):
    described = describe_documents(statutes(spark, sf))
    bad = F.col("doc_id") % 12 == 5
    return described.select(
        "doc_id",
        F.col("source_file").alias("path"),
        F.when(bad, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.col("word_count").alias("words"),
        F.when(bad, F.lit("unreadable")).alias("error"),
    )


@query(
    "ingestion_metrics",
    sp.with_ctes(
        [*DESCRIBED, _FILES, *sp.CHUNKS[1:]],
        """SELECT count(*) AS total_files_found, count(*) FILTER (status = 'completed') AS files_processed, count(*) FILTER (status <> 'completed') AS files_failed,
  count(*) FILTER (status = 'completed') AS total_documents, sum(word_count) FILTER (status = 'completed')::BIGINT AS total_words,
  (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(*) FROM chunks WHERE chunk_index > 0) AS total_vectors_indexed FROM files""",
    ),
)
def _ingestion_metrics(spark, sf):
    chunks = section_chunks(statutes(spark, sf).select("doc_id", "text")).select(
        F.when(F.col("chunk_index") > 0, F.array(F.lit(1.0))).alias("embedding")
    )
    return sinks.ingestion_metrics(_file_states(spark, sf), chunks)


@query(
    "ingestion_errors",
    sp.with_ctes(
        [*DESCRIBED, _FILES],
        "SELECT regexp_extract(source_file, '[^/]+$') AS file, 'Failed to ingest ''' || regexp_extract(source_file, '[^/]+$') || ''': unreadable' AS error FROM files WHERE status = 'failed'",
    ),
)
def _ingestion_errors(spark, sf):
    return sinks.ingestion_errors(_file_states(spark, sf))


@query(
    "session_memory_stream",
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_prior,
  coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS history FROM conversations""",
)
def _session_stream(spark, sf):
    """The conversation table replayed as a stream through keyed session state."""
    schema = table(spark, sf, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/conversations*.parquet")
    out = scratch_path(spark, "sessions")
    running = (
        session_memory(stream, keep=3)
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("conv_id", "turn", "role", "n_prior", F.array_join("history", "|").alias("history"))


@query(
    "session_history_stream",
    """WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)
SELECT a.conv_id, a.turn AS ask_turn, a.position AS n_prior, b.position, b.turn, b.role, b.text
FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.position < a.position""",
)
def _session_history_stream(spark, sf):
    """The conversation table replayed as a stream of numbered messages, and the whole history of each."""
    schema = table(spark, sf, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/conversations*.parquet")
    out = scratch_path(spark, "messages")
    running = (
        session_messages(stream)
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return full_history(spark.read.parquet(f"{out}/rows"))


# ----------------------------------------------------------- chunk store ----
_STORED = [
    _POINTS,
    _FRESH,
    """versions AS (SELECT chunk_id, legal_domain, n_chars, embedding, 1 AS b, 0 AS seq FROM points WHERE embedding IS NOT NULL
  UNION ALL SELECT chunk_id, legal_domain, n_chars, embedding, 2, seq FROM fresh WHERE embedding IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, 3, 0 FROM labels WHERE toxic = 1)""",
    "newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY b DESC, seq DESC) = 1)",
]


def _three_batches(spark, sf):
    """A store of documents, a batch of newer versions that is written twice, and a batch that removes the toxic ones."""
    store = ChunkStore(spark, scratch_path(spark, "store"), buckets=16)
    store.write(_points(spark, sf), store.claim("documents"))
    batch = store.claim("labels", 0)
    for _ in range(2):
        fresh = _fresh(spark, sf)
        store.write(fresh, store.claim("labels", 0))
        store.reject(fresh.where("embedding is null").select(F.col("seq").cast("string").alias("item"), F.lit("no embedding").alias("reason")), batch)
    store.delete(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")), store.claim("removal"))
    return store


@query("store_three_batches", sp.with_ctes(_STORED, "SELECT chunk_id, legal_domain, n_chars, len(embedding)::BIGINT AS vector_size, b AS batch FROM newest WHERE b < 3"))
def _store_three_batches(spark, sf):
    rows = _three_batches(spark, sf).read()
    return rows.select("chunk_id", "legal_domain", "n_chars", F.size("embedding").cast("bigint").alias("vector_size"), F.col("batch").cast("int").alias("batch"))


@query("store_rejected", sp.with_ctes([_FRESH], "SELECT seq::VARCHAR AS item, 'no embedding' AS reason, 2::BIGINT AS batch FROM fresh WHERE embedding IS NULL"))
def _store_rejected(spark, sf):
    return _three_batches(spark, sf).rejected()


_OLD = "SELECT item_id, text FROM benchmark"
_NEW = """SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' Revised.' ELSE ' ' END AS text FROM benchmark"""


def _folders(spark, sf):
    """Two folders of text files, one per benchmark item: the texts, and a later state in which a third is the same, a third revised and a
    third blank; the later one has compressed copies, too, which no parser takes."""
    root = scratch_path(spark, "folders")
    items = table(spark, sf, "benchmark")
    for name, sql in (("old", _OLD), ("new", _NEW)):
        texts = spark.sql(sql.replace("FROM benchmark", "FROM {items}"), items=items)
        texts.write.partitionBy("item_id").text(f"{root}/{name}")
        if name == "new":
            texts.write.option("compression", "gzip").partitionBy("item_id").text(f"{root}/{name}/packed")
    return root


def _ingested(rows):
    item = F.regexp_extract("source_file", "item_id=([0-9]+)", 1).cast("bigint")
    return rows.select(item.alias("item_id"), F.col("batch").cast("int").alias("batch"), F.sha2("content", 256).alias("content_sha256"))


def _ingested_sql(first: str, second: str) -> str:
    return f"""SELECT item_id, b AS batch, sha256({sp.strip('text')}) AS content_sha256
FROM (SELECT *, 1 AS b FROM ({first}) UNION ALL SELECT *, 2 FROM ({second})) WHERE {sp.strip('text')} <> ''
QUALIFY row_number() OVER (PARTITION BY text ORDER BY b DESC, '/item_id=' || item_id || '/' DESC) = 1"""


@query("ingest_two_folders", _ingested_sql(_OLD, _NEW))
def _ingest_two_folders(spark, sf):
    """Both folders ingested one after the other: texts that both have belong to the second."""
    root, path = _folders(spark, sf), scratch_path(spark, "ingest")
    for name in ("old", "new"):
        ingest.ingest_folder(spark, f"{root}/{name}", path, buckets=8)
    return _ingested(fl.chunk_table(spark, path))


@query("ingest_stream", _ingested_sql(_OLD, _NEW))
def _ingest_by_stream(spark, sf):
    """The first folder ingested as a batch, the second by a stream that is started twice."""
    root, path, state = _folders(spark, sf), scratch_path(spark, "ingest"), scratch_path(spark, "state")
    ingest.ingest_folder(spark, f"{root}/old", path, buckets=8)
    for _ in range(2):
        ingest.ingest_stream(spark, f"{root}/new", path, state).awaitTermination()
    return _ingested(fl.chunk_table(spark, path))


@query("recreate_table", _ingested_sql(_OLD + " WHERE false", _NEW))
def _recreate_table(spark, sf):
    """The second folder ingested into a table made anew."""
    root, path = _folders(spark, sf), scratch_path(spark, "ingest")
    ingest.ingest_folder(spark, f"{root}/old", path, buckets=8)
    ingest.ingest_folder(spark, f"{root}/new", path, recreate=True, buckets=8)
    return _ingested(fl.chunk_table(spark, path))


@query(
    "rejected_files",
    f"""SELECT item_id, 'unsupported file type: .gz' AS reason, 2::BIGINT AS batch FROM benchmark
UNION ALL SELECT item_id, 'extracted text is empty', 2 FROM ({_NEW}) WHERE {sp.strip('text')} = ''""",
)
def _rejected_files(spark, sf):
    """What the ingest of the second folder could not take."""
    root, path = _folders(spark, sf), scratch_path(spark, "ingest")
    for name in ("old", "new"):
        ingest.ingest_folder(spark, f"{root}/{name}", path, buckets=8)
    refused = ChunkStore(spark, path).rejected()
    return refused.select(F.regexp_extract("item", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "reason", "batch")
