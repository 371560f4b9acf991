"""Questions whose embedding fails while the job runs, one by one."""

import numpy as np

from tessellex.operators import embedding, hybrid

CHUNKS = [(1, "passport fees and entry"), (2, "entry of a foreigner"), (3, "weather of the north")]


def broken_on(word):
    model = embedding.hashing_embedder(32)

    def run(texts):
        if any(word in t for t in texts):
            raise RuntimeError("refused")
        return model(texts)

    return run


def test_each_question_by_the_channels_that_answer(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id bigint, text string").repartition(2)
    vectors = embedding.embed(chunks, embedding.hashing_embedder(32)).select("chunk_id", "embedding")
    asked = [(1, "passport entry"), (2, "foreigner bad"), (3, "bad"), (4, None), (5, " \n "), (6, "zebra"), (6, "zebra")]
    questions = spark.createDataFrame(asked, "query_id bigint, text string").coalesce(1)
    found, outcomes = hybrid.ask(chunks, vectors, questions, broken_on("bad"), k=2, threshold=0.99)
    told = {(r["query_id"], r["status"], r["dense_error"]) for r in outcomes.collect()}
    error = "RuntimeError: refused"
    assert told == {(1, "sparse_only", None), (2, "sparse_only", error), (3, "failed", error), (4, "blank", None), (5, "blank", None), (6, "empty", None)}
    assert {r["query_id"] for r in found.collect()} == {1, 2}
    found, outcomes = hybrid.ask(chunks, vectors, questions, broken_on("bad"), k=2, threshold=0.1)
    told = {r["query_id"]: r["status"] for r in outcomes.collect()}
    assert told[1] == "both" and told[2] == "sparse_only" and told[3] == "failed"
    assert next(r["chunk_id"] for r in found.collect() if r["query_id"] == 1 and r["rank"] == 1) == 1


def test_a_failing_text_does_not_fail_its_batch(spark):
    rows = [(i, "bad" if i == 7 else f"word{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    alone = {r["id"]: r for r in embedding.embed(df, broken_on("bad"), isolate=True).collect()}
    assert [i for i, r in alone.items() if r["embed_error"]] == [7] and alone[7]["embedding"] is None
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for i, r in alone.items() if i != 7)
    assert all(r["embed_error"] for r in embedding.embed(df, broken_on("bad")).collect())
    assert embedding.embed(df.limit(0), broken_on("bad"), isolate=True).count() == 0
