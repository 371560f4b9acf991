"""Block join and inverted-file index against numpy."""

import numpy as np
import pytest

from tessellex.operators import dense, vector_index

VECTORS = "chunk_id long, embedding array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 8))
    vecs = np.vstack([centers[rng.integers(12, size=900)] + 0.25 * rng.normal(size=(900, 8)), np.tile(centers[3], (400, 1))]).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)] + [(9999, None)], VECTORS).repartition(4)
    asked = list(range(0, 900, 30))
    q = spark.createDataFrame([(-i, vecs[i].tolist()) for i in asked], "query_id long, embedding array<float>")
    return v, q, vecs.astype(float), asked


def expected(vecs, asked, k):
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    return {-i: sorted(range(len(vecs)), key=lambda j: (-round(s[j], 9), j))[:k] for i in asked for s in [unit @ unit[i]]}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_large_query_tables_meet_vectors_block_by_block(tables, monkeypatch):
    v, q, vecs, asked = tables
    monkeypatch.setattr(dense, "BLOCK_BYTES", 100)
    monkeypatch.setattr(vector_index, "PAIR_BYTES", 5000)
    assert found(dense.dense_search(v, q, 7)) == expected(vecs, asked, 7)


def test_all_lists_are_exact_and_some_find_most(spark, tables, tmp_path):
    v, q, vecs, asked = tables
    index = vector_index.write_index(v, str(tmp_path / "index"), 12, sample=500)
    assert index.vectors.count() == 1300  # every vector, though the centroids saw 500
    assert found(vector_index.search_index(index, q, 7, probes=12, limit=3000)) == expected(vecs, asked, 7)
    probes = vector_index.probes_for(index, q, 7, 0.9)
    assert 1 <= probes < 12
    few = vector_index.search_index(index, q, 7, probes)
    measured = vector_index.recall(few, dense.dense_search(v, q, 7)).collect()
    assert len(measured) == len(asked) and sum(r["recall"] for r in measured) / len(asked) >= 0.9


def test_empty_sides(spark, tables, tmp_path):
    v, q, *_ = tables
    assert dense.dense_search(v.limit(0), q, 3).count() == dense.dense_search(v, q.limit(0), 3).count() == 0
    index = vector_index.write_index(v.limit(0), str(tmp_path / "none"), 4)
    assert vector_index.search_index(index, q, 3).count() == 0
    with pytest.raises(ValueError):
        vector_index.write_index(v, str(tmp_path / "bad"), 0)


def test_registered_recall(spark):
    from tessellex.plans import catalog

    rows = catalog.QUERIES["dense_index_recall"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 10 and sum(r["recall"] for r in rows) / len(rows) >= 0.9
