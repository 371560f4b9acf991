"""The pruned search against the search that reads everything."""

import random

import pytest
from pyspark.sql import functions as F

from tessellex.operators import bm25, bm25_tiers


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    rows = [(i, " ".join(["common"] * rng.randrange(1, 4) + [word() for _ in range(rng.randrange(3, 80))])) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(40)] + [(700, ""), (701, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "common w1 w850"), (2, "w300 w301 common"), (3, rows[5][1]), (4, "common"), (5, "..."), (6, "absent"), (7, "w2 w2 w77")], "query_id long, text string")
    path = str(tmp_path_factory.mktemp("tiers"))
    return chunks, queries, bm25_tiers.write_index(chunks, path)


def shown(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("rounds", [bm25_tiers.ROUNDS, (0, 1, bm25_tiers.TIERS - 1)])
@pytest.mark.parametrize("small", [True, False])
def test_pruned_search_is_exact(tables, monkeypatch, rounds, small):
    chunks, queries, index = tables
    expected = shown(bm25.search_corpus(chunks, queries, 6))
    if not small:
        monkeypatch.setattr(bm25_tiers, "is_small", lambda *a: False)
    assert shown(bm25_tiers.search(index, queries, 6, rounds=rounds)) == expected


def test_pruned_search_with_filter(tables):
    chunks, queries, index = tables
    allowed = chunks.where("chunk_id % 3 = 1").select("chunk_id")
    expected = shown(bm25.search_corpus(chunks, queries, 6, where=F.col("chunk_id") % 3 == 1))
    assert shown(bm25_tiers.search(index, queries, 6, allowed)) == expected


def test_lists_of_common_terms_are_left_unread(spark, tables):
    _, _, index = tables
    rare = [r["term"] for r in index.terms.where("df between 12 and 25").orderBy("term").limit(4).collect()]
    queries = spark.createDataFrame([(i, f"{t} common") for i, t in enumerate(rare)], "query_id long, text string")
    for r in bm25_tiers.reading(index, queries, 5).collect():
        assert r["read"] < 0.2 * r["postings"] and r["candidates"] < 100


def test_sums_of_open_queries_are_not_stored(spark, tables, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    chunks, queries, index = tables
    stored, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a: stored.append((out := checkpoint(self, *a)).count()) or out)
    few = queries.where("query_id IN (3, 4)")  # every chunk has a word of each
    expected = shown(bm25.search_corpus(chunks, few, 3))
    assert shown(bm25_tiers.search(index, few, 3, rounds=(0, 1, bm25_tiers.TIERS - 1))) == expected
    assert max(stored) < 300


def test_postings_move_once_when_terms_are_many(tables, monkeypatch, tmp_path):
    chunks, queries, index = tables
    monkeypatch.setattr(bm25_tiers, "is_small", lambda *a: False)
    other = bm25_tiers.write_index(chunks, str(tmp_path / "tiers"))
    same = ["term", "chunk_id", "tier", F.round("impact", 9).alias("impact")]
    assert sorted(other.postings.select(same).collect()) == sorted(index.postings.select(same).collect())
    assert shown(bm25_tiers.search(other, queries, 6)) == shown(bm25.search_corpus(chunks, queries, 6))
