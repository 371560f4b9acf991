"""A sample of the registered queries against their SQL; ``tools/check.py`` runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessellex.plans import catalog
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bm25_topk", "dense_euclid_topk", "dense_block_join", "dense_index_all_lists", "bm25_pruned_search", "store_three_batches", "hybrid_search", "section_metadata", "sliding_chunks",
    "page_locator", "response_status", "upsert_merge", "history_frame",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_has_sql():
    """But for those that report on approximate results."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"dense_index_recall", "bm25_pruned_reading"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
