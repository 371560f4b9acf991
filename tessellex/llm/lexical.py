"""Ranked lexical search by NRA: no random access, lists read in the order of impact.

The score of a document for an item is a sum over the item's terms; what a term adds to a document is its impact. Documents
become rows of term numbers and frequencies, once; counts of the corpus and of every asked term follow by aggregation. Then
every block of documents has one list per term, sorted by impact, and for each item reads its lists from the front only.
A document's score is at least the sum of the impacts read (lower) and at most that plus the last bounds of the lists in which it hasn't been met
(upper). Reading goes on, to impacts a quarter as large each time, until every document whose upper end reaches the k-th
best lower end has equal ends: then members, ties and scores are settled. The k-th best score of earlier blocks of a task counts as well, so
later blocks are read less far. Blocks give at most k documents an item, and those are ranked together; no posting is shuffled.

Items are asked in blocks of at most ITEM_BYTES of text, each sent to the tasks; the documents are read once a block.

Defined results: rows with one item id are one item with the terms of all; null texts have no terms, and items
without any term that a document holds have no rows. Documents that share an id or are repeated are ranked each by itself, equal scores by
id, nulls first. A text of any length is read whole. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessellex.llm.common import text_bytes, written
from tessellex.operators.topk import top_k

#: Bytes of the texts of a block of items: what a task holds of them is bounded by it.
ITEM_BYTES = 16 * 1024 * 1024
#: Documents whose lists a task holds at a time.
DOCUMENTS = 4096
#: Impacts are read down to the largest one left divided by this.
STEP = 4

#: A-Z in lower case; every other byte below 0x80 that is no letter or digit as a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats."""
    return (text or b"").translate(FOLD).split()


def weight(documents: int, having: int) -> int:
    """Weight of a term that so many of the documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What terms add to documents; ``length`` is a document's m."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * length))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` per document: its number of terms, and the numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, ends, keys, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                keys.extend(found)
                counts.extend(found.values())
                ends.append(len(keys))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    narrow = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n bigint, terms array<int>, tfs array<int>")


def settle(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, scores)`` of the k best of ``size`` documents with a score above 0 and not below ``floor``; ties go to the smaller number.

    Each list has documents and their impacts, largest impact first; a document is in it once at most.
    """
    lower = np.zeros(size, np.int64)
    unmet = np.ones((len(lists), size))  # sums of impacts stay below 2 ** 53, so floats hold them exactly
    at = [0] * len(lists)
    bound = np.array([x[0] for _, x in lists], np.int64)
    while True:
        least = max(1, int(bound.max()) // STEP)
        for i, (docs, impact) in enumerate(lists):
            if bound[i] < least:
                continue
            stop = len(impact) - int(np.searchsorted(impact[::-1], least))
            lower[docs[at[i] : stop]] += impact[at[i] : stop]
            unmet[i, docs[at[i] : stop]] = 0
            at[i] = stop
            bound[i] = impact[stop] if stop < len(impact) else 0
        upper = lower + (bound.astype(float) @ unmet).astype(np.int64)
        best = max(floor, 1, int(np.partition(lower, size - k)[size - k]) if size > k else 0)
        open_ = np.flatnonzero(upper >= best)
        if (upper[open_] == lower[open_]).all():
            order = open_[np.argsort(-lower[open_], kind="stable")[:k]]
            return order, lower[order]


def _search(coded: DataFrame, items: list[tuple], weights: np.ndarray, documents: int, length: int, k: int, kind: DataType) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast((items, weights))
    item_type = to_arrow_type(kind)

    def block_of(batch: pa.RecordBatch, floors: list[np.ndarray]) -> pa.RecordBatch:
        items, weights = shared.value
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
        sizes = batch.column(2).value_lengths().to_numpy()
        key = batch.column(2).flatten().to_numpy()
        tf = batch.column(3).flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        m = np.array([50 + 50 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
        impact = impacts(weights[key], tf, m[doc])
        order = np.lexsort((-impact, key))
        key, doc, impact = key[order], doc[order], impact[order]
        have, starts = np.unique(key, return_index=True)
        spans = dict(zip(have.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(key)])))
        owners, rows, scores = [], [], []
        for no, (_, asked) in enumerate(items):
            lists = [(doc[a:b], impact[a:b]) for a, b in (spans[t] for t in asked if t in spans) if impact[a] > 0]
            if not lists:
                continue
            floor = int(floors[no][0]) if len(floors[no]) == k else 0
            if sum(int(x[0]) for _, x in lists) < floor:
                continue
            found, score = settle(lists, batch.num_rows, k, floor)
            floors[no] = np.sort(np.concatenate([floors[no], score]))[-k:]
            owners.append(np.full(len(found), no))
            rows.append(found)
            scores.append(score)
        owner, row, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, rows, scores))
        ids = pa.array([i for i, _ in items], item_type).take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, batch.column(0).take(pa.array(row, pa.int64())), pa.array(score, pa.int64())], names=["item_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [np.zeros(0, np.int64) for _ in shared.value[0]]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                yield block_of(batch.slice(at, DOCUMENTS), floors)

    return coded.mapInArrow(run, f"item_id {kind.simpleString()}, id {coded.schema['id'].dataType.simpleString()}, score bigint")


def search(
    items: DataFrame,
    docs: DataFrame,
    *,
    k: int = 50,
    item_col: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The k best documents of every item: ``item_col``, ``rank`` from 1, ``id_col`` and ``score``, only scores above 0."""
    asked = items.select(F.col(item_col).alias("item"), text_bytes(F.col(item_text)).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // item_bytes))
    part = F.pmod(F.xxhash64("item"), F.lit(blocks))  # all rows of an item are in one block
    found = []
    for no in range(blocks):
        of: dict = {}
        for item, text in asked.where(part == no).toLocalIterator():
            of.setdefault(item, set()).update(terms(text))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of.values())))}
        coded = written(postings(docs, vocabulary, id_col, text_col))
        n, length = coded.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in coded.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # as many rows as the vocabulary at most
            weights[row[0]] = weight(n, row[1])
        numbered = [(i, sorted(vocabulary[t] for t in words)) for i, words in of.items()]
        found.append(_search(coded, numbered, weights, n, max(length, 1), k, items.schema[item_col].dataType))
    best = top_k(reduce(DataFrame.unionByName, found), ["item_id"], [F.col("score").desc(), F.col("id").asc()], k)
    return best.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
