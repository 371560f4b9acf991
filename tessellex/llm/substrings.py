"""Removal of passages that documents share: winnowed anchors as a filter, windows compared by hash.

Anchors: hashes of ANCHOR consecutive words, winnowed: of each run of WINDOW - ANCHOR + 1 neighbouring
hashes the smallest stays, so two documents that share WINDOW words share the anchor chosen in
them. A grouping of anchors finds those that two documents hold. The windows around those are compared
by a hash of their words, grouped over all documents; no match is extended word by word, and overlapping windows
that match join to maximal repeats. A word goes if a window over it also starts in a document with
a smaller id. Windows of one document may repeat within it freely.

The shared anchors return to the second reading of the texts as a bitmap of at most BITS bits, so
no text moves for it; a false positive costs a few more windows in the shuffle.

Defined results: a null text has no words. Texts under WINDOW words lose nothing. Rows with the same
id count as one document for matching, and each loses what its own text shares with smaller ids.
A null id is larger than all others. Word hashes have 64 bits, window hashes two of 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellex.llm.common import HOT_SHARE, text_bytes, written

WINDOW = 50
ANCHOR = 25
#: Size of the bitmap of shared anchors: 16 MB, the bound of what is broadcast.
BITS = 1 << 27
CACHE = 150_000
CELLS = 1 << 16
SALTS = 256

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        size = max(1024, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = tuple(out)
    return have[0][:n], have[1][:n]


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, from prefix sums of words times powers of a base."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _power(which, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power, out=sums[1:])
    return _mix((sums[size:] - sums[:n]) * inverse[:n])


def window_anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window the smallest hash of the runs of ``anchor`` words in it."""
    out = run_hashes(words, anchor)
    width, have = window - anchor + 1, 1
    if len(out) < width:
        return np.empty(0, np.uint64)
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors that documents with different ids chose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            anchors, ids = [], []
            for i, text in zip(b["_id"], b["_text"]):
                a = np.unique(window_anchors(word_hashes(text), window, anchor))
                if len(a):
                    anchors.append(_signed(a))
                    ids.append(np.full(len(a), i, np.int64))
            if anchors:
                yield pd.DataFrame({"anchor": np.concatenate(anchors), "_id": np.concatenate(ids)})

    seeds = docs.mapInPandas(run, "anchor bigint, _id bigint")
    spans = seeds.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high"))
    return spans.where("low < high").select("anchor")


def _bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the anchors, ``bits / 8`` bytes whatever their number."""
    cell = F.pmod(F.col("anchor"), F.lit(bits)) + 1
    parts = anchors.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bitmap"], np.uint8)[: len(out) - at]
    return out


def _windows(docs: DataFrame, shared, window: int, anchor: int, bits: int) -> DataFrame:
    """Windows around shared anchors: two hashes, document, hash of its text, and position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for b in batches:
            parts = []
            for i, own, text in zip(b["_id"], b["_own"], b["_text"]):
                words = word_hashes(text)
                cell = window_anchors(words, window, anchor) & np.uint64(bits - 1)
                at = np.flatnonzero((bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)
                if len(at):
                    h1, h2 = (_signed(run_hashes(words, window, which)[at]) for which in (0, 1))
                    n = len(at)
                    parts.append((h1, h2.astype(np.int32), np.full(n, i, np.int64), np.full(n, own, np.int32), at.astype(np.int32)))
                    if sum(len(p[0]) for p in parts[-64:]) > 200_000:
                        yield _frame(parts)
                        parts = []
            if parts:
                yield _frame(parts)

    return docs.mapInPandas(run, "h1 bigint, h2 int, _id bigint, _own int, at int")


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("h1", "h2", "_id", "_own", "at"), map(np.concatenate, zip(*parts)))))


def _later(around: DataFrame) -> DataFrame:
    """Windows that also start in a document with a smaller id.

    A window's rows meet in one partition, in order of id. Windows with 1/HOT_SHARE of all rows or more, of
    which there are HOT_SHARE at most, are found by the share of their cell; their rows are dealt out over
    SALTS partitions, each of which also gets a row with the window's smallest id.
    """
    cell = F.pmod(F.col("h1"), F.lit(CELLS))
    cells = around.groupBy(cell.alias("cell")).count()
    total = cells.agg(F.sum("count")).first()[0] or 0
    dense = [r["cell"] for r in cells.where(F.col("count") * HOT_SHARE >= total).collect()]
    counted = around.where(cell.isin(dense)).groupBy("h1").count().where(F.col("count") * HOT_SHARE >= total)
    is_hot = F.col("h1").isin([r["h1"] for r in counted.collect()])
    dealt = around.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("_id", "at"), F.lit(SALTS)).cast("int")).otherwise(-1))
    least = around.where(is_hot).groupBy("h1", "h2").agg(F.min("_id").alias("_id"))
    firsts = least.select(
        "h1", "h2", "_id", F.lit(0).alias("_own"), F.lit(0).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    first = F.min("_id").over(Window.partitionBy("h1", "h2", "salt").orderBy("_id"))
    return dealt.unionByName(firsts).withColumn("first", first).where("first < _id").select("_id", "_own", "at")


_LAST = (1 << 63) - 1  # stands for a null id


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words a window from one of the starts covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def spans_of(mark: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    bits: int = BITS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``spans`` (word ranges that go, maximal)
    and ``kept`` (the words that stay, joined by one space, in UTF-8)."""
    body = text_bytes(F.col(text_col))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("_id"), F.hash(body).alias("_own"), body.alias("_text")
    )
    bitmap = _bitmap(_shared_anchors(keyed, window, anchor), bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    around = written(_windows(keyed, shared, window, anchor, bits))
    starts = _later(around).groupBy("_id", "_own").agg(F.collect_set("at").alias("_starts"))
    texts = keyed.join(starts.select(F.col("_id").alias("_i"), F.col("_own").alias("_o"), "_starts"),
                       (F.col("_id") == F.col("_i")) & (F.col("_own") == F.col("_o")), "left")

    @F.pandas_udf("struct<n_words bigint, n_removed bigint, spans array<struct<start int, stop int>>, kept binary>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, starts):
            words = text.split()
            if at is None or not len(at):
                rows.append((len(words), 0, [], b" ".join(words)))
                continue
            mark = covered(np.asarray(at), window, len(words))
            spans = spans_of(mark)
            kept = b" ".join([w for w, gone in zip(words, mark.tolist()) if not gone])
            rows.append((len(words), int(mark.sum()), [{"start": a, "stop": b} for a, b in spans], kept))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept"])

    out = texts.select(F.nullif("_id", F.lit(_LAST)).alias(id_col), cut("_text", "_starts").alias("_c"))
    return out.select(id_col, "_c.*")
