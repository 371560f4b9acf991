"""Byte-level BPE encoding and decoding by a file of ranks.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel,
each from its own start, which may be inside a token. A match depends only on the text from
its start on, so from the first boundary on which a chunk and the one before it agree their tokens
are the same: there the chunks are stitched. The pieces between stitches are encoded
independently and their ids concatenated in order. Where an overlap has no common boundary (a
token longer than the overlap) the piece goes on through the next chunk. Decoding concatenates the
bytes of the ids.

Defined results: null and empty texts have no ids. Rows may share ids; each is encoded by itself.
Special tokens are ordinary text. Ids without a token raise an error in decoding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 32_768  # code points
OVERLAP = 1_024
#: Code points after a match that can still change it: an apostrophe and two letters, or one non-space.
LOOKAHEAD = 3
#: Distinct pre-tokens in each of the two generations that a worker keeps encoded, about 200 bytes each.
CACHE = 400_000
SHORT = 64  # bytes


def read_ranks(path: str) -> bytes:
    """The rank file, read where the query is built and sent to the workers; about 50,000 lines."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a list of the neighbours' ranks, quicker for few bytes."""
    none = 1 << 62
    bounds = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del bounds[i + 1], pairs[i]
        if i:
            pairs[i - 1] = ranks.get(piece[bounds[i - 1] : bounds[i + 1]], none)
        if i < len(pairs):
            pairs[i] = ranks.get(piece[bounds[i] : bounds[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the leftmost pair of lowest rank becomes one part."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    ends = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end or not alive[ends[i]]:
            continue
        middle = ends[i]
        alive[middle] = 0
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers.

    When it is full it becomes the older generation, from which pre-tokens that are met again come back,
    so that frequent ones are never merged anew.
    """

    def __init__(self, ranks: dict[bytes, int], size: int) -> None:
        super().__init__()
        self.ranks, self.limit, self.older = ranks, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = merge(piece.encode(), self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) < 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_made: dict[tuple, tuple] = {}


def _encoder(data: bytes, pattern: str, cache: int = CACHE) -> tuple[regex.Pattern, _Pieces]:
    key = (data, pattern, cache)  # bytes keep their hash, so this is quick for the one object that a worker has
    if key not in _made:
        _made.clear()
        _made[key] = regex.compile(pattern), _Pieces(_ranks(data), cache)
    return _made[key]


def encode_text(text: str | None, data: bytes, pattern: str, cache: int = CACHE) -> bytes:
    """Ids of one text or piece as little-endian unsigned 32-bit integers."""
    rule, pieces = _encoder(data, pattern, cache)
    return b"".join([pieces[p] for p in rule.findall(text or "")])


def _boundaries(text: str, rule: regex.Pattern, last: bool) -> list[int]:
    """Starts of matches that later text can't change, as long as the first start is a boundary."""
    sure = len(text) if last else len(text) - LOOKAHEAD
    found = [0]
    for m in rule.finditer(text):
        if m.end() > sure:
            break
        found.append(m.end())
    return found


def _whole(docs: DataFrame, id_col: str, shared, pattern: str, cache: int) -> DataFrame:
    @F.pandas_udf("binary")
    def ids_of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_text(t, shared.value, pattern, cache) for t in texts], dtype=object)

    return docs.select(id_col, ids_of("_text").alias("ids"))


def _chunked(docs: DataFrame, id_col: str, shared, pattern: str, chunk: int, overlap: int, cache: int) -> DataFrame:
    @F.pandas_udf("array<struct<no int, at int, last boolean, part string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def parts(text: str) -> list[dict]:
            return [
                {"no": no, "at": at, "last": at + chunk >= len(text), "part": text[at : at + chunk + overlap + LOOKAHEAD]}
                for no, at in enumerate(range(0, len(text), chunk))
            ]

        return texts.map(parts)

    @F.pandas_udf("struct<head array<int>, tail array<int>>")
    def scan(ats: pd.Series, lasts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rule = regex.compile(pattern)
        heads, tails = [], []
        for at, last, part in zip(ats, lasts, parts):
            found = _boundaries(part, rule, last)
            heads.append([at + p for p in found if p <= overlap])
            tails.append([] if last else [at + p for p in found if chunk <= p <= chunk + overlap])
        return pd.DataFrame({"head": heads, "tail": tails})

    @F.pandas_udf("binary")
    def ids_of(starts: pd.Series, ends: pd.Series, pieces: pd.Series) -> pd.Series:
        rule, known = _encoder(shared.value, pattern, cache)
        out = []
        for start, end, parts in zip(starts, ends, pieces):
            parts = sorted(parts, key=lambda p: p["at"])
            text = "".join([*(p["part"][:chunk] for p in parts[:-1]), parts[-1]["part"]])
            first = parts[0]["at"]
            stop = len(text) if end < 0 else end - first
            ids = []
            for m in rule.finditer(text, int(start) - first):
                if m.start() >= stop:
                    break
                ids.append(known[m.group()])
            out.append(b"".join(ids))
        return pd.Series(out, dtype=object)

    keyed = docs.withColumn("_key", F.monotonically_increasing_id())  # before explode, so once a document
    cuts = keyed.select(id_col, "_key", F.explode(cut("_text")).alias("_c"))
    chunks = cuts.select(id_col, "_key", "_c.*").repartition("_key", "no")
    scanned = chunks.withColumn("_s", scan("at", "last", "part")).select(id_col, "_key", "no", "at", "part", "_s.*")
    order = Window.partitionBy("_key").orderBy("no")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    synced = scanned.withColumn("start", F.when(F.col("no") == 0, F.lit(0)).otherwise(common))
    pieced = synced.withColumn("piece", F.count("start").over(order))
    pieces = pieced.groupBy("_key", "piece").agg(
        F.min("start").alias("start"), F.first(id_col).alias(id_col), F.collect_list(F.struct("at", "part")).alias("parts")
    )
    after = F.lead("start", 1, -1).over(Window.partitionBy("_key").orderBy("piece"))
    ended = pieces.withColumn("end", after).repartition("_key", "piece")
    encoded = ended.select("_key", id_col, "piece", ids_of("start", "end", "parts").alias("ids"))
    joined = encoded.groupBy("_key").agg(
        F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("x")))).alias("_all")
    )
    return joined.select(id_col, F.unhex(F.array_join(F.transform("_all", lambda s: s["x"]), "")).alias("ids"))


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    cache: int = CACHE,
) -> DataFrame:
    """One row per document: id, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit integers.

    ``cache`` bounds the distinct pre-tokens that a worker keeps encoded, twice; a worker keeps them for as long as it lives.
    ``docs`` must give its rows in the same order when a task runs again, as a scan of files does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    size = F.coalesce(F.length("_text"), F.lit(0))
    short = _whole(narrow.where(size <= chunk), id_col, shared, pattern, cache)
    long = _chunked(narrow.where(size > chunk), id_col, shared, pattern, chunk, overlap, cache)
    both = short.unionByName(long)
    return both.select(id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks: bytes, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for; a null list of ids stays null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    tables: dict[str, list] = {}

    @F.pandas_udf("binary")
    def bytes_of(column: pd.Series) -> pd.Series:
        if not tables:
            known = _ranks(shared.value)
            tables["tokens"] = [b""] * (max(known.values(), default=-1) + 1)
            for token, rank in known.items():
                tables["tokens"][rank] = token
        get = tables["tokens"].__getitem__
        out = [None if ids is None else b"".join(map(get, np.frombuffer(ids, "<u4").tolist())) for ids in column]
        return pd.Series(out, dtype=object)

    return encoded.withColumn(out_col, bytes_of(ids_col))
