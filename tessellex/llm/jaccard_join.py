"""Jaccard similarity join on word shingles with prefixes of token combinations.

A document is the set of its distinct shingles (tokens). Tokens are ordered: rare ones first, those
frequent in the corpus last, by hash within a class. Two sets that are similar enough lack at most
m = n - ceil(t * n) of each other's tokens, so they share a token among the first m + 1. Rare
tokens are indexed singly. Frequent ones are indexed in pairs (k = 2), for which the prefix is
extended by one: among m + 2 tokens, of which r rare ones are not shared and at most one frequent one
is, more than m would be missing. Pairs are made within size bands, since similar sets have similar
sizes; in bands whose prefix is longer than PAIRS_UP_TO frequent tokens are indexed singly within the band.

Equal sets are one class. Two bounds rule out most pairs without reading the texts again, and never a link.
Each set carries PARITY bits: bit b tells whether an odd number of its tokens have the hash b modulo
PARITY; the bits in which two sets differ are at most as many as the tokens that only one of them
has. And of two sets, all tokens of the prefix that ends first which the other holds are in the other's
prefix too, so its rare prefix tokens that no other class indexed are missing from the other set.
Documents with a common key are first
compared with those among them that have the smallest and the largest id and with their hub, the one with the
fewest rare tokens, which joins near copies of one text to components: of copies that were each changed in
other places, the least changed is like more of the others than a copy taken by its id. Then all pairs in different
components that the bits leave are compared. So a group of near copies costs about one comparison per copy, and no
link between components is lost. Comparisons are exact, on the sets.

Defined results: a null or empty text has an empty set and links with nothing. A text with fewer words
than a shingle is one token, its whole sequence. Rows that share an id count as one document if
their texts agree; if not, the text of the smallest hash counts. Shingles are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups, lower_words, set_for, text_bytes, tidy, use_checkpoints, written
from tessellex.llm.components import components

#: A token is frequent with this share of all tokens or more, so there are at most a million
#: (8 MB to broadcast), and with LEAST_COUNT occurrences.
SHARE = 1e-6
LEAST_COUNT = 20
#: Documents whose sets a task holds at a time, and the occurrences among them below which a token isn't counted.
AT_ONCE = 2_000
LOCAL = 2
PAIRS_UP_TO = 64
PARITY = 1024
#: Bits of a bitmap that tells which keys several documents have, whose sets are asked for, or which ids go: 16 MB.
BITS = 1 << 27
CACHE = 150_000
#: Bytes of texts that a batch of pairs takes to Python.
BATCH = "4m"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = _mix(out) + h[j : n + j]
    return np.unique(_mix(out))


def least_overlap(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def keys_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set: single rare tokens; and pairs of frequent ones within size bands."""
    n = len(tokens)
    missing = n - least_overlap(n, percent)
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    common = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rare = tokens[~common][: missing + 1]
    if len(rare) > missing:
        return rare, rare[:0]
    often = tokens[common][: missing + 2 - len(rare)]
    band = math.floor(math.log(n) / (1.001 * math.log(100 / percent))) if percent < 100 else n
    parts = []
    for b in (band, band + 1):
        mark = np.uint64(xxhash.xxh3_64_intdigest(str(b)))
        size = math.exp(b * 1.001 * math.log(100 / percent)) if percent < 100 else n
        if size * (100 - percent) / 100 > PAIRS_UP_TO:
            parts.append(_mix(often ^ mark))
        else:
            i, j = np.triu_indices(len(often), 1)
            parts.append(_mix(_mix(often[i] ^ mark) + often[j]))
            if len(rare) + len(often) < missing + 2:  # the set ends before the extended prefix
                parts.append(_mix(often ^ mark ^ np.uint64(1)))
    return rare, np.unique(np.concatenate(parts))


def parity_of(tokens: np.ndarray, width: int = PARITY) -> np.ndarray:
    """The set's parity bits, packed to bytes."""
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8))


def wide_parity(tokens: np.ndarray) -> bytes:
    """Parity bits, one to two per token, so that sets with half of their tokens in common differ in more of them than similar ones may.

    Unlike sets of n tokens differ in half of the bits; with a quarter to a half bit per token, that was less than the 2 n / 9 that 80 % allows.
    """
    return parity_of(tokens, max(PARITY, 1 << len(tokens).bit_length())).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of tokens that two sets at least differ in, by their wide parity bits."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


_BITS = [f"p{i}" for i in range(PARITY // 64)]


_ROWS = pa.schema([(c, pa.int64()) for c in ("id", "h", "n", "f1", "f2")] + [("wide", pa.binary())] + [(p, pa.int64()) for p in _BITS])
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("rare", pa.int32())])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """At most AT_ONCE rows and the sets of their texts; the texts stay in Arrow, one at a time becomes a Python object."""
    for b in batches:
        for i in range(0, b.num_rows, AT_ONCE):
            some = b.slice(i, AT_ONCE)
            yield some, [token_set(t.as_py(), k) for t in some.column("_text")]


def _read(docs: DataFrame, k: int) -> DataFrame:
    """Rows per document (id, n, two fingerprints) and, with a null id, per batch's repeated token (f1, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, k):
            prints = [[xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed) - (1 << 63) for s in sets] for seed in (0, 1)]
            bits = np.array([parity_of(s).view(np.int64) for s in sets]).reshape(-1, len(_BITS)).T
            columns = [b.column("_id"), b.column("_h"), [len(s) for s in sets], *prints, [wide_parity(s) for s in sets], *map(np.ascontiguousarray, bits)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)
            tokens, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            heavy = counts >= LOCAL
            if heavy.any():
                known = {"n": counts[heavy], "f1": tokens[heavy].view(np.int64)}
                none, zero = {"id", "wide"}, np.zeros(int(heavy.sum()), np.int64)
                columns = [pa.nulls(len(zero), f.type) if f.name in none else pa.array(known.get(f.name, zero), f.type) for f in _ROWS]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    return docs.mapInArrow(run, "id bigint, h bigint, n bigint, f1 bigint, f2 bigint, wide binary, " + ", ".join(f"{p} bigint" for p in _BITS))


def _frequent(rows: DataFrame) -> np.ndarray:
    total = rows.where("id is not null").agg(F.sum("n")).first()[0] or 0
    counted = rows.where("id is null").groupBy("f1").agg(F.sum("n").alias("n"))
    heavy = counted.where(F.col("n") >= max(LEAST_COUNT, SHARE * total)).select("f1")
    found = np.fromiter((r[0] for r in heavy.toLocalIterator()), np.int64)
    return np.sort(found.view(np.uint64))


def _index(docs: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """``(key, id, rare)`` of every document; ``rare`` counts its rare keys, and is -1 less that count in rows of other keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=_KEYS)

        for b, sets in _sets(batches, k):
            parts, held = [], 0
            for i, tokens in zip(b.column("_id").to_numpy(), sets):
                if not len(tokens):
                    continue
                rare, other = keys_of(tokens, frequent.value, percent)
                size = len(rare) + len(other)
                mark = np.full(size, len(rare), np.int32)
                mark[len(rare) :] = -1 - len(rare)
                parts.append((np.concatenate([rare, other]).view(np.int64), np.full(size, i, np.int64), mark))
                held += size
                if held > 200_000:
                    yield batch()
                    parts, held = [], 0
            if parts:
                yield batch()

    return docs.mapInArrow(run, "key bigint, id bigint, rare int")


def _cell(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _in_bitmap(wanted, column: Column, bits: int) -> Column:
    """Whether the bitmap has the value, or another one of its cell. Only the cell's number goes to Python."""

    @F.arrow_udf("boolean")
    def found(cells: pa.Array) -> pa.Array:
        bitmap, cell = wanted.value, cells.to_numpy()
        return pa.array(((bitmap[cell >> 3] >> (cell & 7)) & 1).astype(bool))

    return found(_cell(column, bits))


def _texts(docs: DataFrame, wanted, bits: int) -> DataFrame:
    """Texts of the documents whose ids are in the bitmap."""
    asked = docs.where(_in_bitmap(wanted, F.col("_id"), bits)).select(F.col("_id").alias("id"), "_h", "_text")
    return asked.groupBy("id").agg(F.min_by("_text", "_h").alias("text"))


def _bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    cell = _cell(F.col(column), bits) + 1
    parts = values.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bitmap"], np.uint8)[: len(out) - at]
    return out


def _written(df: DataFrame) -> DataFrame:
    """``written``, and the shuffle files of the job go."""
    out = written(df)
    tidy(df.sparkSession)
    return out


def _verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union. The bits have left few pairs that fail, so the
    texts read again for it are those of documents with links and little else."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = token_set(x.as_py(), k), token_set(y.as_py(), k)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    @F.pandas_udf("boolean")
    def close(left: pd.Series, n: pd.Series, right: pd.Series, m: pd.Series) -> pd.Series:
        apart = np.array([least_difference(x, y) for x, y in zip(left, right)], np.int64)
        return pd.Series(apart * (100 + percent) <= (n + m).to_numpy() * (100 - percent))

    for side in "ab":
        pairs = pairs.join(facts.select(F.col("id").alias(side), F.col("wide").alias(f"wide_{side}"), F.col("n").alias(f"n_{side}")), side)
    pairs = _written(pairs.where(close("wide_a", "n_a", "wide_b", "n_b")).select("a", "b"))
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    wanted = texts.sparkSession.sparkContext.broadcast(_bitmap(asked, "id", bits))
    found = _texts(texts, wanted, bits)
    named = {side: found.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab"}
    met = pairs.join(named["a"], "a").join(named["b"], "b")
    with set_for(texts.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        links = met.where(similar("text_a", "text_b")).select("a", "b").checkpoint()
    wanted.unpersist()
    tidy(texts.sparkSession)
    return links


def _possible(x: str, y: str, percent: int):
    """Whether two sets of ``n`` tokens, ``u`` of them in no other class's index, can be similar enough.

    100 * intersection >= percent * union holds if the tokens in one set only are at most
    (100 - percent) / (100 + percent) of the sum of the sizes.
    """
    apart = F.bit_count(F.col(f"{x}{_BITS[0]}").bitwiseXOR(F.col(f"{y}{_BITS[0]}")))
    for p in _BITS[1:]:
        apart = apart + F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}")))
    sizes = F.col(f"{x}n") + F.col(f"{y}n")
    longer = F.col(f"{x}n") - F.col(f"{y}n")
    alone = F.least(2 * F.col(f"{x}u") - longer, 2 * F.col(f"{y}u") + longer)
    apart = F.greatest(apart, F.abs(longer), alone)
    return apart * (100 + percent) <= sizes * (100 - percent)


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, bits: int = BITS
) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    use_checkpoints(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), text_bytes(F.col(text_col)).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    read = _read(texts, k).checkpoint()
    own = read.where("id is not null")
    first = own.where("n > 0").groupBy("id").agg(F.min(F.struct("h", "f1", "f2", "n", "wide", *_BITS)).alias("s")).select("id", "s.*")
    classes = first.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    reps = classes.select("rep")
    frequent = context.broadcast(_frequent(read))

    keys = _written(_index(texts, frequent, k, percent))
    shared = _written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"))
    repeated = context.broadcast(_bitmap(shared, "key", bits))  # lets through some keys of one document, which end with it
    met = keys.where(_in_bitmap(repeated, F.col("key"), bits))
    single = _written(met.join(reps.withColumnRenamed("rep", "id"), "id", "left_semi").select("key", "id", "rare").distinct())
    repeated.unpersist()
    n_rare = F.when(F.col("rare") < 0, -1 - F.col("rare")).otherwise(F.col("rare"))
    ends = single.groupBy("key").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"), F.max("rare").alias("rare"), F.min(F.struct(n_rare, "id"))["id"].alias("hub"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    ).where("low < high")
    alike = _written(ends.groupBy("low", "high", "hub", "size", "x", "y").agg(  # of keys with the same documents one is enough
        F.min("key").alias("key"), F.sum(F.when(F.col("rare") >= 0, 1).otherwise(0)).alias("weight")
    ))
    met = join_groups(single, alike.select("key", "low", "high", "hub", "size", "weight"), "key", "size", F.col("id")).where("size > 1")
    members = _written(met.select("key", "id", "rare", "low", "high", "hub", "weight"))
    indexed = members.groupBy("id").agg(F.max("rare").alias("rare"), F.sum("weight").alias("met"))
    facts = _written(indexed.join(first, "id").select("id", "n", F.greatest(F.col("rare") - F.col("met"), F.lit(0)).alias("u"), "wide", *_BITS))

    def with_facts(rows: DataFrame, column: str, prefix: str) -> DataFrame:
        renamed = facts.select(F.col("id").alias("_id"), *(F.col(c).alias(prefix + c) for c in ("n", "u", *_BITS)))
        return rows.join(renamed, F.col(column) == F.col("_id")).drop("_id")

    led = members.select("id", F.explode(F.array_distinct(F.array("low", "high", "hub"))).alias("leader")).where("id <> leader")
    pairs = led.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    likely = with_facts(with_facts(pairs, "a", "a_"), "b", "b_").where(_possible("a_", "b_", percent)).select("a", "b")
    links = _verified(likely, facts, texts, k, percent, bits)
    parts = members.select("key", "id").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    parts = _written(parts.withColumn("component", F.coalesce("component", "id")))
    open_keys = parts.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main"), F.count("*").alias("size")
    ).where("low < high")
    rest = join_groups(parts, open_keys.select("key", "main", "size"), "key", "size", F.col("id")).where("size > 1")
    rest = with_facts(rest, "id", "")
    left, right = (rest.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "u", *_BITS, "component", "main"))) for s in "ab")
    apart = (F.col("a_component") != F.col("b_component")) & (F.col("a_component") != F.col("a_main"))
    once = (F.col("b_component") == F.col("b_main")) | (F.col("a_id") < F.col("b_id"))
    pairs = left.join(right, "key").where(apart & once & _possible("a_", "b_", percent)).select(
        F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")
    ).distinct()
    links = links.union(_verified(pairs, facts, texts, k, percent, bits))
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "size", F.coalesce("component", "rep").alias("component_id")
    )
    placed = join_groups(first, named, ["f1", "f2"], "size", F.col("id")).select("id", "component_id")
    sized = own.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    out = sized.join(placed, "id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    full = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    nulls = docs.where(F.col(id_col).isNull()).select(
        F.col(id_col).cast("bigint").alias(id_col), F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
    )
    return full.unionByName(nulls)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Documents that stay, with all their columns: of each group the one with the smallest id, and all without an id."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    gone = _written(groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(gone, "_gone", BITS))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    asked = _in_bitmap(wanted, F.col("_id").cast("bigint"), BITS)
    kept = rows.where(asked).join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return rows.where(~asked).unionByName(kept).select("_row.*")  # most texts stay where they are
