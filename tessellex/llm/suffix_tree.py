"""Language model scores from a probabilistic suffix tree over words.

Symbols are the tokens: lower-cased words and one end per text; a context is the run of up to DEPTH tokens
before a symbol, with a start mark before the first. The tree grows by levels. A run of tokens stays if the
training texts have it LEAST times, whatever their size, so the tree grows with the corpus. A context is
retained if its next-symbol distribution diverges from that of the longest retained suffix: count times
Kullback-Leibler divergence exceeds DIVERGENCE nats and a price per symbol kept. Symbols without a kept count
share what is left of the context's mass, plus BETA, as its suffix spreads them. The root spreads symbols by
add-one counts of tokens. A symbol is scored by the longest retained suffix of what precedes it; that is the
root's logarithm plus a correction from the tree.

Runs are Spark tables by 64-bit hash; contexts are decided by aggregates and joins on them. The correction of
a text is a sum over its runs: a run has a value, what its last symbol gains under its context over the context's
suffix and spread, plus the spread that it has as a context itself. Values of runs with a share of P_MIN of all tokens
and counts of words with a share of P_WORD, 1 / P_MIN by length and 1 / P_WORD at most, are broadcast to save
shuffling. The others are dealt out by hash to shards of SHARD values or less; texts ask in packs, one row for each pack
and shard with the distinct hashes in order, and a task reads a shard's values, then streams what is asked of it. A bitmap of at most BITS bits says which runs
have values; more runs give more false positives, never other scores.

Defined results: a null text is empty: one end token. Rows with the same id each get a row, also those with the same
text. Without training documents all probabilities are 1. A null id folds as empty text. An empty table gives no rows. A
long text is one of a pack and never cut. Other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessellex.llm.common import lower_words, text_bytes, use_checkpoints, written

DEPTH = 3
P_WORD = 1e-5
P_MIN = 2e-6
LEAST = 4
DIVERGENCE = 8.0
PRICE = 2.0
BETA = 1.0
BITS = 1 << 27
FLUSH = 100_000  # distinct words a task counts before it passes them on
TEXTS = 250  # texts that a task holds as words at a time
CHARS = 1_000_000  # and bytes of these, but for a longer single text
PAIRS = 1_000_000  # pairs of text and hash that a task gathers before it sends them
SHARDS = 16  # least number of shards of the shuffled values
SHARD = 1 << 22  # values of a shard that a task holds, 64 MB

# Hashes of the marks.
START, END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _slices(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[pd.DataFrame]:
    """Rows in frames of at most ``times`` TEXTS and CHARS; the rest of a batch stays in Arrow."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            full = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + times * CHARS, "right"))
            z = min(a + times * TEXTS, max(a + 1, full))
            yield b.slice(a, z - a).to_pandas()
            a = z


def _batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)


_RUNS = pa.schema([(c, pa.int64()) for c in ("context", "suffix", "n")])
_COUNT_FIELDS = [("key", pa.int64()), ("key2", pa.int64()), ("id", pa.string()), ("learned", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())]
_ASKED = pa.schema([("shard", pa.int64()), ("step", pa.int32()), *_COUNT_FIELDS[:2], ("value", pa.float64()), ("pack", pa.binary()), *_COUNT_FIELDS[2:]])
_ADDED = pa.schema(_COUNT_FIELDS)


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over the texts in ``_text``; each task adds up its own before the shuffle."""

    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()
        for some in _slices(batches):
            for text in some["_text"]:
                have.update(lower_words(text))
                if len(have) > FLUSH:
                    yield _batch(pd.DataFrame({"word": list(have), "n": list(have.values())}), schema)
                    have.clear()
        if have:
            yield _batch(pd.DataFrame({"word": list(have), "n": list(have.values())}), schema)

    return docs.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a run from those of the run without its last and the run without its first symbol."""
    x = context * np.uint64(0xBF58476D1CE4E5B9) + suffix * np.uint64(0x94D049BB133111EB) + np.uint64(1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return pd.util.hash_array(out, categorize=False)


def hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbols of the texts one after another, each between its marks, and their places in the text."""
    sizes = np.array([len(words) for words in texts], np.int64) + 2
    stops = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint64)
    place = np.arange(len(out)) - np.repeat(stops - sizes, sizes)
    out[stops - sizes], out[stops - 1] = np.uint64(START), np.uint64(END)
    inner = np.ones(len(out), bool)
    inner[stops - sizes] = inner[stops - 1] = False
    out[inner] = word_hashes([w for words in texts for w in words])
    return out, place


def longer(runs: np.ndarray) -> np.ndarray:
    """Hashes of the runs one symbol longer that end at each place; void where the text has begun since."""
    out = np.zeros(len(runs), np.uint64)
    out[1:] = mixed(runs[:-1], runs[1:])
    return out


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``key``, ``bits / 8`` bytes whatever the number of rows."""
    cell = F.pmod(F.col("key"), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bitmap"], np.uint8)[: len(out) - at]
    return out


def _may_have(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


@F.pandas_udf(LongType())
def _word_key(words: pd.Series) -> pd.Series:
    return pd.Series(word_hashes([bytes(w) for w in words]).view(np.int64))


@F.pandas_udf(LongType())
def _run_key(context: pd.Series, suffix: pd.Series) -> pd.Series:
    return pd.Series(mixed(context.to_numpy(np.int64).view(np.uint64), suffix.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def _count_runs(docs: DataFrame, shared, size: int) -> DataFrame:
    """``(context, suffix, n)`` of the runs of ``size`` symbols whose context and suffix may have been kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for some in _slices(batches, 4):
            runs, place = hashed([lower_words(t) for t in some["_text"]])
            for _ in range(size - 2):
                runs = longer(runs)
            kept = _may_have(bitmap, runs)
            at = np.flatnonzero(kept[1:] & kept[:-1] & (place[1:] >= size - 1)) + 1
            if not len(at):
                continue
            _, first, n = np.unique(mixed(runs[at - 1], runs[at]), return_index=True, return_counts=True)
            at = at[first]
            yield _batch(pd.DataFrame({"context": runs[at - 1].view(np.int64), "suffix": runs[at].view(np.int64), "n": n}), _RUNS)

    counted = docs.mapInArrow(run, "context bigint, suffix bigint, n bigint")
    return counted.groupBy("context", "suffix").agg(F.sum("n").alias("n"))


def decide(runs: DataFrame, before: DataFrame) -> DataFrame:
    """``runs(key, context, suffix, n)`` with ``root``, ``gain``, ``spread`` and ``value``.

    ``before(key, n, root, gain)`` has the runs one symbol shorter. ``root`` is the logarithm of the last symbol's
    probability by the root, ``gain`` that of its probability after the context over the root's. ``spread`` is the mass that a
    retained context leaves to its suffix, null for others; ``value`` is what the run adds to the score.
    """
    shorter = before.select(F.col("key").alias("suffix"), "root", F.col("gain").alias("_gain"))
    met = runs.join(shorter, "suffix").withColumn("_under", F.least(F.pow(F.lit(10.0), F.col("_gain") + F.col("root")), F.lit(1.0)))
    sums = met.groupBy("context").agg(
        F.sum("n").alias("_kept"), F.sum("_under").alias("_mass"), F.count("*").alias("_symbols"),
        F.sum(F.col("n") * F.ln(F.col("n") / F.col("_under"))).alias("_nats"),
    )
    total = F.greatest("_n", "_kept")
    left = total - F.col("_kept")
    tail = F.when(left > 0, left * F.ln(left / total / F.greatest(F.lit(1e-12), 1 - F.col("_mass")))).otherwise(0.0)
    nats = F.col("_nats") - F.col("_kept") * F.ln(total) + tail
    rest = left + F.lit(BETA)
    retained = (
        sums.join(before.select(F.col("key").alias("context"), F.col("n").alias("_n")), "context")
        .where(nats >= DIVERGENCE + PRICE * F.col("_symbols"))
        .select("context", rest.alias("_rest"), (F.col("_kept") + rest).alias("_all"), F.log10(rest / (F.col("_kept") + rest)).alias("spread"))
    )
    own = F.log10((F.col("n") + F.col("_rest") * F.col("_under")) / F.col("_all")) - F.col("root")
    return (
        met.join(retained, "context", "left")
        .withColumn("gain", F.when(F.col("spread").isNotNull(), own).otherwise(F.col("_gain")))
        .withColumn("value", F.when(F.col("spread").isNotNull(), F.col("gain") - F.col("_gain") - F.col("spread")).otherwise(0.0))
        .select("key", "context", "n", "root", "gain", "spread", "value")
    )


def grow(docs: DataFrame, words: DataFrame, texts: int, tokens: int, distinct: int) -> DataFrame:
    """``(key, n, value)`` of the runs that add to a score; ``words(key, n)`` has the counts of all words."""
    spark = docs.sparkSession
    marks = spark.createDataFrame([(int(np.uint64(m).view(np.int64)), texts) for m in (START, END)], "key bigint, n bigint")
    root = F.log10((F.col("n") + 1) / F.lit(float(tokens + distinct + 1)))
    before = words.where(F.col("n") >= LEAST).unionByName(marks).withColumns({"root": root, "gain": F.lit(0.0)})
    parts = [marks.select("key", "n", F.lit(0.0).alias("value")).limit(0)]
    for size in range(2, DEPTH + 2) if texts else ():
        shared = spark.sparkContext.broadcast(_bitmap(before, BITS))
        counted = _count_runs(docs, shared, size).where(F.col("n") >= LEAST)
        runs = written(counted.withColumn("key", _run_key("context", "suffix")))
        shared.unpersist()
        level = written(decide(runs, before))
        parts.append(level.where("value <> 0").select("key", "n", "value"))
        spread = level.where("spread is not null").groupBy("context").agg(F.first("spread").alias("value"))
        parts.append(spread.join(before.select(F.col("key").alias("context"), "n"), "context").select(F.col("context").alias("key"), "n", "value"))
        before = level.select("key", "n", "root", "gain")
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value"))


def _arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the rows, and their values."""
    found = [(r["key"], r[value]) for r in rows.select("key", value).toLocalIterator()]
    keys = np.array([k for k, _ in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([v for _, v in found], float)[order]


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values of the keys in the table, nan for others."""
    have, values = table
    if not len(have):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, values[at], np.nan)


_COUNTS = ["key", "key2", "id", "learned", "n", "known", "base", "gain"]
_COUNTS_TYPE = "id string, learned boolean, n bigint, known bigint, base double, gain double"


def squeeze(arrays: list[np.ndarray]) -> bytes:
    """Unsigned 64-bit arrays as one compressed value; equal bytes of neighbours stand together."""
    sizes = np.array([len(a) for a in arrays], "<u8").tobytes()
    body = b"".join(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return sizes + zstandard.compress(body, 1)


def unsqueeze(packed: bytes, count: int) -> list[np.ndarray]:
    sizes = np.frombuffer(packed, "<u8", count).astype(np.int64)
    body = np.frombuffer(zstandard.decompress(packed[8 * count :]), np.uint8)
    stops = 8 * np.cumsum(sizes)
    return [body[z - 8 * n : z].reshape(8, -1).T.copy().view("<u8").ravel() for n, z in zip(sizes.tolist(), stops.tolist())]


def shard_of(hashes, shards: int):
    """Shard of signed 64-bit hashes, an array or a column: equal ranges, so that sorted hashes lie shard by shard."""
    high = F.shiftright(hashes, 32) if isinstance(hashes, Column) else hashes >> 32
    scaled = (high + (1 << 31)) * shards
    return F.shiftright(scaled, 32) if isinstance(hashes, Column) else scaled >> 32


class _Pack:
    """What many texts ask of the shuffled values, one row for each shard of the hashes."""

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        self.keys, self.asked, self.docs, self.pairs = [], ([], []), 0, 0

    def add(self, k1: np.ndarray, k2: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        for doc, hashes, kind in asked:
            self.asked[kind].append((doc + self.docs, hashes))
            self.pairs += len(doc)
        self.keys.append((k1, k2))
        self.docs += len(k1)

    def rows(self) -> pd.DataFrame:
        """A row per shard: the texts that ask it, its distinct hashes in order, how many askers each has, and these."""
        k1, k2 = (np.concatenate(x) for x in zip(*self.keys))
        out = []
        for kind, parts in enumerate(self.asked):
            doc, hashes = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            hashes = hashes.view(np.int64)
            order = np.argsort(hashes)
            doc, hashes = doc[order], hashes[order]
            shard = shard_of(hashes, self.shards)
            edges = (np.flatnonzero(np.diff(shard)) + 1).tolist()
            for a, z in zip([0, *edges], [*edges, len(shard)]) if len(shard) else ():
                at = np.flatnonzero(np.diff(hashes[a:z], prepend=hashes[a] - 1))
                which, local = np.unique(doc[a:z], return_inverse=True)
                steps = np.diff(hashes[a:z][at].view(np.uint64), prepend=np.uint64(0))
                packed = squeeze([k1[which].view(np.uint64), k2[which].view(np.uint64), steps, np.diff(np.append(at, z - a)), local])
                out.append((2 * int(shard[a]) + kind, packed))
        self.clear()
        rows = pd.DataFrame(out, columns=["shard", "pack"])
        nothing = {"id": None, "learned": None, "n": None, "known": None, "base": None, "gain": None}
        return rows.assign(step=2, key=np.int64(0), key2=np.int64(0), value=0.0, **nothing)[["shard", "step", "key", "key2", "value", "pack", *_COUNTS[2:]]]


def _sorted_table(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0)
    keys, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    return keys[order], values[order]


def _answers(packed: bytes, table: tuple[np.ndarray, np.ndarray], is_run: bool) -> pd.DataFrame:
    """What the values of one shard add to each text of a pack."""
    k1, k2, steps, counts, doc = unsqueeze(packed, 5)
    value = np.repeat(_look_up(table, np.cumsum(steps, dtype=np.uint64)), counts.astype(np.int64))
    found = ~np.isnan(value)
    doc = doc[found].astype(np.int64)
    adds = np.bincount(doc, value[found], len(k1))
    known = np.bincount(doc, minlength=len(k1))
    some = np.flatnonzero(known)
    zero = np.zeros(len(some))
    return pd.DataFrame({"key": k1[some].view(np.int64), "key2": k2[some].view(np.int64), "id": None, "learned": None, "n": None, "known": (zero if is_run else known[some]).astype(np.int64), "base": zero if is_run else adds[some], "gain": adds[some] if is_run else zero})


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn: Column) -> DataFrame:
    """One row per document: id, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``learn`` marks the documents that the model learns from.
    """
    use_checkpoints(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("string").alias("_doc"), learn.alias("_learn"), text_bytes(F.col(text_col)).alias("_text"))
    lessons = texts.where("_learn").select("_text")
    words = written(count_words(lessons).select(_word_key("word").alias("key"), "n"))
    n_texts = lessons.count()
    sums = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, tokens = sums[0] + (n_texts > 0), sums[1] + n_texts
    values = written(grow(lessons, words, n_texts, tokens, distinct))
    often_word, often_run = F.col("n") >= max(1.0, P_WORD * tokens), F.col("n") >= P_MIN * tokens
    logs = F.log10(F.col("n") + 1)
    bitmap = _bitmap(values, BITS)
    shared = context.broadcast((_arrays(words.where(often_word).withColumn("log", logs), "log"), _arrays(values.where(often_run), "value"), bitmap))
    end_known, end_log = int(n_texts > 0), math.log10(n_texts + 1)
    rest = words.where(~often_word).select("key", F.lit(0).alias("_run"), logs.alias("value")).unionByName(
        values.where(~often_run).select("key", F.lit(1).alias("_run"), "value")
    )
    shards = max(SHARDS, -(-rest.count() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values, bitmap = shared.value
        pack = _Pack(shards)
        for some in _slices(batches):
            runs, place = hashed([lower_words(t) for t in some["_text"]])
            doc = np.cumsum(place == 0) - 1
            inner = (runs != np.uint64(START)) & (runs != np.uint64(END))
            log = np.full(len(runs), np.nan)
            log[inner] = _look_up(words, runs[inner])
            rare = inner & np.isnan(log)
            asked = [(doc[rare], runs[rare], 0)]
            gain = np.zeros(len(some))
            for size in range(1, DEPTH + 2):
                at = np.flatnonzero(_may_have(bitmap, runs) & (place >= size - 1))
                value = _look_up(values, runs[at])
                gain += np.bincount(doc[at], np.nan_to_num(value), len(some))
                at = at[np.isnan(value)]
                asked.append((doc[at], runs[at], 1))
                runs = longer(runs)
            known = np.bincount(doc[inner & ~rare], minlength=len(some)) + end_known
            base = np.bincount(doc, np.nan_to_num(log), len(some)) + end_log
            k1, k2 = some["_k1"].to_numpy(np.int64), some["_k2"].to_numpy(np.int64)
            yield _batch(pd.DataFrame({"shard": k1 % (2 * shards), "step": 0, "key": k1, "key2": k2, "value": 0.0, "pack": None, "id": some["_doc"].to_numpy(), "learned": some["_learn"].to_numpy(), "n": np.bincount(doc, minlength=len(some)) - 1, "known": known, "base": base, "gain": gain}), _ASKED)
            pack.add(k1, k2, asked)
            if pack.pairs > PAIRS:
                yield _batch(pack.rows(), _ASKED)
        if pack.pairs:
            yield _batch(pack.rows(), _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, table = None, [], None
        for b in batches:
            place, step = b.column("shard").to_numpy(), b.column("step").to_numpy()
            edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(step) != 0)) + 1
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(place)]) if len(place) else ():
                some = b.slice(a, z - a)
                if place[a] != shard:
                    shard, parts, table = place[a], [], None
                if step[a] == 0:
                    yield some.select(_ADDED.names)
                elif step[a] == 1:  # copies, so that the batch goes
                    parts.append((np.array(some.column("key")).view(np.uint64), np.array(some.column("value"))))
                else:
                    if table is None:
                        table = _sorted_table(parts)
                        parts = []
                    for packed in some.column("pack"):
                        yield _batch(_answers(packed.as_py(), table, shard % 2 > 0), _ADDED)

    # The same text under the same id has the same key in every attempt of a task, whatever the order of its input.
    keyed = texts.withColumns({"_k1": F.xxhash64("_doc", "_text"), "_k2": F.hash(F.lit(1), "_text", "_doc").cast("bigint")})
    parts = keyed.mapInArrow(run, "shard bigint, step int, key bigint, key2 bigint, value double, pack binary, " + _COUNTS_TYPE)
    sent = rest.select((2 * shard_of(F.col("key"), shards) + F.col("_run")).cast("bigint").alias("shard"), F.lit(1).alias("step"), "key", "value")
    met = parts.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "step")
    summed = met.mapInArrow(answer, "key bigint, key2 bigint, " + _COUNTS_TYPE).groupBy("key", "key2").agg(
        F.max("id").alias("id"), F.max("learned").alias("learned"), F.max("n").alias("n"), F.count("n").alias("copies"),
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("gain").alias("gain"),
    )
    each = summed.withColumns({c: F.col(c) / F.col("copies") for c in ("known", "base", "gain")})
    each = each.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    norm = math.log10(tokens + distinct + 1)
    base = F.col("base") - F.col("n") * F.lit(norm)
    return each.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "learned", F.col("n").alias("n_tokens"),
        F.round("known").cast("bigint").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )
