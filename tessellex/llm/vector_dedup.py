"""Near duplicates among vectors by Euclidean p-stable hashing.

Vectors are scaled to length one and projected on Gaussian directions; a table's key is a tuple of
DEPTH projections, each shifted at random and quantised to WIDTH. Vectors at a small angle agree in
some of the TABLES with high probability, others hardly ever. Equal vectors are one class from the
start. Buckets with one class are dropped on their keys alone, and of buckets with the same classes all but one; vectors travel only to the others,
where cosines are computed exactly in blocks. A pair counts in the first table in which it meets.

A pair at the threshold's cosine 0.93 agrees in one projection with probability 0.85, in a table with
0.85**16 = 0.075 and in none of 96 tables with 0.0006; closer pairs are missed far more rarely.

Buckets of any size are cut into blocks of BLOCK classes, and a task compares two blocks; it returns
sums per class and a star over each connected part, so no list of pairs is ever made.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no
links and are their own component, and so are vectors without a label. Vectors of different length
never link. Rows that share an id are one class if equal, else they link like others. Vectors of any finite magnitude
are scaled by a power of two first. An empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups, use_checkpoints
from tessellex.llm.components import components

TABLES = 96
DEPTH = 16
WIDTH = 2.0
BLOCK = 1024
SEED = 20

_drawn: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _draws(size: int, tables: int, depth: int, width: float, seed: int):
    key = (size, tables, depth, width, seed)
    if key not in _drawn:
        rng = np.random.default_rng([seed, size])
        directions = rng.standard_normal((size, tables * depth))
        shifts = rng.uniform(0, width, tables * depth)
        odd = rng.integers(1, 1 << 62, tables * depth, dtype=np.uint64) | np.uint64(1)
        _drawn.clear()
        _drawn[key] = directions, shifts, odd
    return _drawn[key]


def keys_of(unit: np.ndarray, tables: int = TABLES, depth: int = DEPTH, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """64-bit keys, one row per vector and one column per table."""
    directions, shifts, odd = _draws(unit.shape[1], tables, depth, width, seed)
    cells = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    mixed = (cells * odd).reshape(len(unit), tables, depth).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _units(column: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) connect with it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rows: pd.DataFrame, threshold: float, tables: int, depth: int, width: float) -> pd.DataFrame:
    """Links within each group of rows: sums per row, and a star over each connected part."""
    unit = _units(rows["_vector"])
    keys = np.concatenate([keys_of(u, tables, depth, width) for u in np.array_split(unit, max(1, len(unit) // 512))])
    rep, size, own, t = (rows[c].to_numpy() for c in ("rep", "size", "own", "t"))
    mixed = (rows["low"] != rows["high"]).to_numpy()
    new = np.ones(len(rows), bool)
    marks = rows[["bucket", "low", "high"]].to_numpy()
    new[1:] = (marks[1:] != marks[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(rows)))
    found_a, found_b = [], []
    for m in np.unique(count[count > 1]):
        groups = start[count == m]
        for some in np.array_split(groups, max(1, len(groups) * m * m // 2_000_000)):
            at = some[:, None] + np.arange(m)
            near = unit[at] @ unit[at].transpose(0, 2, 1) >= threshold
            g, i, j = np.nonzero(near & (np.arange(m)[:, None] < np.arange(m)))
            a, b = at[g, i], at[g, j]
            fit = ~mixed[a] | (own[a] != own[b])
            a, b = a[fit], b[fit]
            for few in np.array_split(np.arange(len(a)), max(1, len(a) // 20_000)):
                met = (keys[a[few]] == keys[b[few]]) & (np.arange(tables) < t[a[few], None])
                fresh = ~met.any(axis=1)
                found_a.append(a[few][fresh])
                found_b.append(b[few][fresh])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate(found_a or [none]), np.concatenate(found_b or [none])
    links = np.bincount(a, size[b], len(rows)) + np.bincount(b, size[a], len(rows))
    some = np.flatnonzero(links)
    peer = _smallest(a, b, len(rows))
    return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "peer": rep[peer[some]]})


def _by_size(rows: pd.DataFrame, *how) -> Iterator[pd.DataFrame]:
    """``_compare`` for vectors of each size; a bucket holds one size only."""
    sizes = rows["_vector"].map(len).to_numpy()
    for size in np.unique(sizes):
        yield _compare(rows[sizes == size], *how)


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    tables: int = TABLES,
    depth: int = DEPTH,
    width: float = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``."""
    use_checkpoints(vectors.sparkSession)
    double = F.col(vector_col).cast("array<double>")
    sound = (
        (F.size(double) > 0)
        & F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(double, lambda v: v != 0)
        & F.col(label_col).isNotNull()
        & F.col(id_col).isNotNull()
    )
    rows = vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector"), F.coalesce(sound, F.lit(False)).alias("_sound")
    )
    usable = rows.where("_sound").select("_id", "_label", "_vector", F.sha2(F.to_json(F.struct("_label", "_vector")), 256).alias("_same"))
    classes = usable.groupBy("_same").agg(F.min("_id").alias("rep"), F.count("*").alias("size"))
    firsts = usable.groupBy("_same").agg(
        F.min("_id").alias("rep"), F.count("*").alias("size"), F.first("_label").alias("_label"), F.first("_vector").alias("_vector")
    ).drop("_same").checkpoint()

    @F.pandas_udf("array<bigint>")
    def tables_of(column: pd.Series) -> pd.Series:
        out = [None] * len(column)
        sizes = column.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for some in np.array_split(at, max(1, len(at) // 2048)):
                for i, k in zip(some, keys_of(_units(column.iloc[some]), tables, depth, width)):
                    out[i] = k
        return pd.Series(out, dtype=object)

    keyed = firsts.select("rep", "_label", F.size("_vector").alias("_n"), tables_of("_vector").alias("_keys"))
    entries = keyed.select("rep", F.posexplode("_keys").alias("t", "key"), "_label", "_n").select(
        "rep", F.xxhash64("t", "key", "_label", "_n").alias("bucket"), "t"
    )
    met_in = entries.groupBy("bucket", "t").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")
    )
    alike = met_in.where("members > 1").groupBy("members", "x", "y").agg(F.min_by("bucket", "t").alias("bucket"))
    met = join_groups(entries, alike.select("bucket", "members"), "bucket", "members", F.col("rep")).where("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = met.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    to_pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "bucket", "t", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )
    carried = to_pairs.join(firsts, "rep").select("bucket", "t", "low", "high", "own", "rep", "size", "_vector")
    order = ["bucket", "low", "high"]
    dealt = carried.repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest) < 4 * block:
                continue
            last = rest[order].iloc[-1]
            cut = len(rest) - int((rest[order] == last).all(axis=1).sum())
            if cut:
                yield from _by_size(rest.iloc[:cut], threshold, tables, depth, width)
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from _by_size(rest, threshold, tables, depth, width)

    compared = dealt.mapInPandas(compare, "rep bigint, links bigint, peer bigint").checkpoint()
    linked = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    tree = components(compared.where("rep <> peer").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    told = (
        classes.join(linked, "rep", "left")
        .join(tree.withColumnRenamed("node", "rep"), "rep", "left")
        .select("_same", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    good = join_groups(usable.select("_id", "_same"), told, "_same", "size", F.col("_id"))
    lone = rows.where("not _sound").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    out = good.select("_id", "n_links", "component_id").unionByName(lone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
