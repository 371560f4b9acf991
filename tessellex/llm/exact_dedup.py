"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one counts the filter's cells and keeps those that at least two rows hit, as bitmaps.
Pass two asks the bitmaps for each row: a row with some cell hit once has a text that no other
row has and passes straight through. Only the others, with narrow rows of id and digest,
are shuffled. A false positive is shuffled too and then found to be alone.

Defined results: a null text counts as empty and equals the empty text. Rows that share text and
id get the same decision. A null id is smaller than any other. Other columns, whatever their
names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups

#: Cells of one probe: 8 MB of bitmap at most, PROBES of them are broadcast. More rows than cells
#: make more false positives, so more rows shuffle; results do not change.
CELLS = 1 << 26
PROBES = 2


def _cell(digest: Column, probe: int, cells: int) -> Column:
    """Number of the digest's cell, from 1, in the probe's own range."""
    return F.pmod(F.xxhash64(digest, F.lit(probe)), F.lit(cells)) + F.lit(1 + probe * cells)


def repeated_cells(digests: DataFrame, column: str, cells: int, probes: int = PROBES) -> DataFrame:
    """Bitmaps ``(bucket, bitmap)`` of the cells that two rows or more hit."""
    hits = digests.select(F.explode(F.array(*(_cell(F.col(column), p, cells) for p in range(probes)))).alias("cell"))
    twice = hits.groupBy("cell").count().where("count > 1")
    return twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap")
    )


def maybe_repeated(rows: DataFrame, column: str, cells: int, bitmaps: DataFrame, probes: int = PROBES) -> DataFrame:
    """``rows`` with ``_maybe``: false if surely no other row has the same digest."""
    maybe = F.lit(True)
    out = rows
    for p in range(probes):
        cell = _cell(F.col(column), p, cells)
        part = bitmaps.select(F.col("bucket").alias(f"_b{p}"), F.col("bitmap").alias(f"_m{p}"))
        out = out.join(F.broadcast(part), F.bitmap_bucket_number(cell) == F.col(f"_b{p}"), "left")
        bit = F.bitmap_bit_position(cell)
        byte = F.substring(F.col(f"_m{p}"), (bit / 8).cast("int") + 1, F.lit(1))
        is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
        maybe = maybe & F.coalesce(is_set, F.lit(False))
    return out.select(*rows.columns, maybe.alias("_maybe"))


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    best = F.max("_id") if keep == "largest" else F.min("_id")
    return rows.groupBy("_digest").agg(best.alias("keep_id"), F.count("*").alias("group_size"))


def _digested(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.select(F.col(id_col).alias("_id"), F.unhex(digest).alias("_digest"), *(c.alias(n) for n, c in more.items()))


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, cells: int, **more: Column) -> DataFrame:
    narrow = _digested(docs, id_col, text_col)
    bitmaps = repeated_cells(narrow, "_digest", cells)
    known = maybe_repeated(_digested(docs, id_col, text_col, **more), "_digest", cells, bitmaps)
    asked = maybe_repeated(narrow, "_digest", cells, bitmaps).where("_maybe")
    alone = known.where("not _maybe").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("bigint")})
    met = join_groups(known.where("_maybe"), _groups(asked, keep), "_digest", "group_size", F.col("_id"))
    return alone.unionByName(met)


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", cells: int = CELLS
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and the text's SHA-256."""
    out = _decided(docs, id_col, text_col, keep, cells)
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", cells: int = CELLS
) -> DataFrame:
    """The documents that stay, with all their columns."""
    out = _decided(docs, id_col, text_col, keep, cells, _row=F.struct("*"))
    return out.where(F.col("_id").eqNullSafe(F.col("keep_id"))).select("_row.*")
