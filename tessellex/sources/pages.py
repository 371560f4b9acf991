"""Pages: splitting texts, paragraphs and extraction passes into pages, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators.sessions import running_index


def _line_pages(text: Column, size: int) -> Column:
    lines = F.split(text, fv.LINE_BREAKS)
    count = F.ceil(F.size(lines) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda p: F.array_join(F.slice(lines, p * size + 1, F.lit(size)), "\n"),
    )


def _raw_pages(text: Column, lines_per_page: int) -> Column:
    return F.when(F.contains(text, F.lit("\f")), F.split(text, "\f")).otherwise(_line_pages(text, lines_per_page))


def page_list(text: Column, lines_per_page: int = fv.LINES_PER_PAGE) -> Column:
    """The pages of ``split_pages`` as ``ARRAY<STRUCT<page_no, text>>`` in the document's row."""
    numbered = F.transform(
        _raw_pages(text, lines_per_page), lambda p, i: F.struct((i + 1).alias("page_no"), tx.strip(p).alias("text"))
    )
    return F.filter(numbered, lambda p: F.length(p["text"]) > 0)


def split_pages(docs: DataFrame, lines_per_page: int = fv.LINES_PER_PAGE) -> DataFrame:
    """``(doc columns, page_no, text)``: at form feeds, else every 60 lines.

    Blank pages are dropped; the other pages keep their numbers. Narrow.
    """
    text = F.col("text")
    pages = _raw_pages(text, lines_per_page)
    others = [c for c in docs.columns if c != "text"]
    return (
        docs.select(*others, F.posexplode(pages).alias("pos", "page"))
        .select(*others, (F.col("pos") + 1).alias("page_no"), tx.strip(F.col("page")).alias("text"))
        .where(F.length("text") > 0)
    )


def paragraph_pages(paragraphs: DataFrame, size: int = fv.PARAGRAPHS_PER_PAGE) -> DataFrame:
    """Pages of 40 paragraphs from ``(doc_id, pos, kind, level, text, cells)``.

    ``kind`` is header, footer, heading, body or table; headers come first,
    tables last. A document of any length is numbered bucket by bucket.
    """
    text = tx.strip(F.col("text"))
    cells = F.filter(F.transform("cells", tx.strip), lambda c: c != "")
    line = (
        F.when(F.col("kind").isin("header", "footer"), F.concat(F.lit("[HEADER] "), text))
        .when(
            F.col("kind") == "heading",
            F.concat(F.lit("\n"), F.expr("repeat('#', coalesce(level, 1))"), F.lit(" "), text, F.lit("\n")),
        )
        .when(F.col("kind") == "table", F.array_join(cells, " | "))
        .otherwise(text)
    )
    filled = F.when(F.col("kind") == "table", F.size(cells) > 0).otherwise(F.length(text) > 0)
    order = F.when(F.col("kind").isin("header", "footer"), 0).when(F.col("kind") == "table", 2).otherwise(1)
    rows = paragraphs.where(filled).select("doc_id", "pos", order.alias("_part"), line.alias("line"))
    indexed = running_index(rows, ["doc_id"], "pos", "idx", group=F.col("_part"))
    page = (F.floor(F.col("idx") / size) + 1).cast("int")
    return (
        indexed.groupBy("doc_id", page.alias("page_no"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("_l"))
        .select("doc_id", "page_no", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
    )


def merge_extracts(extracts: DataFrame, min_chars: int = fv.MIN_PAGE_CHARS) -> DataFrame:
    """Best text per page from ``(doc_id, page_no, pass, text)``.

    Pass 1 is kept unless it is missing or short; pass 2 is looked at only for
    documents with a short or no page after pass 1; pass 3 (recognition) only
    adds pages that both lack, again only for incomplete documents.
    """
    by_pass = lambda n: F.max(F.when(F.col("pass") == n, F.col("text")))
    pages = extracts.groupBy("doc_id", "page_no").agg(
        by_pass(1).alias("p1"), by_pass(2).alias("p2"), by_pass(3).alias("p3")
    )
    short = lambda c: c.isNotNull() & (F.length(tx.strip(c)) < min_chars)
    mixed = F.when(F.length(tx.strip(F.col("p1"))) >= min_chars, F.col("p1")).otherwise(
        F.coalesce("p2", "p1")
    )
    pages = pages.withColumn("p12", mixed)

    def incomplete(c: str) -> Column:
        return F.bool_or(short(F.col(c))) | ~F.bool_or(F.col(c).isNotNull())

    flags = pages.groupBy("doc_id").agg(
        incomplete("p1").alias("need2"), incomplete("p12").alias("need3")
    )
    merged = F.when(F.col("need2"), F.col("p12")).otherwise(F.col("p1"))
    # need3 only matters when need2 holds: otherwise pass 1 is already complete.
    text = F.coalesce(merged, F.when(F.col("need2") & F.col("need3"), F.col("p3")))
    return (
        pages.join(flags.hint("merge"), "doc_id")
        .select("doc_id", "page_no", text.alias("text"))
        .where(F.col("text").isNotNull())
    )


def assemble_text(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: page texts in order, joined by form feeds, blank ones skipped."""
    return (
        pages.where(tx.blank_to_null(F.col("text")).isNotNull())
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("_p"))
        .select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\f").alias("text"))
    )
