"""Section chunker, structure-aware chunker and sliding splitter.

All chunkers are narrow: a document row becomes its chunk rows without a
shuffle, offsets included. Offsets are 0-based, ends exclusive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import extract as ex
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx

_SECTION = rx.java(fv.SECTION_HEADER, multiline=True)
_CHAPTER = rx.java(fv.CHAPTER_LINE, ignore_case=True, multiline=True)
_CHAPTER_TITLE = rx.java(fv.CHAPTER_LINE_TITLE, ignore_case=True)
_STARTS_AT_BOUNDARY = rx.java(r"\A" + fv.STRUCTURE_BOUNDARY, ignore_case=True)
_BOUNDARY = rx.java(f"(?={fv.STRUCTURE_BOUNDARY})", ignore_case=True, multiline=True)


def chunk_id(doc_hash: Column, index: Column) -> Column:
    """Stable id: the same content chunked again gives the same ids."""
    return F.sha2(F.concat_ws("|", doc_hash, index.cast("string")), 256)


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def section_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per statutory section of every document; sections are never cut.

    Text before the first header is dropped; a document without headers is one
    chunk. The chapter of a section is the last chapter heading before it.
    """
    body = F.col(text)
    heads = docs.where(tx.blank_to_null(body).isNotNull()).select(
        "*",
        rx.find_spans(body, _SECTION).alias("_heads"),
        rx.find_spans(body, _CHAPTER).alias("_chapters"),
    )

    def section(head: Column, i: Column) -> Column:
        start = head["start"]
        following = F.get("_heads", i + 1)["start"]
        before = F.filter(
            "_chapters", lambda c: c["start"] + F.length(c["match"]) <= start
        )
        return F.struct(
            start.alias("start_char"),
            F.coalesce(following, F.length(body)).alias("end_char"),
            head["match"].alias("header"),
            F.try_element_at(before, F.lit(-1)).alias("chapter"),
        )

    whole = F.array(
        F.struct(
            F.lit(0).alias("start_char"),
            F.length(body).alias("end_char"),
            F.lit(None).cast("string").alias("header"),
            F.lit(None).cast("struct<start:int,match:string>").alias("chapter"),
        )
    )
    sections = F.when(F.size("_heads") > 0, F.transform("_heads", section)).otherwise(whole)
    rows = heads.select(*docs.columns, F.posexplode(sections).alias("chunk_index", "_s"))
    header = F.col("_s.header")
    heading = F.regexp_extract(F.col("_s.chapter.match"), _CHAPTER, 1)
    chapter_at = F.col("_s.chapter.start") + F.length("_s.chapter.match") - F.length(heading)
    chapter_text = _slice(body, chapter_at, F.col("_s.start_char"))
    return rows.select(
        *docs.columns,
        "chunk_index",
        F.col("_s.start_char").alias("start_char"),
        F.col("_s.end_char").alias("end_char"),
        tx.strip(_slice(body, F.col("_s.start_char"), F.col("_s.end_char"))).alias("content"),
        rx.extract(F.col("_s.chapter.match"), _CHAPTER, 2).alias("chapter_number"),
        rx.extract(chapter_text, _CHAPTER_TITLE, 1).alias("chapter_name"),
        rx.extract(header, _SECTION, 1).alias("section_number"),
        F.nullif(tx.strip(rx.extract(header, _SECTION, 2)), F.lit("")).alias("section_title"),
    )


def section_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows of ``section_chunks`` and their characters at most, without cutting any."""
    count = F.greatest(F.size(rx.extract_all(F.col(text), _SECTION)), F.lit(1)).cast("long")
    found = docs.agg(F.sum(count).alias("n"), F.sum(F.length(text).cast("long")).alias("chars")).first()
    return found["n"] or 0, found["chars"] or 0


def section_list(text: Column) -> Column:
    """Number and title of every section of ``section_chunks`` as an array in the document's row."""
    none = F.lit(None).cast("string")
    of = lambda i, number, title: F.struct(i.alias("section_id"), number.alias("section_number"), title.alias("section_title"))
    named = F.transform(
        rx.extract_all(text, _SECTION),
        lambda head, i: of(i, rx.extract(head, _SECTION, 1), F.nullif(tx.strip(rx.extract(head, _SECTION, 2)), F.lit(""))),
    )
    return rx.let(named, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(of(F.lit(0), none, none))))


def sub_elements(content: Column) -> dict[str, Column]:
    """Provisos, explanations, illustrations, exceptions and sub-sections as arrays."""

    def blocks(pattern: str) -> Column:
        return F.transform(rx.extract_all(content, rx.java(pattern, ignore_case=True)), tx.strip)

    line = rx.java(fv.SUB_SECTION_LINE, multiline=True)
    numbered = F.transform(
        rx.extract_all(content, line),
        lambda m: F.concat(
            F.lit("("),
            F.regexp_extract(m, line, 1),
            F.lit(") "),
            tx.strip(F.regexp_extract(m, line, 2)),
        ),
    )
    return {
        "provisos": blocks(fv.PROVISO),
        "explanations": blocks(fv.EXPLANATION),
        "illustrations": blocks(fv.ILLUSTRATION),
        "exceptions": blocks(fv.EXCEPTION),
        "sub_sections": numbered,
    }


def enrich_sections(chunks: DataFrame) -> DataFrame:
    """Merge header values, extracted values and document values of section chunks.

    Needs ``section_chunks`` output over documents with ``title``, ``year`` and
    ``tags`` columns; the act named in the document's first characters comes
    first, then the one found in the section, then the document title.
    """
    parts = sub_elements(F.col("content"))
    act = ex.act_name_year(F.left(F.col("text"), F.lit(fv.HEADER_CHARS)))
    staged = chunks.select(
        "*", act.alias("_act"), *[c.alias(n) for n, c in parts.items()]
    )
    # One column per part: those that the chunks don't take are never extracted.
    facts = staged.select("*", *[c.alias(f"x_{n}") for n, c in ex.section_parts(F.col("content")).items()])
    found = lambda part, field: F.col(f"x_{part}.{field}")
    act_name = tx.first_filled(F.col("_act.act_name"), found("act", "act_name"), F.col("title"))
    number = F.coalesce("section_number", found("heading", "section_number"))
    merged = facts.select(
        *[c for c in chunks.columns if c not in ("chapter_number", "chapter_name", "section_number", "section_title", "text", "tags")],
        act_name.alias("act_name"),
        F.coalesce(F.col("_act.act_year"), found("act", "act_year"), F.col("year")).alias("act_year"),
        F.coalesce("chapter_number", found("chapter", "chapter_number")).alias("chapter_number"),
        F.coalesce("chapter_name", found("chapter", "chapter_name")).alias("chapter_name"),
        number.alias("section_number"),
        F.coalesce("section_title", found("heading", "section_title")).alias("section_title"),
        *parts,
        (F.size("explanations") > 0).alias("has_explanation"),
        (F.size("illustrations") > 0).alias("has_illustration"),
        (F.size("exceptions") > 0).alias("has_exception"),
        (F.size("provisos") > 0).alias("has_proviso"),
        F.col("x_penalty").isNotNull().alias("has_penalty"),
        found("penalty", "penalty_type").alias("penalty_type"),
        found("penalty", "fine_amount").alias("fine_amount"),
        found("penalty", "imprisonment_years").alias("imprisonment_years"),
        F.col("x_keywords").alias("keywords"),
        F.transform("x_authorities", lambda a: a["name"]).alias("authorities"),
        F.array_sort(F.array_union(F.col("tags"), F.col("x_keywords"))).alias("tags"),
        F.when(number.isNotNull(), F.concat(act_name, F.lit(" — Section "), number))
        .otherwise(F.col("title"))
        .alias("chunk_title"),
    )
    return merged


def _located_segments(body: Column) -> Column:
    """Segments of one text as ``ARRAY<STRUCT<start_char, end_char, segment>>``."""
    pieces = F.split(body, _BOUNDARY)
    located = F.aggregate(
        pieces,
        F.struct(
            F.lit(0).alias("at"),
            F.expr(
                "cast(array() as array<struct<start_char:int,end_char:int,segment:string>>)"
            ).alias("out"),
        ),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        s["at"].alias("start_char"),
                        (s["at"] + F.length(p)).alias("end_char"),
                        p.alias("segment"),
                    )
                ),
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    # Text before the first boundary stays even when it is blank.
    has_preamble = ~F.regexp_like(body, F.lit(_STARTS_AT_BOUNDARY))
    return F.filter(
        located,
        lambda s: (F.length(tx.strip(s["segment"])) > 0) | (has_preamble & (s["start_char"] == 0)),
    )


def structural_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """Split at lines that open a chapter, a numbered heading or a section.

    Text before the first boundary is kept; blank segments are dropped; offsets
    count the dropped ones.
    """
    body = F.col(text)
    return (
        docs.where(tx.blank_to_null(body).isNotNull())
        .select(*docs.columns, F.posexplode(_located_segments(body)).alias("segment_index", "_s"))
        .select(*docs.columns, "segment_index", "_s.start_char", "_s.end_char", "_s.segment")
    )


def _jumps(text: str, size: int, overlap: int, min_advance: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every offset, where a window that starts there ends, and where the next one starts.

    A table of the last line end and the last blank seen so far gives all ends at once, about
    30 bytes per character.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.arange(len(codes), dtype=np.int32)
    full = np.minimum(starts + size, len(codes)).astype(np.int32)
    ends = full.copy()
    for mark in (" ", "\n"):  # a line end wins over a blank
        seen = np.maximum.accumulate(np.where(codes == ord(mark), starts, -1))[full - 1]
        ends = np.where((seen > starts) & (full < len(codes)), seen, ends)
    stuck = ends - overlap <= starts
    following = np.where(stuck, ends if min_advance else starts + 1, ends - overlap)
    return ends, np.where(full == len(codes), len(codes), following)


def window_offsets(text: str, size: int, overlap: int, min_advance: bool) -> list[int]:
    """Offsets ``[start, end, start, end, ...]`` of the windows of one text that aren't blank."""
    if not text:
        return []
    ends, following = _jumps(text, size, overlap, min_advance)
    found, start = [], 0
    while start < len(text):
        if not text[start : ends[start]].isspace():
            found += (start, int(ends[start]))
        start = int(following[start])
    return found


def _window_udf(size: int, overlap: int, min_advance: bool):
    """Offsets ``[start, end, start, end, ...]`` for every long text of an array."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    # The batch stays in Arrow; the texts of one document at a time become Python objects.
    @F.arrow_udf("array<array<int>>")
    def offsets(lists: pa.Array) -> pa.Array:
        found = ([window_offsets(t, size, overlap, min_advance) for t in texts.as_py()] for texts in lists)
        return pa.array(found, pa.list_(pa.list_(pa.int32())))

    # A deterministic UDF is planned a second time below the filter that Spark derives from the explode.
    return offsets.asNondeterministic()


def sliding_chunks(
    docs: DataFrame,
    text: str = "text",
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    min_advance: bool = False,
) -> DataFrame:
    """Structural segments; those longer than ``size`` become overlapping windows.

    Windows are cut at a line end, else a word end. The cursor depends on the
    text just cut, so the offsets come from an Arrow UDF that receives only the
    long segments and returns integers; the texts are cut in the JVM and the
    document row never moves. By default the cursor advances by one character
    when a cut leaves nothing beyond the overlap; ``min_advance`` moves it to
    the cut instead.
    """
    body = F.col(text)
    long = lambda s: F.length(s["segment"]) > size
    segmented = docs.where(tx.blank_to_null(body).isNotNull()).select(
        "*", _located_segments(body).alias("_segments")
    )
    windowed = segmented.withColumn(
        "_offsets",
        _window_udf(size, overlap, min_advance)(
            F.transform("_segments", lambda s: F.when(long(s), s["segment"]).otherwise(F.lit("")))
        ),
    )

    def windows(s: Column, i: Column) -> Column:
        pair = lambda a, b: F.struct(a.alias("start_char"), b.alias("end_char"))
        cut = F.col("_offsets")[i]
        count = (F.size(cut) / 2).cast("int")
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )
        moved = F.transform(
            steps,
            lambda w: pair(s["start_char"] + F.get(cut, w * 2), s["start_char"] + F.get(cut, w * 2 + 1)),
        )
        return F.when(long(s), moved).otherwise(F.array(pair(s["start_char"], s["end_char"])))

    return (
        windowed.withColumn("_windows", F.flatten(F.transform("_segments", windows)))
        .select(*docs.columns, F.posexplode("_windows").alias("chunk_index", "_w"))
        .select(
            *docs.columns,
            "chunk_index",
            "_w.start_char",
            "_w.end_char",
            _slice(body, F.col("_w.start_char"), F.col("_w.end_char")).alias("content"),
        )
    )


def structural_chunks(
    docs: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    """Structure-aware chunks with extracted metadata; needs ``title`` and ``year``.

    Every field is a column of its own, so fields that nobody reads aren't extracted.
    """
    body = F.col("content")
    header = F.left(body, F.lit(fv.HEADER_CHARS))
    facts = sliding_chunks(docs, size=size, overlap=overlap).withColumns(
        {
            "_act": ex.act_name_year(header),
            "_chapter": ex.chapter(header),
            "_heading": ex.section(body),
            "_penalty": ex.penalty(body),
            "sub_section": ex.sub_section(body),
        }
    )
    act, number, penalty = F.col("_act"), F.col("_heading.section_number"), F.col("_penalty")
    label = tx.section_label(act["act_name"], act["act_year"], number, F.col("sub_section"))
    return facts.select(
        *[c for c in docs.columns if c not in ("text", "title")],
        "chunk_index",
        "start_char",
        "end_char",
        "content",
        F.when(number.isNotNull(), label).otherwise(F.col("title")).alias("title"),
        tx.first_filled(act["act_name"], F.col("title")).alias("act_name"),
        F.coalesce(act["act_year"], F.col("year")).alias("act_year"),
        "_chapter.chapter_number",
        "_chapter.chapter_name",
        "_heading.section_number",
        "_heading.section_title",
        "sub_section",
        ex.keywords(body).alias("keywords"),
        ex.related_sections(body).alias("related_sections"),
        penalty.isNotNull().alias("has_penalty"),
        penalty["penalty_type"].alias("penalty_type"),
        penalty["fine_amount"].alias("fine_amount"),
        penalty["imprisonment_years"].alias("imprisonment_years"),
        F.transform(ex.authorities(body), lambda a: a["name"]).alias("authorities"),
    )
