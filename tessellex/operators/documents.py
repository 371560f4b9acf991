"""Document-level extraction: split, extract per section, roll up, describe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import extract as ex
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx

_HEADING = rx.java(f"(?={fv.NUMBERED_HEADING})", multiline=True)


def _sections(text: Column) -> Column:
    """``ARRAY<STRUCT<page_no, section_text>>``: pages, then numbered headings; blanks dropped."""
    pages = F.transform(
        F.split(text, "\f"),
        lambda page, i: F.transform(
            F.split(page, _HEADING),
            lambda s: F.struct((i + 1).alias("page_no"), tx.strip(s).alias("section_text")),
        ),
    )
    return F.filter(F.flatten(pages), lambda s: F.length(s["section_text"]) > 0)


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc columns, section_index, page_no, section_text)``, one row per section."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(_sections(F.col(text))).alias("section_index", "_s")).select(
        *others, "section_index", "_s.page_no", "_s.section_text"
    )


def document_header(text: Column) -> Column:
    return F.left(text, F.lit(fv.HEADER_CHARS))


def _summary(each: Callable[[str], Column]) -> dict[str, Column]:
    """Document fields from the ordered arrays of its sections' fields; ``each`` gives the array of a field.

    Name and year come independently from the first section that has them; list
    fields are concatenated in section order.
    """
    filled = lambda name: F.filter(each(name), lambda v: v.isNotNull())
    penal = F.filter(each("section_number"), lambda n, i: F.get(each("penalty"), i).isNotNull())
    return {
        "act_name": F.get(filled("act_name"), F.lit(0)),
        "act_year": F.get(filled("act_year"), F.lit(0)),
        "total_chapters": F.size(F.array_distinct(filled("chapter_number"))),
        "total_sections": F.size(each("page_number")),
        "total_pages": F.coalesce(F.array_max(each("page_number")), F.lit(0)),
        "keywords": tx.clean_keywords(F.flatten(each("keywords"))),
        "definitions": F.flatten(each("definitions")),
        "authorities": ex.let(
            F.flatten(each("authorities")), lambda a: rx.first_of(a, lambda x: x["name"])
        ),
        "sections_with_penalties": F.filter(penal, lambda n: n.isNotNull()),
        "cross_references": F.flatten(each("cross_references")),
    }


def _part_of(metas: Column) -> Callable[[str], Column]:
    return lambda name: F.transform(metas, lambda m: m[name])


def _named(found: Column, act: Column) -> Column:
    """Section structs; those without an act get name and year of the document's header."""
    return F.transform(
        found,
        lambda m: F.when(
            m["act_name"].isNull() & act["act_name"].isNotNull(),
            m.withField("act_name", act["act_name"]).withField("act_year", act["act_year"]),
        ).otherwise(m),
    )


def extract_documents(docs: DataFrame) -> DataFrame:
    """Add document metadata columns to ``docs(doc_id, text, ...)``.

    The document row stays where it is: it is split into sections, the sections
    are extracted and summarised inside the row, so neither text nor metadata is
    shuffled and no join brings them back together. Every part of the metadata is
    an array of its own, so that parts which nobody reads are never extracted.
    """
    header = document_header(F.col("text"))
    staged = docs.select(
        "*",
        ex.act_name_year(header).alias("_act"),
        ex.act_number(header).alias("act_number"),
        _sections(F.col("text")).alias("_pieces"),
    )
    part = lambda name: F.transform("_pieces", lambda s: ex.section_parts(s["section_text"], s["page_no"])[name]).alias(f"_{name}s")
    parts = staged.select(
        *docs.columns, "act_number", _named(part("act"), F.col("_act")).alias("_acts"),
        *map(part, ("chapter", "heading", "page_number", "keywords", "definitions", "authorities", "penalty", "cross_references")),
    )
    fields = {"act_name": "act", "act_year": "act", "chapter_number": "chapter", "section_number": "heading"}

    def each(name: str) -> Column:
        return _part_of(F.col(f"_{fields[name]}s"))(name) if name in fields else F.col(f"_{name}s")

    return parts.select(*docs.columns, "act_number", *[c.alias(n) for n, c in _summary(each).items()])


def roll_up(sections: DataFrame) -> DataFrame:
    """Aggregate stored ``(doc_id, section_index, section)`` rows to one row per document."""
    ordered = F.array_sort(F.collect_list(F.struct("section_index", "section")))
    lists = sections.groupBy("doc_id").agg(ordered.alias("_rows"))
    metas = lists.select("doc_id", F.transform("_rows", lambda r: r["section"]).alias("_metas"))
    return metas.select("doc_id", *[c.alias(n) for n, c in _summary(_part_of(F.col("_metas"))).items()])


def _title() -> Column:
    return F.when(
        F.col("act_name").isNotNull(),
        tx.display_title(F.col("act_name"), F.col("act_year"), F.col("source_file")),
    ).otherwise(tx.title_from_stem(F.col("source_file")))


def title_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, title, year)`` as ``describe_documents`` gives them; nothing but the acts is extracted."""
    staged = docs.select(
        "doc_id",
        "source_file",
        "text",
        ex.act_name_year(document_header(F.col("text"))).alias("_act"),
        F.transform(_sections(F.col("text")), lambda s: ex.act_name_year(document_header(s["section_text"]))).alias("_found"),
    )
    metas = staged.withColumn("_metas", _named(F.col("_found"), F.col("_act")))
    filled = lambda name: F.filter(F.transform("_metas", lambda m: m[name]), lambda v: v.isNotNull())
    named = metas.withColumns({name: F.get(filled(name), F.lit(0)) for name in ("act_name", "act_year")})
    return named.select("doc_id", "text", _title().alias("title"), F.col("act_year").alias("year"))


def describe_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source_file, text)`` with hash, title, domain, type, year and tags.

    Blank documents come out with ``status = 'failed'`` and a reason instead of
    stopping the job.
    """
    text = F.col("text")
    ok = F.coalesce(tx.blank_to_null(text).isNotNull(), F.lit(False))
    none = F.array().cast("array<string>")
    return extract_documents(docs).select(
        "doc_id",
        tx.strip(F.col("source_file")).alias("source_file"),
        "text",
        tx.content_hash(text).alias("content_hash"),
        _title().alias("title"),
        ex.domain(F.col("act_name"), text).alias("legal_domain"),
        ex.document_type(F.col("act_name"), text).alias("document_type"),
        F.col("act_year").alias("year"),
        F.lit(fv.JURISDICTION).alias("jurisdiction"),
        F.lit("en").alias("language"),
        F.coalesce(F.slice("keywords", 1, 20), none).alias("tags"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        F.coalesce("total_sections", F.lit(0)).alias("total_sections"),
        "act_number",
        tx.word_count(text).alias("word_count"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, none).otherwise(F.array(F.lit("extracted text is empty"))).alias("warnings"),
    )
