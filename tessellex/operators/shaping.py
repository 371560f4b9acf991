"""From candidates to context blocks, citations, parsed answers and responses.

``passages`` is a candidate table joined with chunk metadata: ``query_id, rank,
score, content, title, act_name, year, chapter_number, chapter_name,
section_number, section_title, page_number, source_file``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx
from tessellex.operators.sizing import pick_rows

_ANSWER_SECTION = rx.java(fv.ANSWER_SECTION, ignore_case=True)


def attach_payload(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join chunk columns to candidates after the cut; candidate columns win."""
    extra = [c for c in chunks.columns if c == "chunk_id" or c not in candidates.columns]
    return pick_rows(chunks.select(*extra), candidates)


def _optional(condition: Column, *parts: Column | str) -> Column:
    text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.coalesce(F.when(condition, text), F.lit(""))


def _present(value: Column) -> Column:
    text = value.cast("string")
    return text.isNotNull() & (text != "") & (text != "0")


def _page(value: Column) -> Column:
    return F.when(F.upper(value.cast("string")) != "N/A", value)


def passage_block() -> Column:
    """Header line and text of one passage."""
    act = tx.first_filled(F.col("act_name"), F.col("title"), F.lit("Untitled Document"))
    page = _page(F.col("page_number"))
    return F.concat(
        F.lit("--- [Passage "),
        F.col("rank").cast("string"),
        F.lit("] "),
        act,
        _optional(_present(F.col("year")), " (", F.col("year"), ")"),
        F.lit(" | Section "),
        tx.first_filled(F.col("section_number"), F.lit("N/A")),
        _optional(_present(page), " | Page ", page),
        F.lit(" ---\n"),
        tx.strip(F.col("content")),
    )


def assemble_context(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, context, n_passages)``; at most k passages per query meet in a row."""
    blocks = passages.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", passage_block().alias("block")))),
                lambda b: b["block"],
            ),
            "\n\n",
        ).alias("context"),
        F.count("*").alias("n_passages"),
    )
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id",
        F.coalesce("context", F.lit(fv.NO_CONTEXT)).alias("context"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
    )


def citations(passages: DataFrame) -> DataFrame:
    """One short citation per passage."""
    act = tx.first_filled(F.col("act_name"), F.col("title"), F.lit("Act"))
    number = tx.first_filled(F.col("section_number"), F.lit("General"))
    page = _page(F.col("page_number"))
    section = F.when(number != "General", F.concat(F.lit("Section "), number)).otherwise(F.lit(""))
    cite = F.concat(
        act,
        _optional(_present(F.col("year")), ", ", F.col("year")),
        F.lit(", "),
        section,
        _optional(_present(page), ", p. ", page),
    )
    return passages.select(
        "query_id",
        "rank",
        act.alias("act_name"),
        F.col("year").cast("int").alias("year"),
        number.alias("section_number"),
        tx.first_filled(F.col("section_title"), F.col("title")).alias("section_title"),
        page.try_cast("int").alias("page_number"),
        F.nullif(tx.base_name(F.col("source_file")), F.lit("")).alias("pdf_name"),
        F.btrim(cite, F.lit(", ")).alias("citation_text"),
        tx.snippet(F.col("content"), 250).alias("snippet"),
        F.col("score").cast("double").alias("score"),
    )


def citation_details(passages: DataFrame, query_text: Column) -> DataFrame:
    """One detailed citation per passage: chapter, page link, highlighted snippet, badge."""
    act = tx.first_filled(F.col("act_name"), F.col("title"), F.lit("Statutory Act"))
    number = tx.first_filled(F.col("section_number"), F.lit("N/A"))
    year = tx.first_filled(F.col("act_year"), F.col("year")).try_cast("int")
    chapter = tx.first_filled(F.col("chapter_number"))
    page = F.col("page_number").cast("string").try_cast("int")
    path = tx.first_filled(F.col("source_file"), F.lit("document.pdf"))
    tail = F.concat(
        _optional(chapter.isNotNull(), ", Ch. ", chapter),
        _optional(number != "N/A", ", Sec. ", number),
        _optional(_present(page), ", p. ", page),
    )
    detailed = passages.select(
        "query_id",
        "rank",
        act.alias("act_name"),
        year.alias("act_year"),
        chapter.alias("chapter_number"),
        F.nullif("chapter_name", F.lit("")).alias("chapter_name"),
        number.alias("section_number"),
        tx.first_filled(F.col("section_title"), F.col("title")).alias("section_title"),
        page.alias("page_number"),
        tx.base_name(path).alias("pdf_name"),
        path.alias("pdf_path"),
        tx.highlight(tx.snippet(F.col("content"), 300), query_text).alias("highlighted_snippet"),
        tx.file_link(path, page).alias("clickable_link"),
        F.concat(act, _optional(_present(year), ", ", year), tail).alias("citation_string"),
        tail.alias("_tail"),
        tx.fixed(F.col("score"), 4).alias("relevance_score"),
    )
    label = F.concat(
        F.col("act_name"), _optional(_present(F.col("act_year")), " (", F.col("act_year"), ")"), F.col("_tail")
    )
    return detailed.withColumn(
        "badge", F.concat(F.lit("["), label, F.lit("]("), F.col("clickable_link"), F.lit(")"))
    ).drop("_tail")


def referenced_sections(answer: Column) -> Column:
    """Distinct ``Section n`` mentions in title case, sorted as text."""
    return F.array_sort(F.array_distinct(F.transform(rx.extract_all(answer, _ANSWER_SECTION), tx.title_case)))


def has_penalty_words(answer: Column) -> Column:
    low = F.lower(answer)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in fv.PENALTY_WORDS])


def is_refusal(answer: Column, phrase: str = fv.REFUSAL) -> Column:
    return F.regexp_like(F.lower(answer), F.lit(phrase))


def parse_answers(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``answers(query_id, answer)`` to sections, penalty flag, confidence and citation count."""
    counts = passages.groupBy("query_id").agg(F.count("*").alias("n_citations"))
    joined = answers.join(counts, "query_id", "left").withColumn(
        "n_citations", F.coalesce("n_citations", F.lit(0))
    )
    answer = F.col("answer")
    return joined.select(
        "query_id",
        tx.strip(answer).alias("answer"),
        "n_citations",
        referenced_sections(answer).alias("referenced_sections"),
        has_penalty_words(answer).alias("has_penalty_clause"),
        F.when(is_refusal(answer), F.lit(0.2))
        .when(F.col("n_citations") > 0, F.lit(1.0))
        .otherwise(F.lit(0.5))
        .alias("confidence_score"),
    )


def respond(
    queries: DataFrame,
    passages: DataFrame,
    answers: DataFrame,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Status and response of every query.

    ``failures(query_id, reason)`` names queries whose channels failed; a query
    without passages found no documents; the others take their parsed answer.
    """
    parsed = parse_answers(answers, passages)
    base = queries.select("query_id").join(parsed, "query_id", "left")
    if failures is None:
        base = base.withColumn("reason", F.lit(None).cast("string"))
    else:
        base = base.join(failures.select("query_id", "reason"), "query_id", "left")
    failed = F.col("reason").isNotNull()
    empty = F.coalesce(F.col("n_citations"), F.lit(0)) == 0
    none = F.array().cast("array<string>")
    return base.select(
        "query_id",
        F.when(failed, F.lit("retrieval_failed"))
        .when(empty, F.lit("no_documents_found"))
        .otherwise(F.lit("success"))
        .alias("retrieval_status"),
        F.when(failed, F.lit(fv.FAILED_ANSWER))
        .when(empty, F.lit(fv.NO_DOCUMENTS_ANSWER))
        .otherwise(F.col("answer"))
        .alias("answer"),
        F.when(failed | empty, none).otherwise(F.col("referenced_sections")).alias("referenced_sections"),
        F.when(failed | empty, F.lit(False)).otherwise(F.col("has_penalty_clause")).alias("has_penalty_clause"),
        F.when(failed | empty, F.lit(0.0)).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.when(failed | empty, F.lit(0)).otherwise(F.col("n_citations")).alias("n_citations"),
        F.when(failed, F.lit(fv.FAILED_TITLE)).alias("error_title"),
        F.when(failed, F.lit(fv.FAILED_MESSAGE)).alias("error_message"),
        F.col("reason").alias("developer_details"),
    )
