"""Page and heading location of sections, and act-to-file resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx

# Any token before ". Letter" at a line start; any word after "Section".
_HEADS = rx.java(r"(?:\n|^)\s*([^\s.]+)\.\s*(?:\n|\s+)[A-Za-z]")
_SECTION_WORDS = rx.java(r"(?<!sub-)\bSection\s+([\p{L}\p{N}_]+)", ignore_case=True)


def section_digits(number: Column) -> Column:
    raw = tx.strip(number)
    return F.coalesce(rx.extract(raw, r"(?i)(\d+[A-Z]?)", 1), raw)


def title_words(title: Column) -> Column:
    """First five title words of four or more letters that are not stop words."""
    found = F.transform(rx.extract_all(F.coalesce(title, F.lit("")), "[A-Za-z]{4,}"), F.lower)
    stop = F.array(*[F.lit(w) for w in fv.LOCATOR_STOP_WORDS])
    return F.slice(F.filter(found, lambda w: ~F.array_contains(stop, w)), 1, 5)


def title_word_score(words: Column, lower_text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(lower_text, w)))


def is_contents_page(text: Column, page_no: Column) -> Column:
    """A contents phrase, or an early page of numbered lines without sub-section text."""
    upper = F.upper(text)
    phrase = reduce(Column.__or__, [F.contains(upper, F.lit(p)) for p in fv.CONTENTS_PHRASES])
    listing = (
        (page_no <= 3)
        & ~F.regexp_like(text, F.lit(rx.java(fv.BODY_SUB_SECTION)))
        & (F.regexp_count(text, F.lit(rx.java(fv.CONTENTS_LINE))) >= 6)
    )
    return phrase | listing


def is_form_page(text: Column) -> Column:
    return F.regexp_like(F.upper(text), F.lit(rx.java(fv.FORM_HEADER)))


def locate_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``page`` to ``sections(doc_id, section_id, section_number, section_title)``.

    Page features are extracted once per page. The short list of a document's
    sections travels to its pages, never page text to sections, and only
    candidate (section, page) pairs leave the page row; the best page is a
    partially aggregated arg-max. No candidate gives page 1.
    """
    wanted = sections.where(
        F.col("section_number").isNotNull()
        & ~F.upper(tx.strip(F.col("section_number"))).isin(*fv.NO_SECTION)
    )
    lists = wanted.groupBy("doc_id").agg(
        F.collect_list(
            F.struct(
                "section_id",
                section_digits(F.col("section_number")).alias("digits"),
                title_words(F.col("section_title")).alias("words"),
            )
        ).alias("sections")
    )
    text = F.col("text")
    features = pages.where(~tx.is_devanagari_page(text)).select(
        "doc_id",
        "page_no",
        F.lower(text).alias("low"),
        F.array_distinct(rx.extract_all(text, _HEADS, 1)).alias("heads"),
        F.array_distinct(F.transform(rx.extract_all(text, _SECTION_WORDS, 1), F.lower)).alias("mentions"),
        (~is_contents_page(text, F.col("page_no"))).alias("body"),
        (~is_form_page(text)).alias("no_form"),
    )
    points = fv.LOCATOR_SCORES
    gain = lambda cond, name: F.when(cond, F.lit(points[name])).otherwise(F.lit(0))

    def judge(s: Column) -> Column:
        heading = F.array_contains("heads", s["digits"])
        word = F.array_contains("mentions", F.lower(s["digits"]))
        hits = title_word_score(s["words"], F.col("low"))
        return F.struct(
            s["section_id"].alias("section_id"),
            (heading | word | (hits >= 2)).alias("candidate"),
            (
                gain(heading, "heading")
                + gain(word, "section_word")
                + hits * points["title_word"]
                + gain(F.col("body"), "not_contents")
                + gain(F.col("no_form"), "not_form")
            ).alias("score"),
        )

    found = (
        features.join(lists.hint("merge"), "doc_id")
        .select(
            "doc_id",
            "page_no",
            F.explode(F.filter(F.transform("sections", judge), lambda j: j["candidate"])).alias("j"),
        )
        .groupBy("doc_id", F.col("j.section_id").alias("section_id"))
        .agg(F.max_by("page_no", F.struct("j.score", (-F.col("page_no")).alias("b"))).alias("page"))
    )
    return sections.join(found.hint("merge"), ["doc_id", "section_id"], "left").withColumn(
        "page", F.coalesce("page", F.lit(1))
    )


def _page_features(page: Column, words: Column) -> Column:
    """What one page says about sections: its headings, mentions, the wanted title words in it and its own points."""
    text, points = page["text"], fv.LOCATOR_SCORES
    body = F.when(is_contents_page(text, page["page_no"]), 0).otherwise(points["not_contents"])
    no_form = F.when(is_form_page(text), 0).otherwise(points["not_form"])
    return F.struct(
        page["page_no"].alias("page_no"),
        F.array_distinct(rx.extract_all(text, _HEADS, 1)).alias("heads"),
        F.array_distinct(F.transform(rx.extract_all(text, _SECTION_WORDS, 1), F.lower)).alias("mentions"),
        rx.let(F.lower(text), lambda low: F.filter(words, lambda w: F.contains(low, w))).alias("words"),
        (body + no_form).alias("points"),
    )


def _best_page(number: Column, title: Column, features: Column) -> Column:
    """Number of the page with the highest score among the candidates, the first on a tie, or 1."""
    points = fv.LOCATOR_SCORES

    def judge(digits: Column, words: Column, f: Column) -> Column:
        heading = F.array_contains(f["heads"], digits)
        word = F.array_contains(f["mentions"], F.lower(digits))
        hits = F.size(F.filter(words, lambda w: F.array_contains(f["words"], w)))
        score = F.when(heading, points["heading"]).otherwise(0) + F.when(word, points["section_word"]).otherwise(0)
        return F.struct(
            (heading | word | (hits >= 2)).alias("candidate"),
            (score + hits * points["title_word"] + f["points"]).alias("score"),
            (-f["page_no"]).alias("back"),
        )

    best = rx.let(
        F.struct(section_digits(number).alias("digits"), title_words(title).alias("words")),
        lambda s: F.array_max(F.transform(features, lambda f: judge(s["digits"], s["words"], f))),
    )
    asked = number.isNotNull() & ~F.upper(tx.strip(number)).isin(*fv.NO_SECTION)
    return F.when(asked, rx.let(best, lambda b: F.when(b["candidate"], -b["back"]))).otherwise(F.lit(None).cast("int"))


def locate_in_documents(docs: DataFrame) -> DataFrame:
    """Sections with ``page`` and ``page_text``, one row each, for documents that hold both lists.

    ``docs`` has ``sections ARRAY<STRUCT<section_id, section_number, section_title>>`` and
    ``pages ARRAY<STRUCT<page_no INT, text STRING>>``. Every page is searched once for all title words of its document,
    sections are judged on the pages' features, and no page text leaves the document's row except that of the page found.
    Scores and ties are those of ``locate_pages``; ``page_text`` is NULL where a document has no page of that number.
    """
    pages, sections = F.col("pages"), F.col("sections")
    words = F.array_distinct(F.flatten(F.transform(sections, lambda s: title_words(s["section_title"]))))
    readable = F.filter(pages, lambda p: ~tx.is_devanagari_page(p["text"]))
    features = rx.let(words, lambda ws: F.transform(readable, lambda p: _page_features(p, ws)))

    def placed(s: Column, found: Column) -> Column:
        page = F.coalesce(_best_page(s["section_number"], s["section_title"], found), F.lit(1))
        return rx.let(
            page,
            lambda n: F.struct(
                s["section_id"].alias("section_id"),
                s["section_number"].alias("section_number"),
                s["section_title"].alias("section_title"),
                n.alias("page"),
                F.get(F.filter(pages, lambda p: p["page_no"] == n), F.lit(0))["text"].alias("page_text"),
            ),
        )

    located = rx.let(features, lambda found: F.transform(sections, lambda s: placed(s, found)))
    others = [c for c in docs.columns if c not in ("pages", "sections")]
    return docs.select(*others, F.inline(located))


def heading_keywords(title: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in fv.HEADING_STOP_WORDS])
    return F.filter(parts, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def locate_headings(pages: DataFrame) -> DataFrame:
    """Line of a section heading inside its page.

    ``pages`` has ``text``, ``section_number`` and ``section_title``. A line is a
    candidate when it has the shape of the heading; the one followed by most
    title words within nine lines wins, the first on a tie. Without one, the
    first line that mentions the number. Adds ``line_no`` (1-based, NULL when
    there is none) and ``heading_score``.
    """
    digits = F.coalesce(
        rx.extract(F.col("section_number"), r"(?i)(\d+[A-Z]?)", 1), tx.strip(F.col("section_number"))
    )
    lines = F.split(F.col("text"), "\n")
    staged = pages.select(
        "*",
        lines.alias("_lines"),
        digits.alias("_digits"),
        heading_keywords(F.coalesce("section_title", F.lit(""))).alias("_words"),
    )
    d = F.col("_digits")
    joined = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def shaped(line: Column) -> Column:
        starts = [joined(d, "."), joined("SECTION ", d), joined("SEC. ", d), joined("RULE ", d), joined(d, "(")]
        return (
            (line == d)
            | (line == joined(d, ":"))
            | reduce(Column.__or__, [F.startswith(line, s) for s in starts])
        )

    def mentioned(line: Column) -> Column:
        return reduce(
            Column.__or__,
            [F.contains(line, s) for s in (joined(d, "."), joined("SECTION ", d), joined("RULE ", d))],
        )

    def score(i: Column) -> Column:
        following = F.slice("_lines", i + 2, F.lit(9))
        return F.size(
            F.filter(following, lambda t: F.exists("_words", lambda w: F.contains(F.lower(t), w)))
        )

    latin = lambda raw: ~F.regexp_like(raw, F.lit("[ऀ-ॿ]"))
    numbered = F.transform(
        "_lines",
        lambda raw, i: F.struct(i.alias("i"), F.upper(tx.strip(raw)).alias("line"), latin(raw).alias("ok")),
    )
    best_first = F.array_sort(
        F.transform(
            F.filter(numbered, lambda x: x["ok"] & shaped(x["line"])),
            lambda x: F.struct((-score(x["i"])).alias("s"), x["i"].alias("i")),
        )
    )
    fallback = F.transform(
        F.filter(numbered, lambda x: x["ok"] & mentioned(x["line"])),
        lambda x: F.struct(F.lit(0).alias("s"), x["i"].alias("i")),
    )
    none = F.lit(None).cast("struct<s:int,i:int>")
    asked = d.isNotNull() & (d != "") & (F.upper("section_number") != "N/A")
    hit = F.when(
        asked,
        F.coalesce(F.get(best_first, F.lit(0)), F.get(fallback, F.lit(0))),
    ).otherwise(none)
    return staged.withColumn("_hit", hit).select(
        *pages.columns,
        (F.col("_hit.i") + 1).alias("line_no"),
        (-F.col("_hit.s")).alias("heading_score"),
    )


def resolve_file(
    act_name: Column, file_name: Column, section_title: Column, files: Sequence[str]
) -> Column:
    """File of an act: given name, rules, first known key in the act name, word overlap, default.

    ``files`` are the names of the files on hand, a short configuration list.
    """
    base = tx.base_name(F.coalesce(file_name, F.lit("")))
    both = F.lower(
        F.concat_ws(" ", F.coalesce(act_name, F.lit("")), F.coalesce(section_title, F.lit("")))
    )
    low = tx.strip(F.lower(act_name))
    words = F.filter(tx_split(low), lambda w: F.length(w) > 3)
    result = F.when(base.isin(list(files)), base)
    result = result.when(F.contains(both, F.lit("rules")) | F.contains(both, F.lit("rule ")), F.lit(fv.RULES_FILE))
    result = result.when(F.coalesce(act_name, F.lit("")) == "", F.lit(fv.DEFAULT_FILE))
    for key, target in fv.ACT_FILES:
        result = result.when(F.contains(low, F.lit(key)), F.lit(target))
    for name in sorted(files):
        low_name = F.lit(name.lower())
        result = result.when(F.exists(words, lambda w: F.contains(low_name, w)), F.lit(name))
    return result.otherwise(F.lit(fv.DEFAULT_FILE))


def tx_split(text: Column) -> Column:
    """White-space separated words, blanks dropped."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
