"""Statutory metadata extraction as Column expressions.

Every field is ``Column -> Column``; ``section_metadata`` assembles them. A value
that is used more than once is bound with ``let``, so that every pattern scans a
text once, also inside lambdas over arrays of texts.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx
from tessellex.functions.regexes import let

_FULL, _SHORT = rx.java(fv.ACT_FULL, multiline=True), rx.java(fv.ACT_SHORT, multiline=True)
_NUMBER = rx.java(fv.ACT_NUMBER, ignore_case=True)
_ROMAN = rx.java(fv.CHAPTER_ROMAN, ignore_case=True, multiline=True)
_ARABIC = rx.java(fv.CHAPTER_ARABIC, ignore_case=True, multiline=True)
_TITLED = rx.java(fv.SECTION_TITLED, multiline=True)
_PLAIN = rx.java(fv.SECTION_PLAIN)
_SUB = rx.java(fv.SUB_SECTION, multiline=True)
_DEFINITIONS = tuple(
    rx.java(p, ignore_case=True, multiline=True) for p in (fv.DEFINITION_MEANS, fv.DEFINITION_DASH)
)
_DEFINITION_REF = rx.java(fv.DEFINITION_REF, ignore_case=True, multiline=True)
# The character class after the boundary spares the alternation at most words.
_ANY_AUTHORITY = rx.java(
    r"\b(?=[csrpifhd])(?:" + "|".join(p for _, p in fv.AUTHORITIES) + r")\b", ignore_case=True
)
_PENALTY = rx.java(fv.PENALTY, ignore_case=True)
_TERM = rx.java(fv.PENALTY_TERM, ignore_case=True)
_FINE = rx.java(fv.PENALTY_FINE, ignore_case=True)
_RELATED = rx.java(fv.RELATED_SECTION, ignore_case=True)
_CROSS = rx.java(fv.CROSS_REFERENCE, multiline=True)
_SCHEDULE = rx.java(fv.SCHEDULE_REFERENCE, ignore_case=True)

KEYWORDS = tuple(sorted({w for group in fv.KEYWORD_GROUPS.values() for w in group}))


def _longest_first(phrases: list[str]) -> str:
    return "|".join(sorted(phrases, key=len, reverse=True))


# The longest phrase from each word's start on, looked at without reading past it, by first letters.
_PHRASES = rx.java(
    r"\b(?=((?:"
    + "|".join(f"{c}(?:{_longest_first([k[1:] for k in some])})" for c, some in groupby(KEYWORDS, key=lambda k: k[0]))
    + r")\b))"
)


def act_name_year(header: Column) -> Column:
    """``STRUCT<act_name, act_year>`` of the first dated act name; odd years become NULL."""
    found = F.when(
        F.regexp_like(header, F.lit(r"(?U)\d{4}")),
        F.coalesce(rx.extract(header, _FULL), rx.extract(header, _SHORT)),
    )

    def fields(m: Column) -> Column:
        year = F.right(m, F.lit(4)).try_cast("int")
        name = F.coalesce(rx.extract(m, _FULL, 1), rx.extract(m, _SHORT, 1))
        return F.struct(
            tx.strip(name).alias("act_name"),
            F.when(year.between(fv.YEAR_MIN, fv.YEAR_MAX), year).alias("act_year"),
        )

    return let(found, fields)


def act_number(header: Column) -> Column:
    return let(
        rx.extract(header, _NUMBER),
        lambda m: F.concat(
            F.lit("Act No. "),
            F.regexp_extract(m, _NUMBER, 1),
            F.lit(" of "),
            F.regexp_extract(m, _NUMBER, 2),
        ),
    )


def chapter(header: Column) -> Column:
    """``STRUCT<chapter_number, chapter_name>``; roman numerals are tried first."""
    found = F.coalesce(rx.extract(header, _ROMAN), rx.extract(header, _ARABIC))

    def fields(m: Column) -> Column:
        name = F.coalesce(rx.extract(m, _ROMAN, 2), rx.extract(m, _ARABIC, 2))
        return F.struct(
            F.coalesce(rx.extract(m, _ROMAN, 1), rx.extract(m, _ARABIC, 1)).alias("chapter_number"),
            tx.strip(name).alias("chapter_name"),
        )

    return let(found, fields)


def section(text: Column) -> Column:
    """``STRUCT<section_number, section_title>``: a titled heading, else any ``Section n``."""

    def fields(m: Column) -> Column:
        number = F.coalesce(rx.extract(m, _TITLED, 1), rx.extract(text, _PLAIN, 1))
        return F.struct(
            tx.normalise_section(number).alias("section_number"),
            F.nullif(tx.strip(rx.extract(m, _TITLED, 2)), F.lit("")).alias("section_title"),
        )

    return let(rx.extract(text, _TITLED), fields)


def sub_section(text: Column) -> Column:
    return F.concat(F.lit("("), rx.extract(text, _SUB, 1), F.lit(")"))


def keywords(text: Column) -> Column:
    """Vocabulary phrases that occur as whole words, sorted.

    One pattern passes over the text and gives the longest phrase from each place. A shorter phrase lies
    inside one of these, so phrases are told apart in the few that were found, not in the text.
    """
    # One literal that is split when the plan is optimised, not one per phrase.
    vocabulary = F.split(F.lit("|".join(KEYWORDS)), r"\|")
    head, tail = F.lit(rx.java(r"\b")), F.lit(r"\b")
    longest = F.regexp_extract_all(F.lower(text), F.lit(_PHRASES), F.lit(1))
    return let(
        F.array_join(F.array_distinct(longest), "\n"),
        lambda found: F.filter(
            vocabulary, lambda k: F.contains(found, k) & F.regexp_like(found, F.concat(head, k, tail))
        ),
    )


def definitions(text: Column) -> Column:
    """``ARRAY<STRUCT<term, definition, section_ref>>``; the first of a term wins."""

    def entry(pattern: str, term: int, body: int, ref: int | None):
        return lambda m: F.struct(
            tx.strip(F.regexp_extract(m, pattern, term)).alias("term"),
            tx.strip(F.regexp_extract(m, pattern, body)).alias("definition"),
            (F.regexp_extract(m, pattern, ref) if ref else F.lit(None).cast("string")).alias(
                "section_ref"
            ),
        )

    plain = [F.transform(rx.extract_all(text, p), entry(p, 1, 2, None)) for p in _DEFINITIONS]
    referred = F.transform(
        rx.extract_all(text, _DEFINITION_REF), entry(_DEFINITION_REF, 2, 3, 1)
    )
    kept = F.filter(
        F.concat(*plain, referred),
        lambda d: (F.length(d["term"]) >= 2) & (F.length(d["definition"]) >= 10),
    )
    return let(kept, lambda items: rx.first_of(items, lambda d: F.lower(d["term"])))


def authorities(text: Column) -> Column:
    """``ARRAY<STRUCT<name, authority_type, raw_text>>`` in type order, then text order."""

    def kind(name: Column) -> Column:
        rules = [
            F.when(name.rlike(rx.java(f"^{p}$", ignore_case=True)), F.lit(i))
            for i, (_, p) in enumerate(fv.AUTHORITIES)
        ]
        return F.coalesce(*rules)

    def context(s: Column) -> Column:
        start = F.greatest(s["start"] - fv.AUTHORITY_CONTEXT, F.lit(0))
        end = s["start"] + F.length(s["match"]) + fv.AUTHORITY_CONTEXT
        return tx.strip(F.substring(text, start + 1, end - start))

    ordered = F.array_sort(
        F.transform(
            rx.find_spans(text, _ANY_AUTHORITY),
            lambda s: F.struct(
                kind(s["match"]).alias("kind"),
                s["start"].alias("start"),
                tx.strip(s["match"]).alias("name"),
                context(s).alias("raw_text"),
            ),
        )
    )
    types = F.array(*[F.lit(t) for t, _ in fv.AUTHORITIES])
    return F.transform(
        let(ordered, lambda items: rx.first_of(items, lambda a: F.lower(a["name"]))),
        lambda a: F.struct(
            a["name"].alias("name"),
            types[a["kind"]].alias("authority_type"),
            a["raw_text"].alias("raw_text"),
        ),
    )


def _amount(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, _FINE, 1), F.lit(","), F.lit("")).try_cast("double")


def penalty(text: Column) -> Column:
    """``STRUCT<penalty_type, imprisonment_years, fine_amount, raw_text>`` or NULL.

    Type, term and fine are read from the first trigger clause and the 300
    characters after it.
    """

    def fields(clause: Column) -> Column:
        # The clause cannot occur earlier in the text than where it matched.
        window = F.substring(text, F.position(clause, text), F.length(clause) + fv.PENALTY_WINDOW)
        return let(window, lambda w: read(clause, w))

    def read(clause: Column, window: Column) -> Column:
        low = F.lower(window)
        has = lambda *ws: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ws])
        jail = has("imprisonment")
        fine = has("fine", "rs.", "rs ", "inr", "₹", "rupees")
        term = rx.extract(window, _TERM)
        years = F.regexp_extract(term, _TERM, 1).try_cast("double")
        months = F.regexp_extract(term, _TERM, 2).try_cast("double")
        raw = tx.strip(clause)
        return F.struct(
            F.when(jail & fine, F.lit("both"))
            .when(jail, F.lit("imprisonment"))
            .when(fine, F.lit("fine"))
            .when(has("deportation", "deported"), F.lit("deportation"))
            .when(has("cancel", "revoke"), F.lit("cancellation"))
            .otherwise(F.lit("unknown"))
            .alias("penalty_type"),
            F.coalesce(years, months / 12).alias("imprisonment_years"),
            F.coalesce(_amount(window), _amount(raw)).alias("fine_amount"),
            raw.alias("raw_text"),
        )

    return let(
        rx.extract(text, _PENALTY), lambda m: F.when(m.isNotNull(), fields(m))
    )


def related_sections(text: Column) -> Column:
    return tx.clean_sections(rx.extract_all(text, _RELATED, 1))


def cross_references(text: Column) -> Column:
    """``ARRAY<STRUCT<ref_type, ref_text, act_name, section_number>>``: acts, then schedules."""
    none = F.lit(None).cast("string")
    acts = F.transform(
        F.array_distinct(F.transform(rx.extract_all(text, _CROSS), tx.strip)),
        lambda m: F.struct(
            F.lit("section").alias("ref_type"),
            m.alias("ref_text"),
            tx.strip(F.regexp_extract(m, _CROSS, 2)).alias("act_name"),
            tx.strip(F.regexp_extract(m, _CROSS, 1)).alias("section_number"),
        ),
    )
    schedules = F.transform(
        F.array_distinct(rx.extract_all(text, _SCHEDULE)),
        lambda m: F.struct(
            F.lit("schedule").alias("ref_type"),
            m.alias("ref_text"),
            none.alias("act_name"),
            none.alias("section_number"),
        ),
    )
    return F.concat(acts, schedules)


def printed_page_number(text: Column) -> Column:
    """Page number printed in a footer line, else in a header line."""
    found = F.coalesce(
        rx.extract(text, rx.java(fv.PAGE_FOOTER, multiline=True), 1),
        rx.extract(text, rx.java(fv.PAGE_HEADER, multiline=True), 1),
    )
    return found.try_cast("int")


def confidence(s: dict[str, Column]) -> Column:
    """Weighted share of the fields that were found."""
    filled = {
        "act_name": s["act_name"].isNotNull(),
        "chapter_number": s["chapter_number"].isNotNull(),
        "section_number": s["section_number"].isNotNull(),
        "section_title": s["section_title"].isNotNull(),
        "penalty": s["penalty"].isNotNull(),
        **{
            c: F.size(s[c]) > 0
            for c in ("keywords", "definitions", "authorities", "related_sections", "cross_references")
        },
    }
    total = sum(
        (F.when(filled[name], F.lit(w)).otherwise(F.lit(0.0)) for name, w in fv.CONFIDENCE_WEIGHTS.items()),
        F.lit(0.0),
    )
    return tx.fixed(F.least(total, F.lit(1.0)), 3)


def section_parts(
    text: Column, page_number: Column | None = None, context_hint: Column | None = None
) -> dict[str, Column]:
    """The parts of ``section_metadata``, each a column of its own, so that a plan computes those that are read and no others."""
    header = text
    if context_hint is not None:
        header = F.concat_ws("\n", F.nullif(context_hint, F.lit("")), text)
    header = F.left(header, F.lit(fv.HEADER_CHARS))
    page = F.lit(None) if page_number is None else page_number
    return {
        "act": act_name_year(header),
        "chapter": chapter(header),
        "heading": section(text),
        "sub_section": sub_section(text),
        "page_number": page.cast("int"),
        "keywords": keywords(text),
        "definitions": definitions(text),
        "authorities": authorities(text),
        "penalty": penalty(text),
        "related_sections": related_sections(text),
        "cross_references": cross_references(text),
    }


def section_metadata(
    text: Column, page_number: Column | None = None, context_hint: Column | None = None
) -> Column:
    """All metadata of one text as a struct; every pattern scans the text once.

    ``context_hint`` is put before the text for the act and the chapter only.
    """
    lists = ("keywords", "definitions", "authorities", "penalty", "related_sections", "cross_references")
    raw = F.struct(*[c.alias(n) for n, c in section_parts(text, page_number, context_hint).items()])

    def finish(r: Column) -> Column:
        values = {
            "act_name": r["act"]["act_name"],
            "act_year": r["act"]["act_year"],
            "chapter_number": r["chapter"]["chapter_number"],
            "chapter_name": r["chapter"]["chapter_name"],
            "section_number": r["heading"]["section_number"],
            "section_title": r["heading"]["section_title"],
            "sub_section": r["sub_section"],
            "page_number": r["page_number"],
            **{n: r[n] for n in lists},
        }
        values["extraction_confidence"] = confidence(values)
        values["extractor_version"] = F.lit(fv.EXTRACTOR_VERSION)
        return F.struct(*[c.alias(n) for n, c in values.items()])

    return let(raw, finish)


def extract_sections(
    df: DataFrame,
    text: str = "text",
    page_number: Column | None = None,
    context_hint: Column | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add ``{prefix}section``, the metadata of every row's text. Narrow."""
    return df.withColumn(
        f"{prefix}section", section_metadata(F.col(text), page_number, context_hint)
    )


def flatten_section(s: Column) -> list[Column]:
    """Flat scalar/array columns of a section struct, for storage."""
    pen = s["penalty"]
    plain = (
        "act_name", "act_year", "chapter_number", "chapter_name", "section_number",
        "section_title", "sub_section", "page_number",
    )
    return [
        *[s[c].alias(c) for c in plain],
        s["page_number"].alias("page_range_start"),
        s["page_number"].alias("page_range_end"),
        s["keywords"].alias("keywords"),
        pen.isNotNull().alias("has_penalty"),
        pen["penalty_type"].alias("penalty_type"),
        pen["raw_text"].alias("penalty_raw"),
        pen["imprisonment_years"].alias("imprisonment_years"),
        pen["fine_amount"].alias("fine_amount"),
        s["related_sections"].alias("related_sections"),
        F.transform(s["authorities"], lambda a: a["name"]).alias("authority_names"),
        F.transform(s["authorities"], lambda a: a["authority_type"]).alias("authority_types"),
        (F.size(s["definitions"]) > 0).alias("has_definitions"),
        F.transform(s["definitions"], lambda d: d["term"]).alias("definition_terms"),
        F.size(s["cross_references"]).alias("cross_ref_count"),
        s["extraction_confidence"].alias("extraction_confidence"),
        s["extractor_version"].alias("extractor_version"),
    ]


def domain(act_name: Column, text: Column) -> Column:
    """Domain with most signal substrings in the act name and the first characters."""
    seen = F.concat_ws(
        " ", F.lower(F.coalesce(act_name, F.lit(""))), F.left(F.lower(text), F.lit(fv.HEADER_CHARS))
    )

    def choose(low: Column) -> Column:
        scores = [
            sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
            for _, ws in fv.DOMAIN_SIGNALS
        ]
        best = F.greatest(*scores)
        picked = F.when(best == 0, F.lit("unknown"))
        for (name, _), score in zip(fv.DOMAIN_SIGNALS, scores):
            picked = picked.when(score == best, F.lit(name))
        return picked

    return let(seen, choose)


def document_type(act_name: Column, text: Column) -> Column:
    seen = F.concat_ws(
        " ",
        F.lower(F.coalesce(act_name, F.lit(""))),
        F.lower(F.left(text, F.lit(fv.DOC_TYPE_CHARS))),
    )

    def choose(low: Column) -> Column:
        picked = F.when(F.lit(False), F.lit(""))
        for name, signals in fv.DOCUMENT_TYPE_SIGNALS:
            hit = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in signals])
            picked = picked.when(hit, F.lit(name))
        return picked.otherwise(F.lit("unknown"))

    return let(seen, choose)
