"""Scalar text functions, all ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import regexes as rx


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(strip(text)) > 0, text)


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def stem(term: Column) -> Column:
    """Light plural/verb stemmer; the first rule that applies decides."""
    n = F.length(term)
    cut = lambda k: F.left(term, n - k)
    return (
        F.when(n <= 3, term)
        .when(F.endswith(term, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(term, F.lit("es")) & (n > 4), cut(2))
        .when(F.endswith(term, F.lit("s")) & ~F.endswith(term, F.lit("ss")), cut(1))
        .when(F.endswith(term, F.lit("ing")) & (n > 5), cut(3))
        .when(F.endswith(term, F.lit("ed")) & (n > 4), cut(2))
        .otherwise(term)
    )


def has_stem(term: Column) -> Column:
    """True when ``stem(term)`` differs from ``term``."""
    n = F.length(term)
    return (n > 3) & (
        (F.endswith(term, F.lit("s")) & ~F.endswith(term, F.lit("ss")))
        | (F.endswith(term, F.lit("ing")) & (n > 5))
        | (F.endswith(term, F.lit("ed")) & (n > 4))
    )


def words(text: Column) -> Column:
    """Word tokens in text order, case kept."""
    return F.filter(F.split(text, fv.NON_WORD), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Lower-case tokens longer than one character, each followed by its stem when different."""
    kept = F.filter(F.split(F.lower(text), fv.NON_WORD), lambda w: F.length(w) > 1)
    return F.flatten(
        F.transform(kept, lambda w: F.when(has_stem(w), F.array(w, stem(w))).otherwise(F.array(w)))
    )


def token_set(text: Column) -> Column:
    """Distinct lower-case words, one-letter words included."""
    return F.array_distinct(words(F.lower(text)))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two distinct-token arrays; 0 when one is empty."""
    both = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - both
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / total)


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def snippet(text: Column, limit: int) -> Column:
    """First ``limit`` characters, stripped, with dots when something was cut."""
    return F.concat(
        strip(F.left(text, F.lit(limit))),
        F.when(F.length(text) > limit, F.lit("...")).otherwise(F.lit("")),
    )


def highlight(text: Column, query: Column) -> Column:
    """Mark every whole-word, case-blind occurrence of query words longer than two letters."""
    terms = F.array_distinct(
        F.filter(words(F.lower(F.coalesce(query, F.lit("")))), lambda w: F.length(w) > 2)
    )
    pattern = F.concat(
        F.lit(r"(?iuU)\b("), F.array_join(terms, "|"), F.lit(r")\b")
    )
    marked = F.regexp_replace(text, pattern, F.lit(fv.MARK_OPEN + "$1" + fv.MARK_CLOSE))
    return F.when(F.size(terms) > 0, marked).otherwise(text)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def file_link(path: Column, page: Column) -> Column:
    return F.concat(
        F.lit("file:///"),
        path,
        F.when(page.isNotNull() & (page != 0), F.concat(F.lit("#page="), page.cast("string")))
        .otherwise(F.lit("")),
    )


def title_case(text: Column) -> Column:
    """Capital at the start of every letter run, lower case elsewhere.

    Letter runs also start after digits and punctuation, so runs are cut with
    the regex engine and capitalised one by one.
    """
    parts = F.filter(
        rx.extract_all(text, r"\p{L}+|[^\p{L}]+"), lambda p: F.length(p) > 0
    )
    return F.array_join(
        F.transform(
            parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))
        ),
        "",
    )


def title_from_stem(path: Column) -> Column:
    """Readable title from a file name: extension dropped, underscores to spaces."""
    stem_part = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return title_case(F.replace(stem_part, F.lit("_"), F.lit(" ")))


def display_title(act_name: Column, act_year: Column, fallback: Column) -> Column:
    name = F.nullif(act_name, F.lit(""))
    return F.coalesce(F.concat(name, F.lit(", "), act_year.cast("string")), name, fallback)


def section_label(act_name, act_year, section_number, sub_section) -> Column:
    """``act (year) § n (sub)``; absent parts are skipped."""
    label = F.concat_ws(
        " ",
        act_name,
        F.concat(F.lit("("), act_year.cast("string"), F.lit(")")),
        F.concat(F.lit("§ "), section_number),
        sub_section,
    )
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown Section"))


def section_citation(act_name, act_year, section_number, page_number) -> Column:
    """``act, year, Section n, p. x``; absent parts are skipped."""
    cite = F.concat_ws(
        ", ",
        act_name,
        act_year.cast("string"),
        F.concat(F.lit("Section "), section_number),
        F.concat(F.lit("p. "), page_number.cast("string")),
    )
    return F.coalesce(F.nullif(cite, F.lit("")), F.lit("Unknown"))


def result_citation(title, year, source_file) -> Column:
    return F.concat(
        title,
        F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")),
        F.lit(" — "),
        source_file,
    )


def penalty_summary(years: Column, fine: Column, raw: Column) -> Column:
    """``imprisonment up to y year(s) and/or fine up to ₹n``."""
    text = F.concat_ws(
        " and/or ",
        F.concat(F.lit("imprisonment up to "), years.cast("string"), F.lit(" year(s)")),
        F.concat(F.lit("fine up to ₹"), F.format_number(fine, 0)),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(raw, F.lit("")), F.lit("unspecified"))


def viewer_link(file_name, section_number, page, act_name, section_title) -> Column:
    """Query string of the document viewer."""
    sec = strip(F.coalesce(section_number, F.lit("1")))
    sec = F.when(F.upper(sec).isin("N/A", "NONE", ""), F.lit("1")).otherwise(sec)
    form = lambda name, v: F.concat(F.lit(f"{name}="), F.url_encode(v))
    title = F.nullif(F.left(section_title, F.lit(60)), F.lit(""))
    return F.concat(
        F.lit("/app/static/pdf_viewer.html?"),
        F.concat_ws(
            "&",
            form("file", file_name),
            form("section", sec),
            form("page", page.cast("string")),
            form("act", first_filled(act_name, F.lit("Statutory Act"))),
            form("title", title),
        ),
    )


def fixed(value: Column, digits: int) -> Column:
    """Round half up on the binary value; the same formula exists in every SQL engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(score: Column) -> Column:
    return (score * 100).cast("int")


def normalise_section(number: Column) -> Column:
    """Upper-case section number without a leading ``SECTION`` (stripped as character sets)."""
    value = F.upper(strip(number))
    for chars in ("S", "EC", "TION"):
        value = F.ltrim(value, F.lit(chars))
    return F.nullif(strip(value), F.lit(""))


def clean_keywords(items: Column) -> Column:
    """Lower-case, strip, drop blanks and repeats, order kept."""
    return F.array_distinct(F.filter(F.transform(items, lambda k: strip(F.lower(k))), lambda k: k != ""))


def clean_sections(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, strip), lambda s: s != ""))


def is_devanagari_page(text: Column) -> Column:
    """More than 80 Devanagari characters, or more than 15 % of the text."""
    hits = F.length(F.regexp_replace(text, fv.DEVANAGARI, ""))
    return F.coalesce(
        (F.length(text) > 0)
        & ((hits > fv.DEVANAGARI_MIN) | (hits / F.length(text) > fv.DEVANAGARI_RATIO)),
        F.lit(False),
    )
