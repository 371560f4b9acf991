"""Building blocks of the differential SQL (DuckDB dialect).

Written from the definitions with relational means, so that they check the
Column expressions rather than repeat them.
"""

from __future__ import annotations

from tessellex import fixed_values as fv
from tessellex.plans.statutes import STATUTE_SQL

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[\p{L}\p{N}_]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def filled(x: str) -> str:
    return f"nullif({x}, '')"


def ext(x: str, pattern: str, group: int = 0, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return filled(f"regexp_extract({x}, {lit(prefix + pattern)}, {group})")


def ext_all(x: str, pattern: str, group: int = 0, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_extract_all({x}, {lit(prefix + pattern)}, {group})"


def matches(x: str, pattern: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_matches({x}, {lit(prefix + pattern)})"


def fixed(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def in_order_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def join(items: str, sep: str = "|") -> str:
    return f"array_to_string({items}, {lit(sep)})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def stem(w: str) -> str:
    n = f"length({w})"
    return (
        f"CASE WHEN {n} <= 3 THEN {w} WHEN {w} LIKE '%ies' THEN left({w}, {n} - 3) || 'y' "
        f"WHEN {w} LIKE '%es' AND {n} > 4 THEN left({w}, {n} - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {n} > 3 THEN left({w}, {n} - 1) "
        f"WHEN {w} LIKE '%ing' AND {n} > 5 THEN left({w}, {n} - 3) "
        f"WHEN {w} LIKE '%ed' AND {n} > 4 THEN left({w}, {n} - 2) ELSE {w} END"
    )


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


STATUTES = f"statutes AS ({STATUTE_SQL})"

# Sections of a statute: pages at form feeds, then numbered headings.
SECTIONS = [
    STATUTES,
    """statute_pages AS (
  SELECT doc_id, source_file, page_no, page FROM (
    SELECT doc_id, source_file, unnest(string_split(text, chr(12))) AS page,
           generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM statutes))""",
    f"""section_parts AS (
  SELECT doc_id, page_no, unnest(p) AS part, generate_subscripts(p, 1) AS part_no FROM (
    SELECT doc_id, page_no, string_split(regexp_replace(page, '(?m){fv.NUMBERED_HEADING}', chr(30) || '\\0', 'g'), chr(30)) AS p
    FROM statute_pages))""",
    f"""sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, part_no) - 1 AS section_index,
         page_no, {strip('part')} AS text
  FROM section_parts WHERE {strip('part')} <> '')""",
]


def act_fields(text: str) -> str:
    """``act_name, act_year`` select items over a text expression."""
    head = f"left({text}, {fv.HEADER_CHARS})"
    found = f"coalesce({ext(head, fv.ACT_FULL, 0, 'm')}, {ext(head, fv.ACT_SHORT, 0, 'm')})"
    name = f"coalesce({ext(found, fv.ACT_FULL, 1, 'm')}, {ext(found, fv.ACT_SHORT, 1, 'm')})"
    year = f"try_cast(right({found}, 4) AS INTEGER)"
    return (
        f"{strip(name)} AS act_name, "
        f"CASE WHEN {year} BETWEEN {fv.YEAR_MIN} AND {fv.YEAR_MAX} THEN {year} END AS act_year"
    )


def act_number(text: str) -> str:
    head = f"left({text}, {fv.HEADER_CHARS})"
    return (
        f"'Act No. ' || {ext(head, fv.ACT_NUMBER, 1, 'i')} || ' of ' || {ext(head, fv.ACT_NUMBER, 2, 'i')} AS act_number"
    )


def chapter_fields(text: str) -> str:
    head = f"left({text}, {fv.HEADER_CHARS})"
    roman = ext(head, fv.CHAPTER_ROMAN, 1, "im")
    return (
        f"coalesce({roman}, {ext(head, fv.CHAPTER_ARABIC, 1, 'im')}) AS chapter_number, "
        f"{strip(f'CASE WHEN {roman} IS NOT NULL THEN ' + ext(head, fv.CHAPTER_ROMAN, 2, 'im') + ' ELSE ' + ext(head, fv.CHAPTER_ARABIC, 2, 'im') + ' END')} AS chapter_name"
    )


def normalised(number: str) -> str:
    return filled(strip(f"ltrim(ltrim(ltrim(upper({strip(number)}), 'S'), 'EC'), 'TION')"))


def section_fields(text: str) -> str:
    titled = ext(text, fv.SECTION_TITLED, 0, "m")
    number = (
        f"CASE WHEN {titled} IS NOT NULL THEN {ext(text, fv.SECTION_TITLED, 1, 'm')} "
        f"ELSE {ext(text, fv.SECTION_PLAIN, 1)} END"
    )
    return (
        f"{normalised(number)} AS section_number, "
        f"{filled(strip(ext(text, fv.SECTION_TITLED, 2, 'm')))} AS section_title"
    )


def sub_section(text: str) -> str:
    return f"'(' || {ext(text, fv.SUB_SECTION, 1, 'm')} || ')' AS sub_section"


def keyword_list(text: str) -> str:
    vocabulary = sorted({w for g in fv.KEYWORD_GROUPS.values() for w in g})
    tests = ", ".join(
        f"CASE WHEN regexp_matches(lower({text}), {lit(chr(92) + 'b' + k + chr(92) + 'b')}) THEN {lit(k)} END"
        for k in vocabulary
    )
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def definition_rows(source: str, keys: str) -> str:
    """SELECT of ``keys, pos, term, definition, section_ref`` from ``source(keys, text)``."""
    arms = []
    for no, (pattern, term, body, ref) in enumerate(
        ((fv.DEFINITION_MEANS, 1, 2, None), (fv.DEFINITION_DASH, 1, 2, None), (fv.DEFINITION_REF, 2, 3, 1))
    ):
        every = ext_all("text", pattern, 0, "im")
        arms.append(
            f"SELECT {keys}, {no} AS pat, i, {strip(ext('m', pattern, term, 'im'))} AS term, "
            f"{strip(ext('m', pattern, body, 'im'))} AS definition, "
            f"{ext('m', pattern, ref, 'im') if ref else 'NULL'} AS section_ref FROM ("
            f"SELECT {keys}, unnest({every}) AS m, generate_subscripts({every}, 1) AS i FROM {source})"
        )
    return (
        f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pat, i) AS pos, term, definition, section_ref "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, lower(term) ORDER BY pat, i) AS seen FROM ("
        + " UNION ALL ".join(arms)
        + ") WHERE length(term) >= 2 AND length(definition) >= 10) WHERE seen = 1"
    )


def spans(source: str, keys: str, text: str, pattern: str, flags: str) -> str:
    """SELECT of ``keys, text, start, hit, no``: every match with its 0-based start."""
    marked = (
        f"string_split(regexp_replace({text}, {lit(f'(?{flags})' + pattern)}, chr(30) || '\\0' || chr(31), 'g'), chr(30))"
    )
    return (
        f"SELECT {keys}, {text}, no - 1 AS no, split_part(part, chr(31), 1) AS hit, "
        f"sum(CASE WHEN no = 1 THEN length(part) ELSE length(part) - 1 END) OVER "
        f"(PARTITION BY {keys} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start "
        f"FROM (SELECT {keys}, {text}, unnest({marked}) AS part, generate_subscripts({marked}, 1) AS no FROM {source}) "
        f"QUALIFY no > 1"
    )


def authority_rows(source: str, keys: str) -> str:
    """SELECT of ``keys, pos, name, authority_type, raw_text``."""
    arms = [
        f"SELECT {keys}, text, {no} AS kind, {lit(name)} AS authority_type, start, hit FROM ("
        + spans(source, keys, "text", rf"\b(?:{pattern})\b", "i")
        + ")"
        for no, (name, pattern) in enumerate(fv.AUTHORITIES)
    ]
    width = fv.AUTHORITY_CONTEXT
    raw = strip(
        f"substring(text, (greatest(start - {width}, 0) + 1)::INT, (start + length(hit) + {width} - greatest(start - {width}, 0))::INT)"
    )
    return (
        f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY kind, start) AS pos, hit AS name, "
        f"authority_type, {raw} AS raw_text FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {keys}, lower(hit) ORDER BY kind, start) AS seen FROM ("
        + " UNION ALL ".join(arms)
        + ")) WHERE seen = 1"
    )


def penalty_fields(text: str, prefix: str = "") -> str:
    clause = ext(text, fv.PENALTY, 0, "i")
    window = f"substring({text}, instr({text}, {clause})::INT, (length({clause}) + {fv.PENALTY_WINDOW})::INT)"
    has = lambda *ws: "(" + " OR ".join(f"contains(lower({window}), {lit(w)})" for w in ws) + ")"
    jail, fine = has("imprisonment"), has("fine", "rs.", "rs ", "inr", "₹", "rupees")
    term = ext(window, fv.PENALTY_TERM, 0, "i")
    years = f"try_cast({ext(term, fv.PENALTY_TERM, 1, 'i')} AS DOUBLE)"
    months = f"try_cast({ext(term, fv.PENALTY_TERM, 2, 'i')} AS DOUBLE)"
    amount = lambda t: f"try_cast(replace({ext(t, fv.PENALTY_FINE, 1, 'i')}, ',', '') AS DOUBLE)"
    return (
        f"CASE WHEN {clause} IS NULL THEN NULL WHEN {jail} AND {fine} THEN 'both' WHEN {jail} THEN 'imprisonment' "
        f"WHEN {fine} THEN 'fine' WHEN {has('deportation', 'deported')} THEN 'deportation' "
        f"WHEN {has('cancel', 'revoke')} THEN 'cancellation' ELSE 'unknown' END AS {prefix}penalty_type, "
        f"coalesce({years}, {months} / 12) AS {prefix}imprisonment_years, "
        f"coalesce({amount(window)}, {amount(strip(clause))}) AS {prefix}fine_amount, "
        f"{strip(clause)} AS {prefix}penalty_raw"
    )


def related_list(text: str) -> str:
    found = f"list_filter(list_transform({ext_all(text, fv.RELATED_SECTION, 1, 'i')}, lambda s: {strip('s')}), lambda s: s <> '')"
    return in_order_distinct(found)


def cross_list(text: str) -> str:
    found = f"list_transform({ext_all(text, fv.CROSS_REFERENCE, 0, 'm')}, lambda s: {strip('s')})"
    return in_order_distinct(found)


def schedule_list(text: str) -> str:
    return in_order_distinct(ext_all(text, fv.SCHEDULE_REFERENCE, 0, "i"))


# All fields of every section, lists joined with '|'.
SECTION_META = [
    *SECTIONS,
    f"""section_base AS (
  SELECT doc_id, section_index, page_no, text, {act_fields('text')}, {chapter_fields('text')},
         {section_fields('text')}, {sub_section('text')}, {keyword_list('text')} AS kw,
         {penalty_fields('text')}, {related_list('text')} AS related, {cross_list('text')} AS crosses,
         {schedule_list('text')} AS schedules
  FROM sections)""",
    f"section_definitions AS ({definition_rows('sections', 'doc_id, section_index')})",
    f"section_authorities AS ({authority_rows('sections', 'doc_id, section_index')})",
    """section_meta AS (
  SELECT b.*, coalesce(d.n, 0) AS n_definitions, d.terms, coalesce(a.n, 0) AS n_authorities, a.names, a.types,
         len(crosses) + len(schedules) AS n_cross
  FROM section_base b
  LEFT JOIN (SELECT doc_id, section_index, count(*) AS n, string_agg(term, '|' ORDER BY pos) AS terms
             FROM section_definitions GROUP BY ALL) d USING (doc_id, section_index)
  LEFT JOIN (SELECT doc_id, section_index, count(*) AS n, string_agg(name, '|' ORDER BY pos) AS names,
                    string_agg(authority_type, '|' ORDER BY pos) AS types
             FROM section_authorities GROUP BY ALL) a USING (doc_id, section_index))""",
]

_W = fv.CONFIDENCE_WEIGHTS
CONFIDENCE = fixed(
    " + ".join(
        f"CASE WHEN {cond} THEN {_W[name]} ELSE 0.0 END"
        for name, cond in (
            ("act_name", "act_name IS NOT NULL"),
            ("chapter_number", "chapter_number IS NOT NULL"),
            ("section_number", "section_number IS NOT NULL"),
            ("section_title", "section_title IS NOT NULL"),
            ("keywords", "len(kw) > 0"),
            ("definitions", "n_definitions > 0"),
            ("authorities", "n_authorities > 0"),
            ("penalty", "penalty_raw IS NOT NULL"),
            ("related_sections", "len(related) > 0"),
            ("cross_references", "n_cross > 0"),
        )
    ),
    3,
)

# Section chunks of every statute with chapter filled forward.
CHUNKS = [
    STATUTES,
    f"chunk_heads AS ({spans('statutes', 'doc_id', 'text', fv.SECTION_HEADER, 'm')})",
    f"chapter_heads AS ({spans('statutes', 'doc_id', 'text', fv.CHAPTER_LINE, 'im')})",
    """chunk_bounds AS (
  SELECT doc_id, text, no - 1 AS chunk_index, start AS start_char,
         coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY no), length(text)) AS end_char, hit
  FROM chunk_heads
  UNION ALL
  SELECT doc_id, text, 0, 0, length(text), NULL FROM statutes
  WHERE doc_id NOT IN (SELECT doc_id FROM chunk_heads))""",
    """chunk_chapters AS (
  SELECT b.doc_id, b.chunk_index, max_by(c.hit, c.start) AS chapter_hit, max(c.start) AS chapter_start
  FROM chunk_bounds b JOIN chapter_heads c ON b.doc_id = c.doc_id AND c.start + length(c.hit) <= b.start_char
  WHERE b.hit IS NOT NULL GROUP BY ALL)""",
    f"""chunks AS (
  SELECT doc_id, chunk_index, start_char, end_char, text AS doc_text,
         {strip('substring(text, (start_char + 1)::INT, (end_char - start_char)::INT)')} AS content,
         {ext('chapter_hit', fv.CHAPTER_LINE, 2, 'im')} AS chapter_number,
         {ext("substring(text, (chapter_start + length(chapter_hit) - length(regexp_extract(chapter_hit, '(?im)" + fv.CHAPTER_LINE + "', 1)) + 1)::INT, (start_char - chapter_start - length(chapter_hit) + length(regexp_extract(chapter_hit, '(?im)" + fv.CHAPTER_LINE + "', 1)))::INT)", fv.CHAPTER_LINE_TITLE, 1, 'i')} AS chapter_name,
         {ext('hit', fv.SECTION_HEADER, 1, 'm')} AS section_number,
         {filled(strip(ext('hit', fv.SECTION_HEADER, 2, 'm')))} AS section_title
  FROM chunk_bounds LEFT JOIN chunk_chapters USING (doc_id, chunk_index))""",
]


def bm25_ctes(corpus: str, queries: str, name: str = "bm25") -> list[str]:
    """CTEs ending in ``{name}(query_id, chunk_id, raw, best)`` over two SELECTs.

    ``corpus`` gives ``chunk_id, text``; ``queries`` gives ``query_id, text``.
    """

    def terms(source: str, key: str) -> str:
        return (
            f"SELECT {key}, unnest(CASE WHEN s <> w THEN [w, s] ELSE [w] END) AS term FROM ("
            f"SELECT {key}, w, {stem('w')} AS s FROM (SELECT {key}, unnest({words('lower(text)')}) AS w FROM ({source})) "
            f"WHERE length(w) > 1)"
        )

    return [
        f"{name}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM ({terms(corpus, 'chunk_id')}) GROUP BY ALL)",
        f"{name}_dl AS (SELECT c.chunk_id, coalesce(n, 0) AS dl FROM ({corpus}) c LEFT JOIN "
        f"(SELECT chunk_id, sum(tf) AS n FROM {name}_tf GROUP BY 1) USING (chunk_id))",
        f"{name}_stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_dl)",
        f"{name}_idf AS (SELECT term, df, greatest(ln((n - df + 0.5) / (df + 0.5) + 1.0), {fv.IDF_FLOOR}) AS idf "
        f"FROM (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1), {name}_stats)",
        f"{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM ({terms(queries, 'query_id')}) GROUP BY ALL)",
        f"{name}_raw AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * {fv.BM25_K1 + 1} / "
        f"(tf + {fv.BM25_K1} * ({1 - fv.BM25_B} + {fv.BM25_B} * dl / greatest(avgdl, 1e-4)))) AS raw "
        f"FROM {name}_q JOIN {name}_idf USING (term) JOIN {name}_tf USING (term) JOIN {name}_dl USING (chunk_id), "
        f"{name}_stats GROUP BY ALL)",
        f"{name} AS (SELECT *, max(raw) OVER (PARTITION BY query_id) AS best FROM {name}_raw)",
    ]


def bm25_top(k: int, name: str = "bm25", where: str = "true") -> str:
    """SELECT of ``query_id, chunk_id, score, rank`` from the CTEs."""
    return (
        f"SELECT query_id, chunk_id, least(raw / best, 1.0) AS score, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY {fixed('raw', 9)} DESC, chunk_id) AS rank "
        f"FROM {name} WHERE {where} QUALIFY rank <= {k}"
    )
