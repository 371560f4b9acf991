"""Queries over the statute view: pages, chunks, extracted metadata, location."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import extract as ex
from tessellex.functions import text as tx
from tessellex.operators import chunking, documents, locate, validation
from tessellex.plans import sqlparts as sp
from tessellex.plans.registry import query
from tessellex.plans.tables import corpus, statutes, table
from tessellex.sources import files, pages


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _sections(spark, sf):
    return documents.split_sections(statutes(spark, sf).select("doc_id", "text")).withColumnRenamed(
        "section_text", "text"
    )


def _field_query(name: str, columns, select: str, ctes=None):
    """Query of one or more extracted fields over all sections."""

    @query(name, sp.with_ctes(ctes or sp.SECTIONS, f"SELECT doc_id, section_index, {select} FROM sections"))
    def run(spark, sf):
        return _sections(spark, sf).select("doc_id", *_big("section_index"), *columns())


_TEXT = F.col
_field_query(
    "act_name_year",
    lambda: [
        ex.act_name_year(F.col("text"))["act_name"].alias("act_name"),
        ex.act_name_year(F.col("text"))["act_year"].alias("act_year"),
    ],
    sp.act_fields("text"),
)
_field_query("act_number", lambda: [ex.act_number(F.col("text")).alias("act_number")], sp.act_number("text"))
_field_query("chapter", lambda: [F.inline(F.array(ex.chapter(F.col("text"))))], sp.chapter_fields("text"))
_field_query("section_number", lambda: [F.inline(F.array(ex.section(F.col("text"))))], sp.section_fields("text"))
_field_query("sub_section", lambda: [ex.sub_section(F.col("text")).alias("sub_section")], sp.sub_section("text"))
_field_query(
    "keywords",
    lambda: [F.array_join(ex.keywords(F.col("text")), "|").alias("keywords")],
    f"{sp.join(sp.keyword_list('text'))} AS keywords",
)
_field_query(
    "penalty",
    lambda: [
        *[ex.penalty(F.col("text"))[c].alias(c) for c in ("penalty_type", "imprisonment_years", "fine_amount")],
        ex.penalty(F.col("text"))["raw_text"].alias("penalty_raw"),
    ],
    sp.penalty_fields("text"),
)
_field_query(
    "related_sections",
    lambda: [F.array_join(ex.related_sections(F.col("text")), "|").alias("related_sections")],
    f"{sp.join(sp.related_list('text'))} AS related_sections",
)
_field_query(
    "printed_page_number",
    lambda: [ex.printed_page_number(F.col("text")).alias("page_number")],
    f"try_cast(coalesce({sp.ext('text', fv.PAGE_FOOTER, 1, 'm')}, {sp.ext('text', fv.PAGE_HEADER, 1, 'm')}) AS INTEGER) AS page_number",
)


@query("section_split", sp.with_ctes(sp.SECTIONS, "SELECT doc_id, section_index, page_no::BIGINT AS page_no, text FROM sections"))
def _section_split(spark, sf):
    return _sections(spark, sf).select("doc_id", *_big("section_index", "page_no"), "text")


@query(
    "definitions",
    sp.with_ctes(
        [*sp.SECTIONS, f"d AS ({sp.definition_rows('sections', 'doc_id, section_index')})"],
        "SELECT doc_id, section_index, pos, term, definition, section_ref FROM d",
    ),
)
def _definitions(spark, sf):
    rows = _sections(spark, sf).select(
        "doc_id", *_big("section_index"), F.posexplode(ex.definitions(F.col("text"))).alias("i", "d")
    )
    return rows.select("doc_id", "section_index", (F.col("i") + 1).cast("bigint").alias("pos"), "d.*")


@query(
    "authorities",
    sp.with_ctes(
        [*sp.SECTIONS, f"a AS ({sp.authority_rows('sections', 'doc_id, section_index')})"],
        "SELECT doc_id, section_index, pos, name, authority_type, raw_text FROM a",
    ),
)
def _authorities(spark, sf):
    rows = _sections(spark, sf).select(
        "doc_id", *_big("section_index"), F.posexplode(ex.authorities(F.col("text"))).alias("i", "a")
    )
    return rows.select("doc_id", "section_index", (F.col("i") + 1).cast("bigint").alias("pos"), "a.*")


@query(
    "cross_references",
    sp.with_ctes(
        sp.SECTIONS,
        f"""SELECT doc_id, section_index, 'section' AS ref_type, m AS ref_text,
  {sp.strip(sp.ext('m', fv.CROSS_REFERENCE, 2, 'm'))} AS act_name, {sp.strip(sp.ext('m', fv.CROSS_REFERENCE, 1, 'm'))} AS section_number
FROM (SELECT doc_id, section_index, unnest({sp.cross_list('text')}) AS m FROM sections)
UNION ALL SELECT doc_id, section_index, 'schedule', unnest({sp.schedule_list('text')}), NULL, NULL FROM sections""",
    ),
)
def _cross_references(spark, sf):
    return _sections(spark, sf).select(
        "doc_id", *_big("section_index"), F.inline(ex.cross_references(F.col("text")))
    )


_META_SQL = f"""doc_id, section_index, act_name, act_year, chapter_number, chapter_name, section_number, section_title,
  sub_section, page_no::INTEGER AS page_number, {sp.join('kw')} AS keywords, penalty_raw IS NOT NULL AS has_penalty, penalty_type,
  penalty_raw, imprisonment_years, fine_amount, {sp.join('related')} AS related_sections, coalesce(names, '') AS authority_names,
  coalesce(types, '') AS authority_types, n_definitions > 0 AS has_definitions, coalesce(terms, '') AS definition_terms,
  n_cross::BIGINT AS cross_ref_count, {sp.CONFIDENCE} AS extraction_confidence, '1.0.0' AS extractor_version,
  page_no::INTEGER AS page_range_start, page_no::INTEGER AS page_range_end"""


@query("section_metadata", sp.with_ctes(sp.SECTION_META, f"SELECT {_META_SQL} FROM section_meta"))
def _section_metadata(spark, sf):
    """The flat storage row of every section."""
    found = ex.extract_sections(_sections(spark, sf), "text", page_number=F.col("page_no"))
    flat = found.select("doc_id", *_big("section_index"), *ex.flatten_section(F.col("section")))
    lists = ("keywords", "related_sections", "authority_names", "authority_types", "definition_terms")
    return flat.withColumns(
        {c: F.array_join(c, "|") for c in lists} | {"cross_ref_count": F.col("cross_ref_count").cast("bigint")}
    )


@query(
    "section_labels",
    sp.with_ctes(
        sp.SECTION_META,
        """SELECT doc_id, section_index,
  coalesce(nullif(concat_ws(' ', act_name, '(' || act_year || ')', '§ ' || section_number, sub_section), ''), 'Unknown Section') AS label,
  coalesce(nullif(concat_ws(', ', act_name, act_year::VARCHAR, 'Section ' || section_number, 'p. ' || page_no), ''), 'Unknown') AS citation,
  coalesce(nullif(concat_ws(' and/or ', 'imprisonment up to ' || imprisonment_years || ' year(s)',
    'fine up to ₹' || format('{:,}', round_even(fine_amount, 0)::BIGINT)), ''), penalty_raw, 'unspecified') AS penalty FROM section_meta""",
    ),
)
def _section_labels(spark, sf):
    found = ex.extract_sections(_sections(spark, sf), "text", page_number=F.col("page_no"))
    s, p = F.col("section"), F.col("section.penalty")
    return found.select(
        "doc_id",
        *_big("section_index"),
        tx.section_label(s["act_name"], s["act_year"], s["section_number"], s["sub_section"]).alias("label"),
        tx.section_citation(s["act_name"], s["act_year"], s["section_number"], s["page_number"]).alias("citation"),
        tx.penalty_summary(p["imprisonment_years"], p["fine_amount"], p["raw_text"]).alias("penalty"),
    )


# ------------------------------------------------------------- documents ----
_HEAD = [
    *sp.SECTION_META,
    f"headers AS (SELECT doc_id, {sp.act_fields('text')}, {sp.act_number('text')} FROM statutes)",
    """named AS (SELECT m.* REPLACE (coalesce(m.act_name, h.act_name) AS act_name,
    CASE WHEN m.act_name IS NULL AND h.act_name IS NOT NULL THEN h.act_year ELSE m.act_year END AS act_year)
  FROM section_meta m JOIN headers h USING (doc_id))""",
    """word_rows AS (SELECT doc_id, k, min(section_index * 1000 + i) AS first_at FROM
  (SELECT doc_id, section_index, unnest(kw) AS k, generate_subscripts(kw, 1) AS i FROM named) GROUP BY ALL)""",
    """auth_rows AS (SELECT doc_id, name, min(section_index * 1000 + pos) AS first_at FROM section_authorities GROUP BY ALL)""",
    """rolled AS (
  SELECT n.doc_id,
    arg_min(act_name, section_index) FILTER (act_name IS NOT NULL) AS act_name,
    arg_min(act_year, section_index) FILTER (act_year IS NOT NULL) AS act_year,
    count(DISTINCT chapter_number) AS total_chapters, count(*) AS total_sections, max(page_no) AS total_pages,
    coalesce(string_agg(nullif(terms, ''), '|' ORDER BY section_index), '') AS definition_terms,
    coalesce(string_agg(section_number, '|' ORDER BY section_index) FILTER (penalty_raw IS NOT NULL), '') AS sections_with_penalties,
    sum(n_cross)::BIGINT AS n_cross
  FROM named n GROUP BY 1)""",
    """rollup_docs AS (
  SELECT r.*, h.act_number, coalesce(w.keywords, '') AS keywords, coalesce(w.tags, '') AS tags, coalesce(a.names, '') AS authorities
  FROM rolled r JOIN headers h USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(k, '|' ORDER BY first_at) AS keywords, string_agg(k, '|' ORDER BY first_at) FILTER (rn <= 20) AS tags
             FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS rn FROM word_rows) GROUP BY 1) w USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(name, '|' ORDER BY first_at) AS names FROM auth_rows GROUP BY 1) a USING (doc_id))""",
]
_ROLLUP_COLUMNS = (
    "doc_id, act_name, act_year, act_number, total_chapters, total_sections, total_pages::BIGINT AS total_pages, keywords, "
    "definition_terms, authorities, sections_with_penalties, n_cross"
)


def _flat_rollup(df):
    return df.select(
        "doc_id",
        "act_name",
        "act_year",
        *(["act_number"] if "act_number" in df.columns else []),
        *_big("total_chapters", "total_sections", "total_pages"),
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join(F.transform("definitions", lambda d: d["term"]), "|").alias("definition_terms"),
        F.array_join(F.transform("authorities", lambda a: a["name"]), "|").alias("authorities"),
        F.array_join("sections_with_penalties", "|").alias("sections_with_penalties"),
        F.size("cross_references").cast("bigint").alias("n_cross"),
    )


@query("doc_rollup", sp.with_ctes(_HEAD, f"SELECT {_ROLLUP_COLUMNS} FROM rollup_docs"))
def _doc_rollup(spark, sf):
    return _flat_rollup(documents.extract_documents(statutes(spark, sf)))


@query(
    "section_rollup",
    sp.with_ctes(
        [c.replace("coalesce(m.act_name, h.act_name) AS act_name", "m.act_name AS act_name").replace(
            "CASE WHEN m.act_name IS NULL AND h.act_name IS NOT NULL THEN h.act_year ELSE m.act_year END", "m.act_year") for c in _HEAD],
        f"SELECT {_ROLLUP_COLUMNS.replace('act_number, ', '')} FROM rollup_docs",
    ),
)
def _section_rollup(spark, sf):
    """The same roll-up as an aggregation of a section table."""
    found = ex.extract_sections(_sections(spark, sf), "text", page_number=F.col("page_no"))
    return _flat_rollup(documents.roll_up(found.select("doc_id", "section_index", "section")))


def _domain_sql() -> str:
    seen = f"lower(coalesce(act_name, '')) || ' ' || left(lower(text), {fv.HEADER_CHARS})"
    scores = [
        "(" + " + ".join(f"contains({seen}, {sp.lit(w)})::INT" for w in ws) + ")" for _, ws in fv.DOMAIN_SIGNALS
    ]
    best = f"greatest({', '.join(scores)})"
    arms = " ".join(f"WHEN {s} = {best} THEN {sp.lit(n)}" for (n, _), s in zip(fv.DOMAIN_SIGNALS, scores))
    return f"CASE WHEN {best} = 0 THEN 'unknown' {arms} END"


def _type_sql() -> str:
    seen = f"lower(coalesce(act_name, '')) || ' ' || lower(left(text, {fv.DOC_TYPE_CHARS}))"
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({seen}, {sp.lit(w)})' for w in ws)} THEN {sp.lit(n)}"
        for n, ws in fv.DOCUMENT_TYPE_SIGNALS
    )
    return f"CASE {arms} ELSE 'unknown' END"


_STEM_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(replace(regexp_replace(regexp_extract(source_file, '[^/]+$'), '\\.[^.]*$', ''), '_', ' '), "
    "'\\p{L}+|[^\\p{L}]+'), lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '')"
)
DESCRIBED = [
    *_HEAD,
    f"""described AS (
  SELECT doc_id, source_file, text, sha256(text) AS content_hash,
    CASE WHEN act_name IS NULL THEN {_STEM_TITLE} WHEN act_year IS NULL THEN act_name ELSE act_name || ', ' || act_year END AS title,
    {_domain_sql()} AS legal_domain, {_type_sql()} AS document_type, act_year AS year, 'India' AS jurisdiction, tags,
    total_pages::BIGINT AS total_pages, total_sections, act_number,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, 'completed' AS status
  FROM statutes JOIN rollup_docs USING (doc_id))""",
]


@query(
    "document_profile",
    sp.with_ctes(
        DESCRIBED,
        "SELECT doc_id, source_file, content_hash, title, legal_domain, document_type, year, jurisdiction, tags, total_pages, "
        "total_sections, act_number, word_count, status FROM described",
    ),
)
def _document_profile(spark, sf):
    df = documents.describe_documents(statutes(spark, sf))
    return df.select(
        "doc_id", "source_file", "content_hash", "title", "legal_domain", "document_type", "year", "jurisdiction",
        F.array_join("tags", "|").alias("tags"), *_big("total_pages", "total_sections"), "act_number",
        *_big("word_count"), "status",
    )


# ----------------------------------------------------------------- pages ----
_FF_PAGES = f"SELECT doc_id, page_no, {sp.strip('page')} AS text FROM statute_pages WHERE {sp.strip('page')} <> ''"


@query(
    "page_split_form_feed",
    sp.with_ctes(
        sp.SECTIONS[:2],
        f"""SELECT doc_id, page_no, text FROM ({_FF_PAGES}) WHERE doc_id IN (SELECT doc_id FROM statutes WHERE contains(text, chr(12)))
UNION ALL SELECT doc_id, 1, {sp.strip('text')} FROM statutes WHERE NOT contains(text, chr(12))""",
    ),
)
def _page_split_ff(spark, sf):
    df = pages.split_pages(statutes(spark, sf).select("doc_id", "text"))
    return df.select("doc_id", *_big("page_no"), "text")


@query(
    "page_split_lines",
    rf"""WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)),
pages AS (SELECT doc_id, ((i - 1) // 5) + 1 AS page_no, {sp.strip("string_agg(line, chr(10) ORDER BY i)")} AS text FROM lines GROUP BY ALL)
SELECT doc_id, page_no, text FROM pages WHERE text <> ''""",
)
def _page_split_lines(spark, sf):
    """Five lines per page, so that the given documents have many pages."""
    df = pages.split_pages(corpus(spark, sf).select("doc_id", "text"), lines_per_page=5)
    return df.select("doc_id", *_big("page_no"), "text")


def _statute_pages(spark, sf):
    return pages.split_pages(statutes(spark, sf).select("doc_id", "text"))


_PAGES = [
    *sp.SECTIONS[:2],
    f"pages_v AS ({_FF_PAGES} UNION ALL SELECT doc_id, 1, {sp.strip('text')} FROM statutes WHERE false)",
]
_EXTRACTS = [
    *_PAGES,
    """extracts AS (
  SELECT doc_id, page_no, 1 AS pass, CASE WHEN (doc_id + page_no) % 5 = 0 THEN left(text, 12) ELSE text END AS text
    FROM pages_v WHERE (doc_id + page_no) % 7 <> 0 AND doc_id % 11 <> 0
  UNION ALL SELECT doc_id, page_no, 2, 'second ' || text FROM pages_v WHERE (doc_id + page_no) % 3 <> 0 AND doc_id % 22 <> 0
  UNION ALL SELECT doc_id, page_no, 3, 'third ' || text FROM pages_v)""",
]


def _extracts(spark, sf):
    """Three extraction passes with short and missing pages, derived from the statute pages."""
    base = _statute_pages(spark, sf)
    n = F.col("doc_id") + F.col("page_no")
    first = base.where((n % 7 != 0) & (F.col("doc_id") % 11 != 0)).select(
        "doc_id", "page_no", F.lit(1).alias("pass"), F.when(n % 5 == 0, F.left("text", F.lit(12))).otherwise(F.col("text")).alias("text")
    )
    second = base.where((n % 3 != 0) & (F.col("doc_id") % 22 != 0)).select(
        "doc_id", "page_no", F.lit(2).alias("pass"), F.concat(F.lit("second "), F.col("text")).alias("text")
    )
    third = base.select("doc_id", "page_no", F.lit(3).alias("pass"), F.concat(F.lit("third "), F.col("text")).alias("text"))
    return first.unionByName(second).unionByName(third)


_MERGED = f"""merged AS (
  WITH p AS (SELECT doc_id, page_no, max(text) FILTER (pass = 1) AS p1, max(text) FILTER (pass = 2) AS p2, max(text) FILTER (pass = 3) AS p3
             FROM extracts GROUP BY ALL),
  first AS (SELECT doc_id FROM p GROUP BY 1 HAVING count(p1) = 0 OR count(*) FILTER (length({sp.strip('p1')}) < 30) > 0),
  m AS (SELECT p.*, CASE WHEN first.doc_id IS NULL OR length({sp.strip('p1')}) >= 30 THEN p1 ELSE coalesce(p2, p1) END AS m12
        FROM p LEFT JOIN first USING (doc_id)),
  second AS (SELECT doc_id FROM m GROUP BY 1 HAVING count(m12) = 0 OR count(*) FILTER (length({sp.strip('m12')}) < 30) > 0)
  SELECT doc_id, page_no, coalesce(m12, CASE WHEN second.doc_id IS NOT NULL THEN p3 END) AS text FROM m LEFT JOIN second USING (doc_id)
  WHERE coalesce(m12, CASE WHEN second.doc_id IS NOT NULL THEN p3 END) IS NOT NULL)"""


@query("page_merge", sp.with_ctes([*_EXTRACTS, _MERGED], "SELECT doc_id, page_no::BIGINT AS page_no, text FROM merged"))
def _page_merge(spark, sf):
    return pages.merge_extracts(_extracts(spark, sf)).select("doc_id", *_big("page_no"), "text")


@query(
    "text_assembly",
    sp.with_ctes([*_EXTRACTS, _MERGED], f"SELECT doc_id, string_agg(text, chr(12) ORDER BY page_no) AS text FROM merged WHERE {sp.strip('text')} <> '' GROUP BY 1"),
)
def _text_assembly(spark, sf):
    return pages.assemble_text(pages.merge_extracts(_extracts(spark, sf)))


@query(
    "paragraph_pages",
    f"""WITH lines AS (
  SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
paras AS (
  SELECT doc_id, pos, CASE WHEN pos % 11 = 3 THEN 0 WHEN pos % 7 = 5 THEN 2 ELSE 1 END AS part,
    CASE WHEN pos % 11 = 3 THEN '[HEADER] ' || {sp.strip('text')}
         WHEN pos % 7 = 5 THEN array_to_string(list_filter(list_transform(string_split(text, ' '), lambda c: {sp.strip('c')}), lambda c: c <> ''), ' | ')
         WHEN pos % 5 = 0 THEN chr(10) || repeat('#', (pos % 3 + 1)::INT) || ' ' || {sp.strip('text')} || chr(10)
         ELSE {sp.strip('text')} END AS line
  FROM lines WHERE {sp.strip('text')} <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS idx FROM paras)
SELECT doc_id, idx // 40 + 1 AS page_no, string_agg(line, chr(10) ORDER BY idx) AS text FROM numbered GROUP BY ALL""",
)
def _paragraph_pages(spark, sf):
    """Document lines as paragraphs of every kind, by position."""
    rows = corpus(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pos = F.col("pos")
    kind = (
        F.when(pos % 11 == 3, "header").when(pos % 7 == 5, "table").when(pos % 5 == 0, "heading").otherwise("body")
    )
    paragraphs = rows.select(
        "doc_id", "pos", kind.alias("kind"), (pos % 3 + 1).alias("level"), "text", F.split("text", " ").alias("cells")
    )
    return pages.paragraph_pages(paragraphs).select("doc_id", *_big("page_no"), "text")


@query(
    "devanagari_pages",
    sp.with_ctes(
        _PAGES,
        """SELECT doc_id, page_no, (length(h) > 80 OR length(h) / length(text) > 0.15) AS is_devanagari
FROM (SELECT doc_id, page_no, text, regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g') AS h FROM pages_v)""".replace("\\\\", "\\"),
    ),
)
def _devanagari(spark, sf):
    return _statute_pages(spark, sf).select(
        "doc_id", *_big("page_no"), tx.is_devanagari_page(F.col("text")).alias("is_devanagari")
    )


# ---------------------------------------------------------------- chunks ----
_CHUNK_COLUMNS = "doc_id, chunk_index, start_char, end_char, content, chapter_number, chapter_name, section_number, section_title"


@query("section_chunks", sp.with_ctes(sp.CHUNKS, f"SELECT {_CHUNK_COLUMNS} FROM chunks"))
def section_chunks(spark, sf):
    df = chunking.section_chunks(statutes(spark, sf).select("doc_id", "text"))
    return df.drop("text").withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "start_char", "end_char")})


def _sub_sql(column: str) -> dict[str, str]:
    block = lambda p: f"list_transform({sp.ext_all(column, p, 0, 'i')}, lambda s: {sp.strip('s')})"
    line = sp.ext_all(column, fv.SUB_SECTION_LINE, 0, "m")
    return {
        "provisos": block(fv.PROVISO),
        "explanations": block(fv.EXPLANATION),
        "illustrations": block(fv.ILLUSTRATION),
        "exceptions": block(fv.EXCEPTION),
        "sub_sections": f"list_transform({line}, lambda m: '(' || {sp.ext('m', fv.SUB_SECTION_LINE, 1, 'm')} || ') ' || {sp.strip(sp.ext('m', fv.SUB_SECTION_LINE, 2, 'm'))})",
    }


@query(
    "sub_elements",
    sp.with_ctes(
        sp.CHUNKS,
        "SELECT doc_id, chunk_index, " + ", ".join(f"{sp.join(e)} AS {n}" for n, e in _sub_sql("content").items()) + " FROM chunks",
    ),
)
def _sub_elements(spark, sf):
    df = chunking.section_chunks(statutes(spark, sf).select("doc_id", "text"))
    parts = chunking.sub_elements(F.col("content"))
    return df.select("doc_id", *_big("chunk_index"), *[F.array_join(c, "|").alias(n) for n, c in parts.items()])


_RICH = [
    *DESCRIBED,
    *sp.CHUNKS[1:],
    "chunk_texts AS (SELECT doc_id, chunk_index, content AS text FROM chunks)",
    f"chunk_authorities AS ({sp.authority_rows('chunk_texts', 'doc_id, chunk_index')})",
    f"""chunk_facts AS (SELECT doc_id, chunk_index, {sp.act_fields('text')}, {sp.chapter_fields('text')}, {sp.section_fields('text')},
      {sp.keyword_list('text')} AS kw, {sp.penalty_fields('text')} FROM chunk_texts)""",
    f"""rich AS (
  SELECT c.doc_id, c.chunk_index, c.content, d.source_file, d.legal_domain, d.document_type,
    coalesce(h.act_name, f.act_name, d.title) AS act_name,
    coalesce(h.act_year, f.act_year, d.year) AS act_year,
    coalesce(c.chapter_number, f.chapter_number) AS chapter_number, coalesce(c.chapter_name, f.chapter_name) AS chapter_name,
    coalesce(c.section_number, f.section_number) AS section_number, coalesce(c.section_title, f.section_title) AS section_title,
    len({_sub_sql('content')['explanations']}) > 0 AS has_explanation, len({_sub_sql('content')['provisos']}) > 0 AS has_proviso,
    f.penalty_raw IS NOT NULL AS has_penalty, f.penalty_type, f.fine_amount, f.imprisonment_years, {sp.join('f.kw')} AS keywords,
    coalesce(a.names, '') AS authorities,
    array_to_string(list_sort(list_distinct(list_concat(f.kw, string_split(d.tags, '|')))), '|') AS tags, d.title AS doc_title
  FROM chunks c JOIN described d USING (doc_id) JOIN headers h USING (doc_id) JOIN chunk_facts f USING (doc_id, chunk_index)
  LEFT JOIN (SELECT doc_id, chunk_index, string_agg(name, '|' ORDER BY pos) AS names FROM chunk_authorities GROUP BY ALL) a USING (doc_id, chunk_index))""",
    """rich_chunks AS (SELECT *, CASE WHEN section_number IS NULL THEN doc_title ELSE act_name || ' — Section ' || section_number END AS chunk_title FROM rich)""",
]


def rich_chunks(docs):
    """Described statutes as enriched section chunks."""
    described = documents.describe_documents(docs).select(
        "doc_id", "source_file", "text", "title", "year", "tags", "legal_domain", "document_type"
    )
    return chunking.enrich_sections(chunking.section_chunks(described))


RICH_CTES = _RICH


@query(
    "section_chunk_metadata",
    sp.with_ctes(
        _RICH,
        "SELECT doc_id, chunk_index, act_name, act_year, chapter_number, chapter_name, section_number, section_title, has_explanation, has_proviso, "
        "has_penalty, penalty_type, fine_amount, imprisonment_years, keywords, authorities, tags, chunk_title FROM rich_chunks",
    ),
)
def _section_chunk_metadata(spark, sf):
    return rich_chunks(statutes(spark, sf)).select(
        "doc_id", *_big("chunk_index"), "act_name", "act_year", "chapter_number", "chapter_name", "section_number", "section_title",
        "has_explanation", "has_proviso", "has_penalty", "penalty_type", "fine_amount", "imprisonment_years",
        *[F.array_join(c, "|").alias(c) for c in ("keywords", "authorities", "tags")], "chunk_title",
    )


def _segment_ctes(docs: str) -> list[str]:
    """``segments(doc_id, start_char, end_char, segment)``: cut before every boundary line."""
    marked = f"regexp_replace(text, {sp.lit('(?im)^' + fv.STRUCTURE_BOUNDARY.replace('(?:^|' + chr(92) + 'n)', ''))}, chr(30) || '\\0', 'g')"
    return [
        f"seg_docs AS ({docs})",
        f"""seg_parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS no FROM (
  SELECT doc_id, string_split({marked}, chr(30)) AS p FROM seg_docs))""",
        """seg_located AS (SELECT doc_id, no, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY no) - length(part) AS start_char FROM seg_parts)""",
        # The line break before a boundary is a segment of its own, which is blank and dropped.
        f"""segments AS (SELECT doc_id, start_char, start_char + length(part) - cut AS end_char, left(part, (length(part) - cut)::INT) AS segment FROM (
  SELECT *, CASE WHEN part LIKE '%' || chr(10) AND lead(no) OVER (PARTITION BY doc_id ORDER BY no) IS NOT NULL THEN 1 ELSE 0 END AS cut FROM seg_located)
  WHERE {sp.strip('part')} <> '' OR (no = 1 AND length(part) - cut > 0))""",
    ]


@query(
    "structural_segments",
    sp.with_ctes([sp.STATUTES, *_segment_ctes("SELECT doc_id, text FROM statutes")], "SELECT doc_id, start_char, end_char, segment FROM segments"),
)
def _structural_segments(spark, sf):
    df = chunking.structural_segments(statutes(spark, sf).select("doc_id", "text"))
    return df.select("doc_id", *_big("start_char", "end_char"), "segment")


def _window_ctes(size: int, overlap: int, stuck: str = "cur + 1") -> list[str]:
    """Recursive cursor over the long segments; short ones are one window."""
    win = "substring(segment, (cur + 1)::INT, {n})".format(n=size)
    last_nl = f"CASE WHEN contains({win}, chr(10)) THEN {size} - instr(reverse({win}), chr(10)) ELSE 0 END"
    last_sp = f"CASE WHEN contains({win}, ' ') THEN {size} - instr(reverse({win}), ' ') ELSE 0 END"
    fin = (
        f"CASE WHEN cur + {size} >= length(segment) THEN length(segment) WHEN {last_nl} > 0 THEN cur + {last_nl} "
        f"WHEN {last_sp} > 0 THEN cur + {last_sp} ELSE cur + {size} END"
    )
    return [
        f"""cursor_rows AS (
  SELECT doc_id, start_char, segment, 0 AS cur, {fin.replace('cur + ', '0 + ').replace('(cur', '(0')} AS fin FROM segments WHERE length(segment) > {size}
  UNION ALL
  SELECT doc_id, start_char, segment, cur, {fin} FROM (
    SELECT doc_id, start_char, segment, CASE WHEN fin - {overlap} > cur THEN fin - {overlap} ELSE {stuck} END AS cur FROM cursor_rows WHERE fin < length(segment)))""",
        f"""windows AS (
  SELECT doc_id, start_char + cur AS start_char, start_char + fin AS end_char, substring(segment, (cur + 1)::INT, (fin - cur)::INT) AS content
  FROM cursor_rows WHERE {sp.strip('substring(segment, (cur + 1)::INT, (fin - cur)::INT)')} <> ''
  UNION ALL SELECT doc_id, start_char, end_char, segment FROM segments WHERE length(segment) <= {size})""",
    ]


def _window_sql(stuck: str) -> str:
    ctes = [*_segment_ctes("SELECT doc_id, text FROM documents"), *_window_ctes(1000, 200, stuck)]
    return (
        "WITH RECURSIVE " + ",\n".join(ctes)
        + "\nSELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char) - 1 AS chunk_index, start_char, end_char, content FROM windows"
    )


@query("sliding_chunks", _window_sql("cur + 1"))
def sliding_chunks(spark, sf):
    df = chunking.sliding_chunks(corpus(spark, sf).select("doc_id", "text"))
    return df.select("doc_id", *_big("chunk_index", "start_char", "end_char"), "content")


@query("sliding_chunks_min_advance", _window_sql("fin"))
def sliding_chunks_min_advance(spark, sf):
    df = chunking.sliding_chunks(corpus(spark, sf).select("doc_id", "text"), min_advance=True)
    return df.select("doc_id", *_big("chunk_index", "start_char", "end_char"), "content")


@query(
    "structural_chunks",
    "WITH RECURSIVE "
    + ",\n".join(
        [*DESCRIBED, *_segment_ctes("SELECT doc_id, text FROM statutes"), *_window_ctes(300, 60),
         "window_texts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char) - 1 AS chunk_index, start_char, end_char, content AS text FROM windows)",
         f"""facts AS (SELECT doc_id, chunk_index, start_char, end_char, {sp.act_fields('text')}, {sp.chapter_fields('text')}, {sp.section_fields('text')}, {sp.sub_section('text')},
            {sp.join(sp.keyword_list('text'))} AS keywords, {sp.join(sp.related_list('text'))} AS related_sections, {sp.penalty_fields('text')} FROM window_texts)"""]
    )
    + """
SELECT doc_id, chunk_index, start_char, end_char,
  CASE WHEN section_number IS NULL THEN title ELSE concat_ws(' ', act_name, '(' || act_year || ')', '§ ' || section_number, sub_section) END AS title,
  coalesce(act_name, title) AS act_name, coalesce(act_year, year) AS act_year, chapter_number, section_number, section_title, keywords, related_sections, penalty_type
FROM (SELECT f.*, d.title, d.year FROM facts f JOIN described d USING (doc_id))""",
)
def _structural_chunks(spark, sf):
    df = chunking.structural_chunks(documents.title_documents(statutes(spark, sf)), size=300, overlap=60)
    return df.select(
        "doc_id", *_big("chunk_index", "start_char", "end_char"), "title", "act_name", "act_year", "chapter_number", "section_number",
        "section_title", *[F.array_join(c, "|").alias(c) for c in ("keywords", "related_sections")], "penalty_type",
    )


# -------------------------------------------------------------- location ----
def _locator_score_sql() -> str:
    p = fv.LOCATOR_SCORES
    heading = r"regexp_matches(p.text, '(?:\n|^)\s*' || regexp_escape(digits) || '\.\s*(?:\n|\s+)[A-Za-z]')"
    word = r"regexp_matches(regexp_replace(p.text, '(?i)sub-section', 'x', 'g'), '(?i)\bSection\s+' || regexp_escape(digits) || '\b')"
    hits = "len(list_filter(words, lambda w: contains(lower(p.text), w)))"
    phrases = " OR ".join(f"contains(upper(p.text), {sp.lit(x)})" for x in fv.CONTENTS_PHRASES)
    toc = (
        f"({phrases} OR (p.page_no <= 3 AND NOT {sp.matches('p.text', fv.BODY_SUB_SECTION)} "
        f"AND len({sp.ext_all('p.text', fv.CONTENTS_LINE)}) >= 6))"
    )
    form = sp.matches("upper(p.text)", fv.FORM_HEADER)
    return f"""SELECT doc_id, chunk_index, page_no, {heading} AS heading, {word} AS word, {hits} AS hits,
  {p['heading']} * {heading}::INT + {p['section_word']} * {word}::INT + {p['title_word']} * {hits} + {p['not_contents']} * (NOT {toc})::INT
  + {p['not_form']} * (NOT {form})::INT AS score FROM wanted JOIN good_pages p USING (doc_id)"""


_STOP = "[" + ", ".join(sp.lit(w) for w in fv.LOCATOR_STOP_WORDS) + "]"
_LOCATE = [
    *sp.CHUNKS,
    *_PAGES[1:2],
    _PAGES[2],
    "all_pages AS (SELECT doc_id, page_no, text FROM pages_v)",
    """good_pages AS (SELECT * FROM all_pages WHERE NOT (length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) > 80
      OR length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) / length(text) > 0.15))""",
    f"""wanted AS (SELECT doc_id, chunk_index, regexp_extract(section_number, '(?i)\\d+[A-Z]?') AS digits,
      list_slice(list_filter(list_transform(regexp_extract_all(coalesce(section_title, ''), '[A-Za-z]{{4,}}'), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w)), 1, 5) AS words
      FROM chunks WHERE section_number IS NOT NULL)""",
    f"scored AS ({_locator_score_sql()})",
    """located AS (SELECT c.doc_id, c.chunk_index, c.section_number, c.section_title, coalesce(s.page_no, 1) AS page FROM chunks c LEFT JOIN (
      SELECT * FROM scored WHERE heading OR word OR hits >= 2
      QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, page_no) = 1) s USING (doc_id, chunk_index))""",
]


def _located(spark, sf):
    docs = statutes(spark, sf).where(tx.blank_to_null(F.col("text")).isNotNull())
    text = F.col("text")
    lists = docs.select("doc_id", chunking.section_list(text).alias("sections"), pages.page_list(text).alias("pages"))
    return locate.locate_in_documents(lists)


@query("page_locator_tables", sp.with_ctes(_LOCATE, "SELECT doc_id, chunk_index, section_number, page::BIGINT AS page FROM located"))
def _page_locator_tables(spark, sf):
    """Sections and pages as two tables, as extraction passes leave them."""
    sections = chunking.section_chunks(statutes(spark, sf).select("doc_id", "text")).select(
        "doc_id", F.col("chunk_index").alias("section_id"), "section_number", "section_title"
    )
    return locate.locate_pages(sections, _statute_pages(spark, sf)).select(
        "doc_id", F.col("section_id").cast("bigint").alias("chunk_index"), "section_number", *_big("page")
    )


@query("page_locator", sp.with_ctes(_LOCATE, "SELECT doc_id, chunk_index, section_number, page::BIGINT AS page FROM located"))
def _page_locator(spark, sf):
    return _located(spark, sf).select(
        "doc_id", F.col("section_id").cast("bigint").alias("chunk_index"), "section_number", *_big("page")
    )


_HEADING_STOP = "[" + ", ".join(sp.lit(w) for w in fv.HEADING_STOP_WORDS) + "]"


@query(
    "heading_locator",
    sp.with_ctes(
        [
            *_LOCATE,
            f"""asked AS (SELECT l.doc_id, l.chunk_index, regexp_extract(l.section_number, '(?i)\\d+[A-Z]?') AS d, p.text,
      list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(section_title, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
        lambda w: length(w) > 3 AND NOT list_contains({_HEADING_STOP}, w)) AS ws
      FROM located l JOIN all_pages p ON l.doc_id = p.doc_id AND l.page = p.page_no WHERE l.section_number IS NOT NULL)""",
            f"""lines AS (SELECT doc_id, chunk_index, d, ws, unnest(string_split(text, chr(10))) AS raw,
      generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM asked)""",
            """followed AS (SELECT *, list(raw) OVER (PARTITION BY doc_id, chunk_index ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS nxt FROM lines)""",
            f"""judged AS (SELECT *, upper({sp.strip('raw')}) AS line, regexp_matches(raw, '[\\x{{0900}}-\\x{{097F}}]') AS hindi,
      coalesce(len(list_filter(nxt, lambda t: len(list_filter(ws, lambda w: contains(lower(t), w))) > 0)), 0) AS hits FROM followed)""",
            """hits AS (SELECT doc_id, chunk_index, line_no, hits AS s, 0 AS tier FROM judged WHERE NOT hindi AND (line = d OR line = d || ':' OR
        starts_with(line, d || '.') OR starts_with(line, 'SECTION ' || d) OR starts_with(line, 'SEC. ' || d) OR starts_with(line, 'RULE ' || d) OR starts_with(line, d || '('))
      UNION ALL SELECT doc_id, chunk_index, line_no, 0, 1 FROM judged WHERE NOT hindi AND
        (contains(line, d || '.') OR contains(line, 'SECTION ' || d) OR contains(line, 'RULE ' || d)))""",
        ],
        """SELECT a.doc_id, a.chunk_index, h.line_no, h.s AS heading_score FROM asked a LEFT JOIN (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY tier, s DESC, line_no) = 1) h USING (doc_id, chunk_index)""",
    ),
)
def _heading_locator(spark, sf):
    located = _located(spark, sf).where(F.col("section_number").isNotNull() & F.col("page_text").isNotNull())
    paged = located.withColumnRenamed("page_text", "text")
    return locate.locate_headings(paged).select(
        "doc_id", F.col("section_id").cast("bigint").alias("chunk_index"), *_big("line_no", "heading_score")
    )


_FILES = ("passports_act_1967.pdf", "the_citizenship_act_1955.pdf", "visa_control_manual.pdf", "waterways.pdf")


def _resolve_sql() -> str:
    keys = " ".join(f"WHEN contains(low, {sp.lit(k)}) THEN {sp.lit(f)}" for k, f in fv.ACT_FILES)
    names = " ".join(
        f"WHEN len(list_filter(ws, lambda w: contains({sp.lit(f.lower())}, w))) > 0 THEN {sp.lit(f)}" for f in sorted(_FILES)
    )
    return (
        f"CASE WHEN list_contains([{', '.join(sp.lit(f) for f in _FILES)}], base) THEN base "
        f"WHEN contains(both_, 'rules') OR contains(both_, 'rule ') THEN {sp.lit(fv.RULES_FILE)} WHEN act_name IS NULL THEN {sp.lit(fv.DEFAULT_FILE)} "
        f"{keys} {names} ELSE {sp.lit(fv.DEFAULT_FILE)} END"
    )


@query(
    "act_file_resolution",
    sp.with_ctes(
        [sp.STATUTES, f"acts AS (SELECT doc_id, source_file, {sp.act_fields('text')} FROM statutes)",
         r"""ready AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'waterways.pdf' ELSE regexp_extract(source_file, '[^/]+$') END AS base,
           lower(coalesce(act_name, '') || ' ' || CASE WHEN doc_id % 3 = 2 THEN 'Short title' ELSE 'rule of entry' END) AS both_,
           lower(act_name) AS low, list_filter(regexp_split_to_array(lower(act_name), '\s+'), lambda w: length(w) > 3) AS ws FROM acts)"""],
        f"SELECT doc_id, {_resolve_sql()} AS file_name FROM ready",
    ),
)
def _act_files(spark, sf):
    acts = statutes(spark, sf).withColumn("act", ex.act_name_year(F.left("text", F.lit(fv.HEADER_CHARS))))
    given = F.when(F.col("doc_id") % 4 == 1, F.lit("waterways.pdf")).otherwise(F.col("source_file"))
    title = F.when(F.col("doc_id") % 3 == 2, F.lit("Short title")).otherwise(F.lit("rule of entry"))
    return acts.select(
        "doc_id", locate.resolve_file(F.col("act.act_name"), given, title, _FILES).alias("file_name")
    )


# ----------------------------------------------------------------- files ----
@query(
    "file_order",
    """SELECT path, row_number() OVER (ORDER BY path) AS file_no FROM (
  SELECT 'corpus/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents)""",
)
def _file_order(spark, sf):
    parts = (F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files.numbered(table(spark, sf, "documents").select(F.concat(*parts).alias("path")))


# Texts that hold the characters which ``find_spans`` uses as marks. The SQL, which marks matches by the same ones, has another in their
# place, so that offsets are the same; contents are compared without any of them.
_CONTROL = "chr(30) || 'x' || chr(31) || text || chr(30)"


@query(
    "section_chunks_control",
    sp.with_ctes(
        [sp.STATUTES.replace("statutes AS", "plain_statutes AS", 1), f"statutes AS (SELECT doc_id, source_file, {_CONTROL.replace('30', '29').replace('31', '29')} AS text FROM plain_statutes)", *sp.CHUNKS[1:]],
        r"SELECT doc_id, chunk_index, start_char, end_char, section_number, sha256(regexp_replace(regexp_replace(content, '[\x1d-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g')) AS content_sha256 FROM chunks",
    ),
)
def _section_chunks_control(spark, sf):
    """Offsets count in the original text, whatever characters it has."""
    marked = statutes(spark, sf).select("doc_id", F.expr(_CONTROL).alias("text"))
    content = F.regexp_replace(F.regexp_replace("content", r"[\x1d-\x1f]", ""), r"^\s+|\s+$", "")
    return chunking.section_chunks(marked).select(
        "doc_id", *_big("chunk_index", "start_char", "end_char"), "section_number", F.sha2(content, 256).alias("content_sha256")
    )


_PATHS = """paths AS (SELECT doc_id, 'corpus/' || source || '/Doc_' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.doc'
  WHEN 3 THEN '.txt' WHEN 4 THEN '.Text' WHEN 5 THEN '.html' WHEN 6 THEN '' ELSE '.tar.gz' END AS path FROM documents)"""


def _paths(spark, sf):
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".DOCX", ".doc", ".txt", ".Text", ".html", "", ".tar.gz")])
    suffix = F.get(suffixes, (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("corpus/"), F.col("source"), F.lit("/Doc_"), F.col("doc_id").cast("string"), suffix).alias("path"),
    )


@query(
    "file_dispatch",
    sp.with_ctes(
        [_PATHS],
        r"""SELECT doc_id, CASE lower(regexp_extract(path, '\.[^./]+$')) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.doc' THEN 'docx'
  WHEN '.txt' THEN 'txt' WHEN '.text' THEN 'txt' END AS parser,
  CASE WHEN lower(regexp_extract(path, '\.[^./]+$')) NOT IN ('.pdf', '.docx', '.doc', '.txt', '.text') THEN 'unsupported file type: ' || lower(regexp_extract(path, '\.[^./]+$')) END AS reason
FROM paths""",
    ),
)
def _file_dispatch(spark, sf):
    supported, rejected = files.split_supported(_paths(spark, sf))
    none = F.lit(None).cast("string")
    return supported.select("doc_id", "parser", none.alias("reason")).unionByName(
        rejected.select("doc_id", none.alias("parser"), "reason")
    )


@query(
    "path_titles",
    sp.with_ctes([_PATHS], "SELECT doc_id, " + _STEM_TITLE.replace("source_file", "path").replace("'\\.[^.]*$'", "'\\.[^.]*$'")
                 + r" AS title, regexp_extract(path, '[^/]+$') AS base_name, 'file:///' || path || CASE WHEN doc_id % 3 > 0 THEN '#page=' || doc_id % 3 ELSE '' END AS link FROM paths"),
)
def _path_titles(spark, sf):
    path = F.col("path")
    return _paths(spark, sf).select(
        "doc_id",
        tx.title_from_stem(path).alias("title"),
        tx.base_name(path).alias("base_name"),
        tx.file_link(path, (F.col("doc_id") % 3).cast("int")).alias("link"),
    )


# ------------------------------------------------------------ validation ----
@query(
    "validate_documents",
    """SELECT o_orderkey, CASE WHEN trim(src) = '' THEN 'source_file is blank' WHEN year < 1947 OR year > 2100 THEN 'year outside 1947..2100' END AS reason
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE o_orderpriority END AS src,
  CASE WHEN o_orderkey % 5 > 0 THEN 1900 + o_orderkey % 250 END AS year FROM orders)""",
)
def _validate_documents(spark, sf):
    key = F.col("o_orderkey")
    docs = table(spark, sf, "orders").select(
        key,
        F.when(key % 9 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("source_file"),
        F.when(key % 5 > 0, (1900 + key % 250).cast("int")).alias("year"),
    )
    return validation.check(docs, validation.document_rules()).select("o_orderkey", "reason")


@query(
    "validate_chunks",
    """SELECT l_orderkey, l_linenumber, CASE WHEN b < 0 THEN 'start_char below 0' WHEN e < b THEN 'end_char below start_char' END AS reason, count(*) AS n
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 - 5 AS b, l_suppkey % 100 AS e FROM lineitem) GROUP BY ALL""",
)
def _validate_chunks(spark, sf):
    chunks = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(0).alias("chunk_index"),
        (F.col("l_partkey") % 100 - 5).alias("start_char"), (F.col("l_suppkey") % 100).alias("end_char"),
    )
    checked = validation.check(chunks, validation.chunk_rules())
    return checked.groupBy("l_orderkey", "l_linenumber", "reason").agg(F.count("*").alias("n"))


@query(
    "normalise_sections",
    f"SELECT o_orderkey, {sp.normalised('x')} AS section_number FROM (SELECT o_orderkey, "
    "CASE o_orderkey % 5 WHEN 0 THEN ' Section ' || o_orderkey || 'a ' WHEN 1 THEN 'E' || o_orderkey WHEN 2 THEN '   ' WHEN 3 THEN 'sec' || o_orderkey ELSE o_orderkey || 's' END AS x FROM orders)",
)
def _normalise(spark, sf):
    key = F.col("o_orderkey")
    n = key.cast("string")
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit(" Section "), n, F.lit("a ")))
        .when(key % 5 == 1, F.concat(F.lit("E"), n))
        .when(key % 5 == 2, F.lit("   "))
        .when(key % 5 == 3, F.concat(F.lit("sec"), n))
        .otherwise(F.concat(n, F.lit("s")))
    )
    return table(spark, sf, "orders").select(key, tx.normalise_section(raw).alias("section_number"))
