"""Queries from candidates to responses and metrics, and over conversations.

Questions and answers are derived from ``nation``; passages are the BM25 top
of each question over the section chunks of all statutes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators import bm25, evaluation, sessions, shaping
from tessellex.operators.chunking import section_chunks, section_size
from tessellex.operators.sizing import is_small, join_measured
from tessellex.plans import sqlparts as sp
from tessellex.plans.extraction import RICH_CTES, rich_chunks
from tessellex.plans.registry import query
from tessellex.plans.tables import statutes, table
from tessellex.sources import sinks
from tessellex.sources.scratch import ensure_checkpoint_dir

ASKS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS query_id,
  CASE n_nationkey % 6
    WHEN 0 THEN 'penalty of imprisonment and fine for contravening section ' || CAST(n_nationkey % 19 + 4 AS STRING)
    WHEN 1 THEN 'who holds a citizenship certificate as a citizen of grade'
    WHEN 2 THEN 'powers of the Central Government under the Passports Act'
    WHEN 3 THEN 'deportation or cancelled certificate by the passport officer'
    WHEN 4 THEN 'zzqx vvkw' || CAST(n_nationkey AS STRING)
    ELSE 'short title of the Emigration law' END AS text,
  CASE n_nationkey % 4
    WHEN 0 THEN 'Section 3 provides that whoever contravenes the Act shall be punishable with imprisonment. The moon is made entirely of green cheese tonight! See also rule 7(1) and sec. 12a.'
    WHEN 1 THEN 'The provided statutory documents do not contain sufficient information to answer this question.'
    WHEN 2 THEN '  The Central Government may make an order under section 4. section 4 applies to emigration clearance? '
    ELSE 'Yes. No. Ok.' END AS answer,
  CASE n_nationkey % 3 WHEN 0 THEN 'Section 3| section 4 ' WHEN 1 THEN '' ELSE '2|4' END AS expected
FROM nation
"""


def _asks(spark, sf):
    nation = table(spark, sf, "nation")
    return spark.sql(ASKS_SQL.replace("FROM nation", "FROM {nation}"), nation=nation)


def _key():
    return (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id")


def _candidates(spark, sf, k=4):
    docs = statutes(spark, sf).select("doc_id", "text")
    chunks = section_chunks(docs).select(_key(), F.col("content").alias("text"))
    return bm25.search_corpus(chunks, _asks(spark, sf).select("query_id", "text"), k, size=section_size(docs))


def _passages(spark, sf, k=4):
    """Candidates with metadata. Only documents that hold a candidate are described.

    The candidates, k rows per question, are cut off with a checkpoint, measured,
    and used twice: to thin out the documents and to pick the chunks.
    """
    ensure_checkpoint_dir(spark)
    candidates = _candidates(spark, sf, k).checkpoint()
    small = is_small(candidates, F.lit(64))
    held = candidates.select(F.floor(F.col("chunk_id") / 1000).alias("doc_id")).distinct()
    docs = join_measured(statutes(spark, sf), held, "doc_id", small, "left_semi")
    page = F.when(F.col("chunk_index") % 2 == 1, F.col("chunk_index") + 1).cast("int")
    payload = rich_chunks(docs).select(
        _key(), "doc_id", "content", F.col("chunk_title").alias("title"), "act_name", "act_year",
        F.col("act_year").alias("year"), "chapter_number", "chapter_name", "section_number", "section_title",
        page.alias("page_number"), "source_file", "legal_domain", "document_type",
    )
    return join_measured(payload, candidates, "chunk_id", small)


_CORPUS = "SELECT doc_id * 1000 + chunk_index AS chunk_id, content AS text FROM chunks"
# Passage CTEs over all chunk metadata.
PASSAGES = [
    f"asks AS ({ASKS_SQL})",
    *RICH_CTES,
    *sp.bm25_ctes(_CORPUS, "SELECT query_id, text FROM asks", "ask"),
    f"candidates AS ({sp.bm25_top(4, 'ask')})",
    """passages AS (SELECT c.query_id, c.rank, c.score, r.*, r.chunk_title AS title, r.act_year AS year,
      CASE WHEN r.chunk_index % 2 = 1 THEN r.chunk_index + 1 END AS page_number
      FROM candidates c JOIN rich_chunks r ON c.chunk_id = r.doc_id * 1000 + r.chunk_index)""",
]
# Passage CTEs where only the text and section number matter.
LIGHT = [
    f"asks AS ({ASKS_SQL})",
    *sp.CHUNKS,
    *sp.bm25_ctes(_CORPUS, "SELECT query_id, text FROM asks", "ask"),
    f"candidates AS ({sp.bm25_top(4, 'ask')})",
    """passages AS (SELECT c.query_id, c.rank, c.score, r.content, r.section_number, r.doc_id, r.chunk_index
      FROM candidates c JOIN chunks r ON c.chunk_id = r.doc_id * 1000 + r.chunk_index)""",
]


def _light_passages(spark, sf):
    chunks = section_chunks(statutes(spark, sf).select("doc_id", "text")).select(
        _key(), "content", "section_number"
    )
    return shaping.attach_payload(_candidates(spark, sf), chunks)


@query(
    "result_rows",
    sp.with_ctes(
        PASSAGES,
        f"""SELECT query_id, doc_id * 1000 + chunk_index AS chunk_id, doc_id AS document_id, {sp.fixed('score', 6)} AS score, rank, 'bm25_sparse' AS retrieval_method,
  source_file AS source, title, legal_domain, year, 'India' AS jurisdiction, section_number, act_name FROM passages""",
    ),
)
def _result_rows(spark, sf):
    passages = _passages(spark, sf).withColumn("jurisdiction", F.lit(fv.JURISDICTION))
    rows = sinks.result_row(passages, ["section_number", "act_name"])
    return rows.withColumns({"score": tx.fixed(F.col("score"), 6), "rank": F.col("rank").cast("bigint")})


_HEADER = (
    "'--- [Passage ' || rank || '] ' || coalesce(nullif(act_name, ''), title, 'Untitled Document') || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END "
    "|| ' | Section ' || coalesce(section_number, 'N/A') || CASE WHEN page_number IS NOT NULL THEN ' | Page ' || page_number ELSE '' END || ' ---'"
)


@query(
    "context_assembly",
    sp.with_ctes(
        PASSAGES,
        f"""SELECT a.query_id, coalesce(c.context, {sp.lit(fv.NO_CONTEXT)}) AS context, coalesce(c.n, 0) AS n_passages FROM asks a LEFT JOIN (
  SELECT query_id, string_agg({_HEADER} || chr(10) || {sp.strip('content')}, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM passages GROUP BY 1) c USING (query_id)""",
    ),
)
def _context(spark, sf):
    return shaping.assemble_context(_asks(spark, sf), _passages(spark, sf))


@query(
    "citations",
    sp.with_ctes(
        PASSAGES,
        f"""SELECT query_id, rank, act_name, year, coalesce(section_number, 'General') AS section_number, coalesce(section_title, title) AS section_title,
  page_number::INTEGER AS page_number, regexp_extract(source_file, '[^/]+$') AS pdf_name,
  trim(act_name || CASE WHEN year IS NOT NULL THEN ', ' || year ELSE '' END || ', ' || CASE WHEN section_number IS NULL THEN '' ELSE 'Section ' || section_number END
    || CASE WHEN page_number IS NOT NULL THEN ', p. ' || page_number ELSE '' END, ', ') AS citation_text,
  {sp.strip('left(content, 250)')} || CASE WHEN length(content) > 250 THEN '...' ELSE '' END AS snippet, {sp.fixed('score', 6)} AS score FROM passages""",
    ),
)
def _citations(spark, sf):
    cited = shaping.citations(_passages(spark, sf))
    return cited.withColumns({"score": tx.fixed(F.col("score"), 6), "rank": F.col("rank").cast("bigint")})


_SNIP = f"{sp.strip('left(content, 300)')} || CASE WHEN length(content) > 300 THEN '...' ELSE '' END"
_TAIL = (
    "CASE WHEN chapter_number IS NOT NULL THEN ', Ch. ' || chapter_number ELSE '' END || CASE WHEN section_number IS NOT NULL THEN ', Sec. ' || section_number ELSE '' END "
    "|| CASE WHEN page_number IS NOT NULL THEN ', p. ' || page_number ELSE '' END"
)
_LINK = "'file:///' || source_file || CASE WHEN page_number IS NOT NULL THEN '#page=' || page_number ELSE '' END"


@query(
    "citation_details",
    sp.with_ctes(
        PASSAGES,
        f"""SELECT query_id, rank, act_name, act_year, chapter_number, chapter_name, coalesce(section_number, 'N/A') AS section_number,
  coalesce(section_title, title) AS section_title, page_number::INTEGER AS page_number, regexp_extract(source_file, '[^/]+$') AS pdf_name, source_file AS pdf_path,
  array_to_string(list_transform(regexp_extract_all({_SNIP}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
    lambda r: CASE WHEN list_contains(terms, lower(r)) THEN {sp.lit(fv.MARK_OPEN)} || r || {sp.lit(fv.MARK_CLOSE)} ELSE r END), '') AS highlighted_snippet,
  {_LINK} AS clickable_link, act_name || CASE WHEN act_year IS NOT NULL THEN ', ' || act_year ELSE '' END || {_TAIL} AS citation_string,
  {sp.fixed('score', 4)} AS relevance_score,
  '[' || act_name || CASE WHEN act_year IS NOT NULL THEN ' (' || act_year || ')' ELSE '' END || {_TAIL} || '](' || {_LINK} || ')' AS badge
FROM passages JOIN (SELECT query_id, list_filter({sp.words('lower(text)')}, lambda w: length(w) > 2) AS terms FROM asks) USING (query_id)""",
    ),
)
def _citation_details(spark, sf):
    passages = _passages(spark, sf).join(
        _asks(spark, sf).select("query_id", F.col("text").alias("question")), "query_id"
    )
    return shaping.citation_details(passages, F.col("question")).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "viewer_links",
    sp.with_ctes(
        LIGHT,
        """SELECT query_id, rank, '/app/static/pdf_viewer.html?file=acts+and+rules.pdf&section=' || coalesce(section_number, '1') || '&page=' || rank || '&act=Statutory+Act' AS link FROM passages""",
    ),
)
def _viewer_links(spark, sf):
    link = tx.viewer_link(
        F.lit("acts and rules.pdf"), F.col("section_number"), F.col("rank"), F.lit(None).cast("string"), F.lit(None).cast("string")
    )
    return _light_passages(spark, sf).select("query_id", F.col("rank").cast("bigint").alias("rank"), link.alias("link"))


_PENAL = " OR ".join(f"contains(lower(answer), {sp.lit(w)})" for w in fv.PENALTY_WORDS)
_REFERENCED = (
    f"list_sort(list_distinct(list_transform({sp.ext_all('answer', fv.ANSWER_SECTION, 0, 'i')}, "
    "lambda m: array_to_string(list_transform(regexp_extract_all(m, '\\p{L}+|[^\\p{L}]+'), lambda p: upper(left(p, 1)) || lower(substring(p, 2))), ''))))"
)
_PARSED = f"""parsed AS (SELECT a.query_id, {sp.strip('answer')} AS answer, coalesce(n, 0) AS n_citations, {_REFERENCED} AS refs, ({_PENAL}) AS has_penalty_clause,
  CASE WHEN regexp_matches(lower(answer), {sp.lit(fv.REFUSAL)}) THEN 0.2 WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence_score
  FROM asks a LEFT JOIN (SELECT query_id, count(*) AS n FROM candidates GROUP BY 1) USING (query_id))"""


@query(
    "answer_parse",
    sp.with_ctes([*LIGHT, _PARSED], "SELECT query_id, answer, n_citations, array_to_string(refs, '|') AS referenced_sections, has_penalty_clause, confidence_score FROM parsed"),
)
def _answer_parse(spark, sf):
    parsed = shaping.parse_answers(_asks(spark, sf).select("query_id", "answer"), _candidates(spark, sf))
    return parsed.withColumn("referenced_sections", F.array_join("referenced_sections", "|"))


_STATUS = [
    *LIGHT,
    _PARSED,
    f"""responses AS (SELECT query_id, query_id % 10 = 7 AS failed, n_citations = 0 AS none, * EXCLUDE (query_id) FROM parsed)""",
]


def _failures(spark, sf):
    return _asks(spark, sf).where("query_id % 10 = 7").select("query_id", F.lit("channels unavailable").alias("reason"))


@query(
    "response_status",
    sp.with_ctes(
        _STATUS,
        f"""SELECT query_id, CASE WHEN failed THEN 'retrieval_failed' WHEN none THEN 'no_documents_found' ELSE 'success' END AS retrieval_status,
  CASE WHEN failed THEN {sp.lit(fv.FAILED_ANSWER)} WHEN none THEN {sp.lit(fv.NO_DOCUMENTS_ANSWER)} ELSE answer END AS answer,
  CASE WHEN failed OR none THEN '' ELSE array_to_string(refs, '|') END AS referenced_sections, NOT (failed OR none) AND has_penalty_clause AS has_penalty_clause,
  CASE WHEN failed OR none THEN 0.0 ELSE confidence_score END::DOUBLE AS confidence_score, CASE WHEN failed OR none THEN 0 ELSE n_citations END AS n_citations,
  CASE WHEN failed THEN {sp.lit(fv.FAILED_TITLE)} END AS error_title, CASE WHEN failed THEN {sp.lit(fv.FAILED_MESSAGE)} END AS error_message,
  CASE WHEN failed THEN 'channels unavailable' END AS developer_details FROM responses""",
    ),
)
def _response_status(spark, sf):
    asks = _asks(spark, sf)
    found = shaping.respond(asks, _candidates(spark, sf), asks.select("query_id", "answer"), _failures(spark, sf))
    return found.withColumn("referenced_sections", F.array_join("referenced_sections", "|"))


# ------------------------------------------------------------ evaluation ----
_LABELS = "list_distinct(list_transform({0}, lambda s: lower(trim(s))))"
_HITS = f"len(list_intersect({_LABELS.format('retrieved')}, {_LABELS.format('expected')}))"
_GOOD_SENTENCES = (
    f"list_filter(sentences, lambda s: len(list_filter({sp.words('lower(s)')}, lambda w: length(w) > 3)) = 0 OR "
    f"len(list_filter({sp.words('lower(s)')}, lambda w: length(w) > 3 AND contains(joined, w))) / "
    f"len(list_filter({sp.words('lower(s)')}, lambda w: length(w) > 3)) >= 0.4)"
)
EVALUATED = [
    *_STATUS,
    """contexts AS (SELECT query_id, list(coalesce(section_number, 'General') ORDER BY rank) AS cited, list(content ORDER BY rank) AS context FROM passages GROUP BY 1)""",
    f"""answered AS (SELECT r.query_id, CASE WHEN none THEN {sp.lit(fv.NO_DOCUMENTS_ANSWER)} ELSE answer END AS answer,
      CASE WHEN none THEN [] ELSE refs END AS refs FROM responses r)""",
    """inputs AS (SELECT a.query_id, a.answer, coalesce(c.cited, []) AS cited, coalesce(c.context, []) AS context,
      CASE WHEN len(a.refs) > 0 THEN a.refs ELSE coalesce(c.cited, []) END AS retrieved,
      CASE WHEN s.expected = '' THEN [] ELSE string_split(s.expected, '|') END AS expected,
      lower(array_to_string(coalesce(c.context, []), ' ')) AS joined,
      list_filter(list_transform(regexp_split_to_array(a.answer, '[.!?]'), lambda x: """
    + sp.strip("x")
    + """), lambda x: length(x) > 10) AS sentences
      FROM answered a JOIN asks s USING (query_id) LEFT JOIN contexts c USING (query_id))""",
    f"""measured AS (SELECT *,
      CASE WHEN len(expected) = 0 THEN 1.0 WHEN len(retrieved) = 0 THEN 0.0 ELSE {_HITS} / len({_LABELS.format('expected')}) END AS rec,
      CASE WHEN len(retrieved) = 0 THEN 0.0 WHEN len(expected) = 0 THEN 1.0 ELSE {_HITS} / len({_LABELS.format('retrieved')}) END AS prec,
      CASE WHEN {sp.strip('answer')} = '' OR len(context) = 0 THEN 0.0 WHEN len(sentences) = 0 THEN 1.0 ELSE len({_GOOD_SENTENCES}) / len(sentences) END AS faith,
      CASE WHEN len(cited) = 0 OR len(context) = 0 THEN 0.0 ELSE len(list_filter(cited, lambda c: contains(joined, lower(c)) OR lower(c) = 'general')) / len(cited) END AS acc
      FROM inputs)""",
    f"""grounded AS (SELECT *, CASE WHEN regexp_matches(lower(answer), {sp.lit(fv.REFUSAL)}) THEN 1.0 WHEN len(cited) = 0 OR len(context) = 0 THEN 0.0
      ELSE {sp.fixed('0.7 * faith + 0.3 * least(len(cited) / len(context), 1.0)', 4)} END AS g FROM measured)""",
    f"""results AS (SELECT query_id AS sample_id, array_to_string(retrieved, '|') AS retrieved, {sp.fixed('rec', 4)} AS retrieval_recall, {sp.fixed('prec', 4)} AS retrieval_precision,
      {sp.fixed('faith', 4)} AS faithfulness, {sp.fixed('g', 4)} AS groundedness, {sp.fixed('greatest(1.0 - g, 0.0)', 4)} AS hallucination_rate,
      {sp.fixed('acc', 4)} AS citation_accuracy, len(cited)::BIGINT AS citations_count FROM grounded)""",
]


def _evaluated(spark, sf):
    asks = _asks(spark, sf)
    passages = _light_passages(spark, sf)
    expected = F.filter(F.split("expected", r"\|"), lambda s: s != "")
    samples = asks.select(F.col("query_id").alias("sample_id"), "query_id", expected.alias("expected_sections"))
    responses = shaping.respond(asks, passages, asks.select("query_id", "answer"))
    return evaluation.evaluate(samples, responses, passages)


@query("evaluation_samples", sp.with_ctes(EVALUATED, "SELECT * FROM results"))
def _evaluation_samples(spark, sf):
    found = _evaluated(spark, sf).drop("query_id", "latency_seconds")
    return found.withColumns(
        {"retrieved": F.array_join("retrieved", "|"), "citations_count": F.col("citations_count").cast("bigint")}
    )


_MEAN = lambda c: f"coalesce({sp.fixed(f'avg({c})', 4)}, 0.0)"
_REPORT = f"""report AS (SELECT count(*) AS total_samples, {_MEAN('retrieval_recall')} AS mean_recall, {_MEAN('retrieval_precision')} AS mean_precision,
  {_MEAN('faithfulness')} AS mean_faithfulness, {_MEAN('groundedness')} AS mean_groundedness, {_MEAN('hallucination_rate')} AS mean_hallucination_rate,
  {_MEAN('citation_accuracy')} AS mean_citation_accuracy, 0.0::DOUBLE AS mean_latency_seconds, count(*) FILTER (groundedness >= 0.8) AS passed_samples,
  count(*) FILTER (groundedness < 0.8) AS failed_samples FROM results)"""


@query("evaluation_report", sp.with_ctes([*EVALUATED, _REPORT], "SELECT * FROM report"))
def _evaluation_report(spark, sf):
    return evaluation.report(_evaluated(spark, sf))


@query(
    "evaluation_report_rows",
    sp.with_ctes(
        [*EVALUATED, _REPORT],
        " UNION ALL ".join(
            f"SELECT {i} AS position, {sp.lit(label)} AS metric, {column} AS value, '{op} {limit:.2f}' AS target, CASE WHEN {column} {op} {limit} THEN 'PASS' ELSE '{missed}' END AS status FROM report"
            for i, (label, column, op, limit, missed) in enumerate(fv.REPORT_TARGETS, start=1)
        ),
    ),
)
def _evaluation_report_rows(spark, sf):
    return evaluation.report_rows(evaluation.report(_evaluated(spark, sf)))


# --------------------------------------------------------- conversations ----
@query(
    "history_frame",
    "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_prior, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS has_history FROM conversations",
)
def _history_frame(spark, sf):
    return sessions.history_frame(table(spark, sf, "conversations")).select(
        "conv_id", "turn", "role", "n_prior", "has_history"
    )


@query(
    "history_messages",
    """SELECT c.conv_id, ask_turn, turn, role, text FROM conversations c
JOIN (SELECT conv_id, max(turn) AS ask_turn FROM conversations WHERE role = 'user' GROUP BY 1) a ON c.conv_id = a.conv_id AND turn < ask_turn""",
)
def _history_messages(spark, sf):
    messages = table(spark, sf, "conversations")
    return sessions.history_messages(messages, sessions.latest_questions(messages))


@query(
    "history_messages_all",
    """SELECT c.conv_id, ask_turn, turn, role, text FROM conversations c
JOIN (SELECT DISTINCT conv_id, turn AS ask_turn FROM conversations WHERE role = 'user') a ON c.conv_id = a.conv_id AND turn < ask_turn""",
)
def _history_messages_all(spark, sf):
    messages = table(spark, sf, "conversations")
    return sessions.history_messages(messages, sessions.all_questions(messages))


@query(
    "conversation_list",
    "SELECT conv_id, left(arg_min(text, turn) FILTER (role = 'user'), 45) AS title, count(*) AS n_messages FROM conversations GROUP BY 1",
)
def _conversation_list(spark, sf):
    return sessions.conversation_list(table(spark, sf, "conversations"))


@query(
    "recent_conversations",
    "SELECT conv_id, left(arg_min(text, turn) FILTER (role = 'user'), 45) AS title, count(*) AS n_messages FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 12",
)
def _recent_conversations(spark, sf):
    return sessions.recent_conversations(table(spark, sf, "conversations"))


@query(
    "chat_export",
    """SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER w THEN '[' ELSE '' END || to_json({'role': role, 'content': text})::VARCHAR
  || CASE WHEN turn = max(turn) OVER w THEN ']' ELSE ',' END AS line FROM conversations WINDOW w AS (PARTITION BY conv_id)""",
)
def _chat_export(spark, sf):
    return sessions.export_chat(table(spark, sf, "conversations"))


@query(
    "session_append_clear",
    """WITH cleared AS (SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')),
fresh AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, 'again: ' || text AS text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, role, text FROM cleared UNION ALL
SELECT f.conv_id, coalesce(m.nxt, 0) + i, f.role, f.text FROM fresh f LEFT JOIN (SELECT conv_id, max(turn) + 1 AS nxt FROM cleared GROUP BY 1) m USING (conv_id)""",
)
def _session_append_clear(spark, sf):
    """Sessions with a system message are cleared, then every user message is sent again."""
    messages = table(spark, sf, "conversations")
    cleared = sessions.clear_sessions(messages, messages.where("role = 'system'"))
    again = messages.where("role = 'user'").withColumn(
        "text", F.concat(F.lit("again: "), "text")
    )
    return sessions.append_messages(cleared, again)
