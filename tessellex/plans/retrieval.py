"""Queries over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators import bm25, bm25_tiers, dense, embedding, filters, fusion, hybrid, mmr, rerank, vector_index
from tessellex.operators.sizing import pick_rows
from tessellex.plans import sqlparts as sp
from tessellex.plans.registry import query
from tessellex.plans.tables import centroids, corpus, search_queries, table, vectors
from tessellex.sources.scratch import scratch_path

DOCS = "SELECT doc_id AS chunk_id, text FROM documents"
ASKED = "SELECT item_id AS query_id, text FROM benchmark"
BM25 = sp.bm25_ctes(DOCS, ASKED)


def _shown(df):
    """Candidates as compared: rounded score, integer rank."""
    return df.select(
        "query_id",
        "chunk_id",
        tx.fixed(F.col("score"), 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def _sql_shown(source: str) -> str:
    return f"SELECT query_id, chunk_id, {sp.fixed('score')} AS score, rank FROM ({source})"


# ------------------------------------------------------------------ text ----
@query(
    "stem",
    f"SELECT w AS word, {sp.stem('w')} AS stem, count(*) AS n FROM "
    f"(SELECT unnest({sp.words('lower(text)')}) AS w FROM documents) GROUP BY ALL",
)
def _stem(spark, sf):
    words = corpus(spark, sf).select(F.explode(tx.words(F.lower("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", tx.stem(F.col("word")))


@query(
    "tokenize",
    f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT doc_id, flatten(list_transform(list_filter({sp.words('lower(text)')}, lambda w: length(w) > 1),
    lambda w: CASE WHEN {sp.stem('w')} <> w THEN [w, {sp.stem('w')}] ELSE [w] END)) AS t FROM documents)""",
)
def _tokenize(spark, sf):
    tokens = corpus(spark, sf).select("doc_id", tx.search_tokens(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@query(
    "word_count_hash",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]+'),
  lambda w: w <> ''))::BIGINT AS word_count, sha256(text) AS content_hash FROM documents""",
)
def _word_count(spark, sf):
    return corpus(spark, sf).select(
        "doc_id",
        tx.word_count(F.col("text")).cast("bigint").alias("word_count"),
        tx.content_hash(F.col("text")).alias("content_hash"),
    )


# ------------------------------------------------------------------ BM25 ----
@query("corpus_stats", sp.with_ctes(BM25, f"SELECT n, {sp.fixed('avgdl')} AS avgdl FROM bm25_stats"))
def _corpus_stats(spark, sf):
    stats = bm25.corpus_stats(bm25.term_frequencies(corpus(spark, sf)))
    return stats.select("n", tx.fixed(F.col("avgdl"), 6).alias("avgdl"))


@query("term_frequencies", sp.with_ctes(BM25, "SELECT chunk_id, term, tf FROM bm25_tf"))
def _term_frequencies(spark, sf):
    return (
        bm25.term_frequencies(corpus(spark, sf))
        .where(F.col("term") != bm25.DOC_MARK)
        .select("chunk_id", "term", "tf")
    )


@query("term_stats", sp.with_ctes(BM25, f"SELECT term, df, {sp.fixed('idf')} AS idf FROM bm25_idf"))
def _term_stats(spark, sf):
    postings = bm25.term_frequencies(corpus(spark, sf))
    stats = bm25.term_stats(postings, bm25.corpus_stats(postings))
    return stats.withColumn("idf", tx.fixed(F.col("idf"), 6))


@query("bm25_topk", sp.with_ctes(BM25, _sql_shown(sp.bm25_top(5))))
def bm25_topk(spark, sf):
    return _shown(bm25.search_corpus(corpus(spark, sf), search_queries(spark, sf), 5))


@query(
    "bm25_filtered",
    sp.with_ctes(
        [*BM25, "flagged AS (SELECT b.* FROM bm25 b JOIN documents d ON b.chunk_id = d.doc_id AND lower(d.lang) IN ('fr', 'de'))"],
        _sql_shown(sp.bm25_top(5, "flagged")),
    ),
)
def _bm25_filtered(spark, sf):
    where = filters.match_text({"lang": ["FR", "de"]})
    return _shown(bm25.search_corpus(corpus(spark, sf), search_queries(spark, sf), 5, where))


@query(
    "bm25_index_search",
    sp.with_ctes(
        [*BM25, "good AS (SELECT b.* FROM bm25 b JOIN labels l ON b.chunk_id = l.doc_id WHERE l.quality = 1)"],
        _sql_shown(sp.bm25_top(5, "good")),
    ),
)
def _bm25_index(spark, sf):
    """Write the index to the shared folder, search it with a filter on another table."""
    index = bm25.write_index(corpus(spark, sf), scratch_path(spark, "bm25"))
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return _shown(bm25.search_index(index, search_queries(spark, sf), 5, allowed=good))


def _tiers(spark, sf):
    return bm25_tiers.write_index(corpus(spark, sf), scratch_path(spark, "tiers"))


@query("bm25_pruned_search", sp.with_ctes(BM25, _sql_shown(sp.bm25_top(5))))
def _bm25_pruned(spark, sf):
    """The same top-k from the impact-ordered index, read as far as it can matter."""
    return _shown(bm25_tiers.search(_tiers(spark, sf), search_queries(spark, sf), 5))


@query(
    "bm25_pruned_filtered",
    sp.with_ctes(
        [*BM25, "good AS (SELECT b.* FROM bm25 b JOIN labels l ON b.chunk_id = l.doc_id WHERE l.quality = 1)"],
        _sql_shown(sp.bm25_top(5, "good")),
    ),
)
def _bm25_pruned_filtered(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return _shown(bm25_tiers.search(_tiers(spark, sf), search_queries(spark, sf), 5, allowed=good))


@query("bm25_pruned_reading")
def _bm25_pruned_reading(spark, sf):
    """How many postings the pruned search reads of how many, by query."""
    return bm25_tiers.reading(_tiers(spark, sf), search_queries(spark, sf), 5)


# ----------------------------------------------------------------- dense ----
CENTROIDS = [
    """cells AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    """centroids AS (SELECT label::BIGINT AS query_id, list(v ORDER BY pos) AS q FROM
      (SELECT label, pos, avg(v) AS v FROM cells GROUP BY ALL) GROUP BY 1)""",
    """vectors AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label FROM embeddings)""",
]
_METRIC = {
    "cosine": ("list_cosine_similarity(q, e)", "DESC"),
    "dot": ("list_inner_product(q, e)", "DESC"),
    "euclid": ("list_distance(q, e)", "ASC"),
}


def _dense_sql(metric: str, k: int, where: str = "true", score_where: str = "true") -> str:
    expr, way = _METRIC[metric]
    return (
        f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {sp.fixed('score', 9)} {way}, chunk_id) AS rank "
        f"FROM (SELECT query_id, chunk_id, {expr} AS score FROM centroids, vectors WHERE {where}) WHERE {score_where} QUALIFY rank <= {k}"
    )


def _dense_query(name: str, metric: str, sql_where="true", score_where="true", **options):
    @query(name, sp.with_ctes(CENTROIDS, _sql_shown(_dense_sql(metric, 5, sql_where, score_where))))
    def run(spark, sf):
        made = {k: v() if callable(v) else v for k, v in options.items()}
        return _shown(dense.dense_search(vectors(spark, sf), centroids(spark, sf), 5, metric, **made))


_dense_query("dense_cosine_topk", "cosine")
_dense_query("dense_dot_topk", "dot")
_dense_query("dense_euclid_topk", "euclid")
_dense_query(
    "dense_filtered",
    "cosine",
    "label IN (1, 3, 5) AND chunk_id >= 20",
    where=lambda: filters.compile_filter({"label": [1, 3, 5], "chunk_id": {"gte": 20}}),
)
_dense_query("dense_threshold", "cosine", score_where="score >= 0.35", threshold=0.35)


_SELF = [
    "centroids AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)",
    "vectors AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label FROM embeddings)",
]
#: Bytes of a block in the registered joins: small, so that the given tables have many blocks.
_PAIR_BYTES = 64 * 1024


def _sample_queries(spark, sf):
    """Every vector whose id is divisible by 50, as a query."""
    return vectors(spark, sf).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def _index(spark, sf, lists):
    return vector_index.write_index(vectors(spark, sf), scratch_path(spark, "vectors"), lists)


def _block_query(name: str, metric: str):
    @query(name, sp.with_ctes(_SELF, _sql_shown(_dense_sql(metric, 10))))
    def run(spark, sf):
        one = F.lit(0)
        pairs = vector_index.block_join(
            vectors(spark, sf).withColumn("list", one), _sample_queries(spark, sf).withColumn("list", one), 10, metric, _PAIR_BYTES
        )
        return _shown(dense.ranked(pairs, 10, metric))


_block_query("dense_block_join", "cosine")
_block_query("dense_block_join_euclid", "euclid")
_dense_query("dense_euclid_threshold", "euclid", score_where="score <= 1.15", threshold=1.15)


@query("dense_index_all_lists", sp.with_ctes(_SELF, _sql_shown(_dense_sql("cosine", 10))))
def _dense_index_all(spark, sf):
    """The stored index with all lists probed: exact."""
    index = _index(spark, sf, 16)
    return _shown(vector_index.search_index(index, _sample_queries(spark, sf), 10, probes=16, limit=_PAIR_BYTES))


@query("dense_index_recall")
def _dense_index_recall(spark, sf):
    """Recall of the index against the exact result, by query, with the probes that other queries needed; tests hold its mean to 0.9."""
    index = _index(spark, sf, 32)
    others = vectors(spark, sf).where("chunk_id % 50 = 25").select(F.col("chunk_id").alias("query_id"), "embedding")
    probes = vector_index.probes_for(index, others, 10, target=0.95)
    exact = dense.dense_search(vectors(spark, sf), _sample_queries(spark, sf), 10)
    found = vector_index.search_index(index, _sample_queries(spark, sf), 10, probes)
    return vector_index.recall(found, exact).withColumns({"probes": F.lit(probes), "lists": F.lit(32)})


# ---------------------------------------------------------------- fusion ----
def _channels(spark, sf, k):
    """Sparse channel for every benchmark query, dense for those that share a label id."""
    sparse = bm25.search_corpus(corpus(spark, sf), search_queries(spark, sf), k)
    near = dense.dense_search(vectors(spark, sf), centroids(spark, sf), k)
    return near, sparse


def _channel_ctes(k: int) -> list[str]:
    return [
        *BM25,
        *CENTROIDS,
        f"sparse AS ({sp.bm25_top(k)})",
        f"dense AS ({_dense_sql('cosine', k)})",
    ]


def _rrf_sql(k: int) -> str:
    return f"""SELECT query_id, chunk_id, {sp.fixed('raw', 6)} AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY {sp.fixed('raw', 12)} DESC, list_no, first_rank) AS rank
FROM (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS raw, min(list_no) AS list_no, arg_min(rank, list_no) AS first_rank
      FROM (SELECT query_id, chunk_id, rank, 0 AS list_no FROM dense UNION ALL
            SELECT query_id, chunk_id, rank, 1 FROM sparse) GROUP BY ALL) QUALIFY rank <= {k}"""


def _weighted_sql(k: int) -> str:
    return f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id,
             {sp.fixed('0.5 * coalesce(d.score, 0.0) + 0.5 * coalesce(s.score, 0.0)', 4)} AS score
      FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id) QUALIFY rank <= {k}"""


@query("rrf_fusion", sp.with_ctes(_channel_ctes(15), _sql_shown(_rrf_sql(15))))
def _rrf(spark, sf):
    return _shown(fusion.reciprocal_rank_fusion(list(_channels(spark, sf, 15)), 15))


@query("weighted_fusion", sp.with_ctes(_channel_ctes(15), _sql_shown(_weighted_sql(15))))
def _weighted(spark, sf):
    return _shown(fusion.weighted_fusion(*_channels(spark, sf, 15), 15))


@query(
    "candidate_hybrid",
    sp.with_ctes(
        [*CENTROIDS, f"dense AS ({_dense_sql('cosine', 10)})"],
        _sql_shown(
            f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, {sp.fixed("0.5 * score + 0.5 * least(len(list_filter(terms, lambda t: contains(passage, t))) / greatest(len(terms), 1), 1.0)", 4)} AS score
  FROM dense JOIN (SELECT item_id AS query_id, list_filter({sp.words('lower(text)')}, lambda w: length(w) > 2) AS terms FROM benchmark) USING (query_id)
  JOIN (SELECT doc_id AS chunk_id, lower(text) AS passage FROM documents) USING (chunk_id)) QUALIFY rank <= 5"""
        ),
    ),
)
def _candidate_hybrid(spark, sf):
    near = dense.dense_search(vectors(spark, sf), centroids(spark, sf), 10)
    return _shown(dense.text_blend(near, corpus(spark, sf), search_queries(spark, sf), 5))


# ------------------------------------------------------------------- MMR ----
def _mmr_ctes(source: str) -> list[str]:
    """Three MMR picks from ``source(query_id, chunk_id, score, rank)``, unrolled."""
    jac = "len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))"
    safe = f"CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0 ELSE {jac} END"
    return [
        f"""cand AS (SELECT s.*, list_distinct({sp.words("lower(coalesce(text, ''))")}) AS toks, count(*) OVER (PARTITION BY query_id) AS n
  FROM ({source}) s LEFT JOIN documents d ON s.chunk_id = d.doc_id)""",
        "pick1 AS (SELECT * FROM cand WHERE rank = 1)",
        f"""rest2 AS (SELECT a.*, {safe} AS sim FROM cand a JOIN pick1 b USING (query_id) WHERE a.rank > 1)""",
        f"""pick2 AS (SELECT * FROM rest2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {sp.fixed('0.5 * score - 0.5 * sim', 12)} DESC, rank) = 1)""",
        f"""rest3 AS (SELECT a.* REPLACE (greatest(a.sim, {safe}) AS sim) FROM rest2 a JOIN pick2 b USING (query_id) WHERE a.rank <> b.rank)""",
        f"""pick3 AS (SELECT * FROM rest3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {sp.fixed('0.5 * score - 0.5 * sim', 12)} DESC, rank) = 1)""",
        """mmr AS (
  SELECT query_id, chunk_id, score, rank FROM cand WHERE n <= 3
  UNION ALL SELECT query_id, chunk_id, score, 1 FROM pick1 WHERE n > 3
  UNION ALL SELECT query_id, chunk_id, score, 2 FROM pick2 WHERE n > 3
  UNION ALL SELECT query_id, chunk_id, score, 3 FROM pick3 WHERE n > 3)""",
    ]


@query("mmr", sp.with_ctes([*_channel_ctes(9), *_mmr_ctes(_weighted_sql(9))], _sql_shown("SELECT * FROM mmr")))
def _mmr(spark, sf):
    fused = fusion.weighted_fusion(*_channels(spark, sf, 9), 9)
    return _shown(mmr.mmr_bounded(fused, corpus(spark, sf), 3))


@query("hybrid_search", sp.with_ctes([*_channel_ctes(9), *_mmr_ctes(_rrf_sql(9))], _sql_shown("SELECT * FROM mmr")))
def hybrid_search(spark, sf):
    near, sparse = _channels(spark, sf, hybrid.fetch_size(3))
    return _shown(hybrid.hybrid(corpus(spark, sf), near, sparse, k=3))


@query(
    "channel_fallback",
    sp.with_ctes([*BM25, f"top AS ({sp.bm25_top(15)})"], _sql_shown(f"SELECT query_id, chunk_id, {sp.fixed('1.0 / (60 + rank)', 6)} AS score, rank FROM top WHERE rank <= 5")),
)
def _channel_fallback(spark, sf):
    """The dense channel fails to plan (no such metric); the sparse one answers alone."""
    channels, errors = hybrid.run_channels(
        dense=lambda: dense.dense_search(vectors(spark, sf), centroids(spark, sf), 15, "none"),
        sparse=lambda: bm25.search_corpus(corpus(spark, sf), search_queries(spark, sf), 15),
    )
    assert "dense" in errors
    found = hybrid.hybrid(
        corpus(spark, sf), channels.get("dense"), channels.get("sparse"), k=5, use_mmr=False
    )
    return _shown(found)


#: Characters that the model of ``question_answering`` takes, and the least product of a dense result.
_WINDOW, _LEAST = 300, 0.2
#: Every benchmark text, the same without blanks (one unknown word) and a blank question.
_QUESTIONS = """SELECT item_id * 4 AS query_id, text FROM benchmark UNION ALL
  SELECT item_id * 4 + 1, replace(text, ' ', 'x') FROM benchmark UNION ALL SELECT item_id * 4 + 2, '  ' FROM benchmark"""


def _slots_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM (
  SELECT {key}, (('0x' || left(md5(w), 8))::BIGINT % 64) AS slot, count(*) AS n FROM (
    SELECT {key}, unnest({sp.words('lower(text)')}) AS w FROM ({source})) GROUP BY ALL)"""


@query(
    "question_answering",
    sp.with_ctes(
        [
            f"questions AS ({_QUESTIONS})",
            *sp.bm25_ctes(DOCS, "SELECT query_id, text FROM questions WHERE trim(text) <> ''"),
            f"sparse AS ({sp.bm25_top(15)})",
            f"doc_slots AS ({_slots_sql(DOCS, 'chunk_id')})",
            f"asked_slots AS ({_slots_sql(f'SELECT * FROM questions WHERE length(text) <= {_WINDOW}', 'query_id')})",
            "cosines AS (SELECT query_id, chunk_id, sum(d.v * q.v) AS score FROM doc_slots d JOIN asked_slots q USING (slot) GROUP BY ALL)",
            f"""dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {sp.fixed('score', 12)} DESC, chunk_id) AS rank
  FROM cosines WHERE score >= {_LEAST} QUALIFY rank <= 15)""",
            f"fused AS ({_rrf_sql(5)})",
            f"""outcomes AS (SELECT query_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN d AND s THEN 'both' WHEN d THEN 'dense_only' WHEN s THEN 'sparse_only'
  WHEN length(text) > {_WINDOW} THEN 'failed' ELSE 'empty' END AS status,
  CASE WHEN trim(text) <> '' AND length(text) > {_WINDOW} THEN 'ValueError: ' || length(text) || ' characters, {_WINDOW} allowed' END AS dense_error
  FROM (SELECT *, query_id IN (SELECT query_id FROM dense) AS d, query_id IN (SELECT query_id FROM sparse) AS s FROM questions))""",
        ],
        "SELECT query_id, status, dense_error, chunk_id, score, rank FROM outcomes LEFT JOIN fused USING (query_id)",
    ),
)
def _question_answering(spark, sf):
    """Texts and questions meet under one embedding model, which fails on some questions while the job runs."""
    items = table(spark, sf, "benchmark")
    number = F.col("item_id") * 4
    questions = (
        items.select(number.alias("query_id"), "text")
        .unionByName(items.select((number + 1).alias("query_id"), F.replace("text", F.lit(" "), F.lit("x")).alias("text")))
        .unionByName(items.select((number + 2).alias("query_id"), F.lit("  ").alias("text")))
    )
    model = embedding.hashing_embedder(64)
    chunks = corpus(spark, sf).select("chunk_id", "text")
    embedded = embedding.embed(chunks, model).select("chunk_id", "embedding")
    found, outcomes = hybrid.ask(chunks, embedded, questions, embedding.limited(model, _WINDOW), k=5, threshold=_LEAST, metric="dot")  # the model's vectors have unit length
    return outcomes.join(_shown(found), "query_id", "left")


# ---------------------------------------------------------------- rerank ----
@query(
    "rerank_pass_through",
    sp.with_ctes(
        _channel_ctes(9),
        _sql_shown(
            f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS rank "
            f"FROM ({_rrf_sql(9)}) QUALIFY rank <= 3"
        ),
    ),
)
def _pass_through(spark, sf):
    fused = fusion.reciprocal_rank_fusion(list(_channels(spark, sf, 9)), 9)
    return _shown(rerank.pass_through(fused, 3))


def _overlap_sql(source: str, n: int) -> str:
    wanted, have = f"list_distinct({sp.words('lower(b.text)')})", f"list_distinct({sp.words('lower(d.text)')})"
    return f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, {sp.fixed(f'len(list_intersect({wanted}, {have})) / greatest(len({wanted}), 1)', 4)} AS score
  FROM ({source}) s JOIN benchmark b ON s.query_id = b.item_id JOIN documents d ON s.chunk_id = d.doc_id) QUALIFY rank <= {n}"""


@query("rerank_scored", sp.with_ctes(_channel_ctes(9), _sql_shown(_overlap_sql(_rrf_sql(9), 5))))
def _rerank_scored(spark, sf):
    fused = fusion.reciprocal_rank_fusion(list(_channels(spark, sf, 9)), 9)
    found = rerank.rerank(fused, search_queries(spark, sf), corpus(spark, sf), rerank.word_overlap, 5)
    return _shown(found)


@query(
    "two_stage_search",
    sp.with_ctes(_channel_ctes(27), _sql_shown(_overlap_sql(f"SELECT * FROM ({_weighted_sql(27)}) WHERE rank <= 9", 3))),
)
def _two_stage(spark, sf):
    near, sparse = _channels(spark, sf, hybrid.fetch_size(3, stages=2))
    found = hybrid.two_stage(
        corpus(spark, sf), search_queries(spark, sf), near, sparse, n=3,
        scorer=rerank.word_overlap, fusion="weighted", use_mmr=False,
    )
    return _shown(found)


@query(
    "result_similarity",
    sp.with_ctes(
        [*BM25, f"top AS ({sp.bm25_top(3)})",
         f"""pair AS (SELECT query_id, chunk_id, list_distinct({sp.words('lower(b.text)')}) AS x, list_distinct({sp.words('lower(d.text)')}) AS y
           FROM top JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id)"""],
        f"SELECT query_id, chunk_id, {sp.fixed('len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))')} AS similarity FROM pair",
    ),
)
def _similarity(spark, sf):
    docs, asked = corpus(spark, sf), search_queries(spark, sf)
    top = bm25.search_corpus(docs, asked, 3).select("query_id", "chunk_id")
    questions = asked.select("query_id", tx.token_set(F.col("text")).alias("x"))
    pair = (
        pick_rows(docs.select("chunk_id", "text"), top)
        .withColumn("y", tx.token_set(F.col("text")))
        .join(questions, "query_id")
    )
    return pair.select(
        "query_id", "chunk_id", tx.fixed(tx.jaccard(F.col("x"), F.col("y")), 6).alias("similarity")
    )


_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_SNIPPET = f"{sp.strip('left(d.text, 300)')} || CASE WHEN length(d.text) > 300 THEN '...' ELSE '' END"


@query(
    "snippet_highlight",
    sp.with_ctes(
        [*BM25, f"top AS ({sp.bm25_top(3)})"],
        f"""SELECT query_id, chunk_id, coalesce(array_to_string(list_transform(regexp_extract_all({_SNIPPET}, '{_RUNS}'),
  lambda r: CASE WHEN list_contains(terms, lower(r)) THEN {sp.lit(fv.MARK_OPEN)} || r || {sp.lit(fv.MARK_CLOSE)} ELSE r END), ''), '') AS snippet
FROM top JOIN (SELECT item_id AS query_id, list_filter({sp.words('lower(text)')}, lambda w: length(w) > 2) AS terms FROM benchmark) USING (query_id)
JOIN documents d ON chunk_id = doc_id""",
    ),
)
def _snippet_highlight(spark, sf):
    docs, asked = corpus(spark, sf), search_queries(spark, sf)
    top = bm25.search_corpus(docs, asked, 3).select("query_id", "chunk_id")
    joined = pick_rows(docs.select("chunk_id", "text"), top).join(
        asked.withColumnRenamed("text", "question"), "query_id"
    )
    snippet = tx.highlight(tx.snippet(F.col("text"), 300), F.col("question"))
    return joined.select("query_id", "chunk_id", snippet.alias("snippet"))


# --------------------------------------------------------------- filters ----
@query(
    "filter_compiler",
    "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND n_chars < 5000",
)
def _filter_compiler(spark, sf):
    where = filters.compile_filter({"lang": ["en", "fr"], "meta_n_chars": {"gte": 500, "lt": 5000}})
    return table(spark, sf, "documents").where(where).select("doc_id", "lang", "n_chars")


@query(
    "filter_conditions",
    "SELECT doc_id, quality, toxic FROM labels WHERE quality <> 0 AND toxic = 0 AND doc_id <= 100000",
)
def _filter_conditions(spark, sf):
    where = filters.compile_conditions([("quality", "ne", 0), ("toxic", "eq", 0), ("doc_id", "lte", 100000)])
    return table(spark, sf, "labels").where(where).select("doc_id", "quality", "toxic")


# ------------------------------------------------------------- embedding ----
@query(
    "hashed_embedding",
    f"""WITH slots AS (
  SELECT doc_id, (('0x' || left(md5(w), 8))::BIGINT % 64) AS slot, count(*) AS n FROM (
    SELECT doc_id, unnest({sp.words('lower(text)')}) AS w FROM documents) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM slots GROUP BY 1)
SELECT doc_id, slot, {sp.fixed('n / norm', 4)} AS value FROM slots JOIN norms USING (doc_id)""",
)
def _hashed_embedding(spark, sf):
    embedded = embedding.embed(corpus(spark, sf).select("doc_id", "text"), embedding.hashing_embedder(64))
    cells = embedded.select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return cells.where("value > 0").select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), tx.fixed(F.col("value").cast("double"), 4).alias("value")
    )
