"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.llm import (
    automaton, bpe, conversation, exact_dedup, html_text, jaccard_join, language, lexical, mixing, substrings, suffix_tree, toxicity,
    vector_dedup,
)
from tessellex.llm.common import fold
from tessellex.plans.registry import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@_query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), use=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


@_query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query(
    "op9_poisson_mix",
    f"""
    WITH sizes AS (SELECT coalesce(source, '{mixing.NULL_SOURCE}') AS s, count(*) AS n FROM documents GROUP BY 1),
    shares AS (SELECT s, n, pow(n, {mixing.ALPHA}) AS w, sum(pow(n, {mixing.ALPHA})) OVER () AS ws, sum(n) OVER () AS ns FROM sizes),
    rates AS (SELECT s, w / ws * ns / n AS rate, greatest(ceil(w / ws * ns / n / {mixing.STEP}), 1)::INT AS steps FROM shares),
    terms AS (SELECT s, k, exp(-rate / steps + k * ln(rate / steps) - lgamma(k + 1)) AS p
              FROM rates, generate_series(0, {mixing.TAIL}) AS g(k)),
    cums AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cum FROM terms),
    draws AS (SELECT doc_id, coalesce(source, '{mixing.NULL_SOURCE}') AS s, i,
                     ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u
              FROM documents JOIN rates ON rates.s = coalesce(source, '{mixing.NULL_SOURCE}'),
                   LATERAL (SELECT unnest(generate_series(1, steps)) AS i)),
    counts AS (SELECT doc_id, draws.s, count(cum) AS n_copies FROM draws LEFT JOIN cums ON cums.s = draws.s AND cum <= u GROUP BY 1, 2),
    copies AS (SELECT doc_id, s, n_copies::INT AS n_copies, unnest(generate_series(1, n_copies))::INT AS copy_no FROM counts)
    SELECT d.doc_id, d.source, d.lang, sha256(coalesce(d.text, '')) AS text_sha256, copy_no, n_copies,
           md5('{mixing.SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || copy_no) AS order_key
    FROM copies JOIN documents d USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mix in its global order; sources weigh as the square root of their size."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), details=True)
    return mixed.select(
        "row.doc_id", "row.source", "row.lang", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"),
        "copy_no", "n_copies", "order_key",
    )


@_query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when windows of 50 words that an earlier one holds go."""
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op4_vector_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors with equal label at a cosine of 0.93 or more, and their components."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op5_language_crf")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.train(docs, use=~held_out)
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "switches")


@_query("op7_suffix_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under a suffix tree learned from six sevenths of them."""
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = suffix_tree.score(_table(spark, sf_dir, "documents"), learn=~held_out)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.9 of their three-word shingles."""
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"), k=3, percent=90)


@_query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return conversation.summarise(conversation.damage(_table(spark, sf_dir, "conversations")))


@_query(
    "op12_lexical_search",
    r"""
    WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
    totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM lengths),
    ms AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // nt) AS m FROM lengths, totals),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weights AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, nd),
    scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
               FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN ms USING (doc_id) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


@_query("op13_word_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every text, as digests."""
    rules = automaton.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    coded = automaton.decode(automaton.encode(_table(spark, sf_dir, "documents"), rules), rules)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
