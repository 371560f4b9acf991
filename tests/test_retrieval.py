"""Retrieval operators against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellex.operators import bm25, dense, filters, fusion, hybrid, mmr
from tessellex.plans.registry import QUERIES  # noqa: F401
from tessellex.sources.scratch import scratch_path

DOCS = {
    1: "the visa rules of the port", 2: "visa visas and passports", 3: "fine for entering", 4: "", 5: "visa visas and passports",
}
ASKED = {10: "visas visas port", 11: "entered", 12: "  ", 13: "unknownword"}


def stem(t):
    if len(t) <= 3:
        return t
    for suffix, low, cut, add in (("ies", 0, 3, "y"), ("es", 4, 2, ""), ("s", 3, 1, ""), ("ing", 5, 3, ""), ("ed", 4, 2, "")):
        if t.endswith(suffix) and len(t) > low and not (suffix == "s" and t.endswith("ss")):
            return t[:-cut] + add
    return t


def tokens(text):
    out = []
    for t in re.findall(r"\w+", text.lower()):
        if len(t) > 1:
            out += [t] if stem(t) == t else [t, stem(t)]
    return out


def brute_bm25(docs, query, k1=1.5, b=0.75):
    toks = {d: tokens(t) for d, t in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    scores = {}
    for d, ts in toks.items():
        tf, score = Counter(ts), 0.0
        for t in tokens(query):
            if tf[t]:
                idf = max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1), 1e-4)
                score += idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avg))
        if score > 0:
            scores[d] = score
    return scores


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(list(DOCS.items()), "chunk_id long, text string")
    queries = spark.createDataFrame(list(ASKED.items()), "query_id long, text string")
    return chunks, queries


def as_map(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_bm25_matches_brute_force_in_both_ways(spark, tables):
    chunks, queries = tables
    index = bm25.write_index(chunks, scratch_path(spark, "index"), salts=2)
    for found in (bm25.search_corpus(chunks, queries, 3), bm25.search_index(index, queries, 3)):
        got = as_map(found)
        assert set(got) == {10, 11}
        for q, rows in got.items():
            want = brute_bm25(DOCS, ASKED[q])
            best = max(want.values())
            order = sorted(want, key=lambda d: (-round(want[d], 9), d))[:3]
            assert [c for _, c, _ in rows] == order
            assert [s for _, _, s in rows] == pytest.approx([want[d] / best for d in order])
            assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))


def test_bm25_filter_keeps_the_unfiltered_maximum(tables):
    chunks, queries = tables
    got = as_map(bm25.search_corpus(chunks, queries, 3, where=F.col("chunk_id") == 1))
    want = brute_bm25(DOCS, ASKED[10])
    assert got[10] == [(1, 1, pytest.approx(want[1] / max(want.values())))]
    assert 11 not in got


def test_bm25_large_query_path(tables, monkeypatch):
    chunks, queries = tables
    usual = as_map(bm25.search_corpus(chunks, queries, 3))
    monkeypatch.setattr(bm25, "is_small", lambda *a: False)
    assert as_map(bm25.search_corpus(chunks, queries, 3)) == usual


@pytest.mark.parametrize("metric", dense.METRICS)
def test_dense_matches_numpy_with_copies_and_blocks(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 5)).astype(np.float32)
    vecs[20:50] = vecs[7]  # half of the table are copies of one vector
    asked = vecs[[7, 3, 55]]
    monkeypatch.setattr(dense, "BLOCK_BYTES", 100)  # several passes
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, embedding array<float>")
    got = as_map(dense.dense_search(v, q, 4, metric))
    a, b = asked.astype(float), vecs.astype(float)
    if metric == "cosine":
        s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    elif metric == "dot":
        s = a @ b.T
    else:
        s = -np.linalg.norm(a[:, None] - b[None], axis=2)
    for i in range(3):
        order = sorted(range(60), key=lambda j: (-round(s[i, j], 6), j))[:4]
        assert [c for _, c, _ in got[i]] == order
    with pytest.raises(ValueError):
        dense.dense_search(v, q, 4, "none")


def test_dense_rejects_other_dimension(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="vector size differs"):
        dense.dense_search(v, q, 1).collect()


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")


def test_fusions(spark):
    a = ranked(spark, [(1, 5, 0.8, 1), (1, 6, 0.5, 2)])
    b = ranked(spark, [(1, 7, 0.9, 1), (1, 5, 0.4, 2)])
    rrf = as_map(fusion.reciprocal_rank_fusion([a, b]))[1]
    assert rrf[0] == (1, 5, 0.032522) and [c for _, c, _ in rrf] == [5, 7, 6]
    mixed = as_map(fusion.weighted_fusion(a, b.where("false")))[1]
    assert [(c, s) for _, c, s in mixed] == [(5, 0.4), (6, 0.25)]


def brute_mmr(items, texts, k, lam):
    sets = {c: set(re.findall(r"\w+", t.lower())) for c, t in texts.items()}
    sim = lambda x, y: len(sets[x] & sets[y]) / max(len(sets[x] | sets[y]), 1) if sets[x] and sets[y] else 0.0
    if len(items) <= k:
        return [c for c, _ in items]
    picked, rest = [items[0]], list(items[1:])
    while len(picked) < k and rest:
        values = [round(lam * s - (1 - lam) * max(sim(c, p) for p, _ in picked), 12) for c, s in rest]
        picked.append(rest.pop(values.index(max(values))))
    return [c for c, _ in picked]


def test_mmr_both_ways_match_brute_force(spark):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))) for i in range(40)}
    rows, want = [], {}
    for q in range(12):
        items = sorted(
            ((c, rnd.choice([0.1, 0.2, 0.5, 0.9])) for c in rnd.sample(range(40), rnd.randint(1, 12))), key=lambda x: -x[1]
        )
        rows += [(q, c, s, i) for i, (c, s) in enumerate(items, 1)]
        want[q] = brute_mmr(items, texts, 5, 0.5)
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    cand = ranked(spark, rows)
    for found in (mmr.mmr_bounded(cand, chunks, 5), mmr.mmr_rounds(cand, chunks, 5)):
        assert {q: [c for _, c, _ in v] for q, v in as_map(found).items()} == want


def test_channels():
    with pytest.raises(hybrid.NoChannelError):
        hybrid.run_channels(a=lambda: 1 / 0)
    planned, errors = hybrid.run_channels(a=lambda: 1 / 0, b=lambda: "df")
    assert planned == {"b": "df"} and "a" in errors


def test_filters(spark):
    df = spark.createDataFrame([(1, "A", True), (2, "b", False), (3, None, None)], "id int, name string, flag boolean")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    assert filters.compile_filter({}) is None
    assert ids(filters.compile_filter({"id": {"gt": 1, "lte": 3}})) == [2, 3]
    assert ids(filters.compile_conditions([("meta_name", "ne", "b")])) == [1]
    assert ids(filters.match_text({"name": ["a", "B"], "flag": False})) == [2]
