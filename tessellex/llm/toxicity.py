"""Toxicity by multiple-instance learning: document labels train scores of sentences.

A sentence's score is a logistic function of its words; a document is toxic unless all of its
sentences are not: 1 - (1 - leak) * product of (1 - score). Words, weights and leak are
learned from labelled documents only, by gradient ascent on the documents' likelihood. A positive
document that one sentence explains gives no push to its other sentences, so the weights settle on
the words that mark the offending sentences, which are then located by their own scores.

The model is fitted in one task on at most MAX_TOXIC and MAX_CLEAN labelled documents, those with
the smallest hashes of their ids; rows are weighted so that the classes keep their shares among all
labelled documents. Scoring covers every sentence of every document.

Defined results: null and empty texts have no sentence and get the leak as score. Without labels
of both kinds the model has no words and scores everything 0. Null labels are not used.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC = 3_000
MAX_CLEAN = 6_000
#: A word is a feature if chance gives any word such a share of toxic documents with this probability
#: at most (Chernoff bound times the number of words).
CHANCE = 0.05
MAX_WORDS = 4_000
#: A training document is left out if so many of its sentences stand in those before it: a group of
#: near copies would make each of its words look toxic.
REPEATED = 0.5
#: Words whose sentence would score less by them alone leave the model.
LEAST_ALONE = 0.2
ROUNDS = 250
L1 = 2e-4

SENTENCE = re.compile(r"[^.!?\n]*[.!?]*\s*")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences: up to the marks that end them, or a line's end."""
    return [m.span() for m in SENTENCE.finditer(text or "") if m.group().strip()]


def _bags(text: str | None) -> list[set[str]]:
    low = text or ""
    return [set(WORD.findall(low[a:b].lower())) for a, b in sentences(low)]


def fit(texts: list[str | None], labels: list[int], weight_clean: float = 1.0) -> dict:
    """``{"words": {word: weight}, "bias": b, "leak": p}`` by noisy-or over the sentences."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {"words": {}, "bias": 0.0, "leak": 0.0}
    bags, own, known = [], [], set()
    for text, label in zip(texts, y):
        found = [frozenset(b) for b in _bags(text)]
        if found and sum(b in known for b in found) >= REPEATED * len(found):
            continue
        known.update(found)
        bags.append(found)
        own.append(label)
    y = np.array(own)
    if not y.any():
        return {"words": {}, "bias": 0.0, "leak": 0.0}
    toxic, total = Counter(), Counter()
    for found, label in zip(bags, y):
        words = set().union(*found)
        total.update(words)
        if label:
            toxic.update(words)
    share = y.mean()
    scored = []
    for w, c in toxic.items():
        p = c / total[w]
        if p > share:
            gap = p * np.log(p / share) + (0 if p == 1 else (1 - p) * np.log((1 - p) / (1 - share)))
            scored.append((total[w] * gap, w))
    least = np.log(len(total) / CHANCE)
    scored = [x for x in sorted(scored, reverse=True)[:MAX_WORDS] if x[0] > least]
    index = {w: i for i, (_, w) in enumerate(scored)}
    at_sentence, at_word, doc_of = [], [], []
    for d, b in enumerate(bags):
        for words in b:
            hit = [index[w] for w in words if w in index]
            if hit:
                at_sentence += [len(doc_of)] * len(hit)
                at_word += hit
                doc_of.append(d)
    rows, cols, docs = (np.array(x, dtype=np.int64) for x in (at_sentence, at_word, doc_of))
    importance = np.where(y > 0, 1.0, weight_clean)
    importance /= importance.sum()
    w, bias, leak = np.zeros(len(index)), -3.0, -3.0
    moments = [np.zeros(len(index) + 2), np.zeros(len(index) + 2)]
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(rows, w[cols], len(docs))
        p = 1 / (1 + np.exp(-z))
        lk = 1 / (1 + np.exp(-leak))
        none = np.log1p(-lk) + np.bincount(docs, np.log1p(-np.clip(p, 0, 1 - 1e-9)), len(y))
        pos = np.clip(-np.expm1(none), 1e-9, 1)
        pull = importance * np.where(y > 0, (1 - pos) / pos, -1.0)  # d log-likelihood / d(-none)
        gz = pull[docs] * p
        grad = np.concatenate([np.bincount(cols, gz[rows], len(index)), [gz.sum(), (pull * lk).sum()]])
        for k, b in ((0, 0.9), (1, 0.999)):
            moments[k] = b * moments[k] + (1 - b) * grad ** (k + 1)
        step = 0.15 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-9)
        w = w + step[:-2]
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.15 * L1 * 10)
        bias, leak = bias + step[-2], min(leak + step[-1], -2.0)
    words = {word: float(w[i]) for word, i in index.items() if 1 / (1 + np.exp(-(bias + w[i]))) >= LEAST_ALONE}
    return {"words": words, "bias": float(bias), "leak": float(1 / (1 + np.exp(-leak)))}


def score_sentences(text: str | None, model: dict) -> list[tuple[int, int, float]]:
    """Sentences that hold a word of the model: start, end and score."""
    words, bias, out = model["words"], model["bias"], []
    text = text or ""
    for a, b in sentences(text):
        hit = words.keys() & set(WORD.findall(text[a:b].lower()))
        if hit:
            out.append((a, b, float(1 / (1 + np.exp(-(bias + sum(words[w] for w in sorted(hit))))))))
    return out


def document_score(found: list[tuple[int, int, float]], model: dict) -> float:
    none = 1 - model["leak"]
    for _, _, p in found:
        none *= 1 - p
    return 1 - none


def _sample(labelled: DataFrame, label: int, limit: int) -> DataFrame:
    return labelled.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(limit)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    use: Column | None = None,
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
) -> dict:
    """Model from at most ``max_toxic + max_clean`` labelled documents, fitted in one task."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if use is not None:
        known = known.where(use)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = _sample(known, 1, max_toxic).unionByName(_sample(known, 0, max_clean))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_text", "_label", F.lit(1).alias("_all"))
    kept_clean = min(max_clean, sizes.get(0, 0))
    weight = sizes.get(0, 0) / kept_clean / (sizes.get(1, 1) / min(max_toxic, sizes.get(1, 1))) if kept_clean else 1.0

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_id", "_text"], key=lambda c: c.astype(str) if c.name == "_text" else c)
        return pd.DataFrame({"model": [json.dumps(fit(list(batch["_text"]), list(batch["_label"]), weight))]})

    made = rows.groupBy("_all").applyInPandas(run, "model string").collect()
    return json.loads(made[0]["model"]) if made else fit([], [])


def score(
    docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", row: bool = False, least: float = 0.5
) -> DataFrame:
    """One row per document: id (or, with ``row``, the row as a struct), ``score`` and ``spans``, the
    sentences with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, spans array<struct<start int, stop int, score double>>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        scores, spans = [], []
        for text in texts:
            found = []
            if text and not m["words"].keys().isdisjoint(WORD.findall(text.lower())):
                found = score_sentences(text, m)
            scores.append(document_score(found, m))
            spans.append([{"start": a, "stop": b, "score": p} for a, b, p in found if p >= least])
        return pd.DataFrame({"score": scores, "spans": spans})

    left = F.struct("*").alias("_row") if row else F.col(id_col)
    judged = docs.select(left, judge(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_j"))
    return judged.select(judged.columns[0], "_j.score", "_j.spans")
