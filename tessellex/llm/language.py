"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language; a word's features are its affixes, its letter n-grams and its
place in the lexicons that training learned, and the transitions between neighbours' languages are
learned with the weights. Forward-backward gives every word the probability of each language, also
where a text switches between them; the document's language is that with the largest sum.

Training takes at most MAX_DOCS documents of each language, those with the smallest hashes of their
ids, and fits in one task by gradient ascent. Its sequences string together stretches of documents of
all languages, so that switches are seen. Scoring covers every word of every document.

Words are runs of letters with their combining marks; signs, digits and fractions are none.

Defined results: null texts and texts without a letter are ``und`` with score 0. Without any labelled
document everything is ``und``. Ties go to the first language in order. Equal texts have equal results, repeated rows and ids
one row each; an empty table gives no rows. Only the id is passed on, so other columns may have any name.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DOCS = 400
PARTS = 64
STRETCH = 24  # words of one document in a row in a training sequence
SEQUENCE = 5  # stretches in a sequence
SLOTS = 1 << 15
LEXICON = 3_000  # words of each language
ROUNDS = 60
L2 = 1e-5
CACHE = 150_000

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, word numbers and values: affixes of 1 to 4 letters count 1, n-grams share a weight of 4."""
    marked = ["^" + w + "$" for w in words]
    size = np.array([len(w) for w in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    slots, owners, values = [], [], []
    for n in (1, 2, 3):
        keep = np.arange(max(0, len(code) - n + 1))
        keep = keep[word[keep] == word[keep + n - 1]]
        h = np.full(len(keep), n, np.uint64)
        for j in range(n):
            h = (h ^ code[keep + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        slots.append(h % np.uint64(SLOTS))
        owners.append(word[keep])
        values.append(4.0 / (3 * np.maximum(1, size[word[keep]] - n + 1)))
    for n in (2, 3, 4):
        have = np.flatnonzero(size >= n + 1)
        for kind, first in ((10, start[have]), (20, start[have] + size[have] - n)):
            h = np.full(len(have), n + kind, np.uint64)
            for j in range(n):
                h = (h ^ code[first + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(31)
            slots.append(h % np.uint64(SLOTS))
            owners.append(have)
            values.append(np.ones(len(have)))
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners), np.concatenate(values)


class Emissions:
    """Scores of words in each language, kept for CACHE words."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int], lexicon_weights: np.ndarray) -> None:
        self.weights, self.lexicon, self.lexicon_weights = weights, lexicon, lexicon_weights
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, weights.shape[1]))

    def rows(self, words: list[str]) -> np.ndarray:
        """One row per word."""
        new = list(set(words) - self.at.keys())
        if len(self.at) + len(new) > CACHE:
            self.at, self.table, new = {}, self.table[:0], list(set(words))
        if new:
            parts = [self.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            base = len(self.at)
            self.at.update(zip(new, range(base, base + len(new))))
            self.table = np.concatenate([self.table, *parts])
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]

    def score(self, words: list[str]) -> np.ndarray:
        slots, owners, values = _features(words)
        k = self.weights.shape[1]
        out = np.stack([np.bincount(owners, self.weights[slots, j] * values, len(words)) for j in range(k)], axis=1)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        for i, lang in known:
            out[i] += self.lexicon_weights[lang]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, sums: bool = False):
    """Marginals of padded sequences (sequence, place, language) sorted by falling length.

    With ``sums`` also the expected transitions, summed, and the log-likelihood's normaliser.
    """
    b, n, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(transitions)
    alpha, scale = np.empty((b, n, k)), np.ones((b, n))
    active = np.searchsorted(-lengths, -np.arange(n), side="left")  # sequences longer than each place
    state = emit[:, 0] / k
    for t in range(n):
        m = active[t]
        if t:
            state = (state[:m] @ step) * emit[:m, t]
        total = state.sum(axis=1, keepdims=True)
        state = state / total
        alpha[:m, t], scale[:m, t] = state, total[:, 0]
    pairs = np.zeros((k, k))
    beta = np.ones((b, k))
    for t in range(n - 1, 0, -1):
        m = active[t]
        onward = beta[:m] * emit[:m, t] / scale[:m, t, None]
        if sums:
            pairs += np.einsum("bi,ij,bj->ij", alpha[:m, t - 1], step, onward)
        alpha[:m, t] *= beta[:m]
        beta[:m] = onward @ step.T
    alpha[:, 0] *= beta
    if not sums:
        return alpha
    inside = np.arange(n)[None, :] < lengths[:, None]
    return alpha, pairs, float((np.log(scale) + top[:, :, 0])[inside].sum())


def fit(texts: list[str], langs: list[str]) -> dict:
    """Weights, lexicon and transitions; texts of all languages, in any order."""
    names = sorted(set(langs))
    k = len(names)
    if not k:
        return {"langs": []}
    docs = [(words_of(t), names.index(lang)) for t, lang in zip(texts, langs)]
    counts = [Counter() for _ in names]
    for words, y in docs:
        counts[y].update(words)
    totals = np.array([max(1, sum(c.values())) for c in counts], float)
    lexicon = {}
    for y, c in enumerate(counts):
        own = [(n, w) for w, n in c.items() if n >= 3 and n / totals[y] > 4 * sum(o[w] for j, o in enumerate(counts) if j != y) / max(1, totals.sum() - totals[y])]
        lexicon.update({w: y for _, w in sorted(own, key=lambda x: (-x[0], x[1]))[:LEXICON]})
    stretches = [(words[i : i + STRETCH], y) for words, y in docs for i in range(0, len(words), STRETCH)]
    rng = np.random.default_rng(7)
    order = rng.permutation(len(stretches))
    groups = [[stretches[i] for i in order[j : j + SEQUENCE]] for j in range(0, len(order), SEQUENCE)]
    vocabulary: dict[str, int] = {}
    seqs, labels = [], []
    for g in groups:
        seqs.append([vocabulary.setdefault(w, len(vocabulary)) for words, _ in g for w in words])
        labels.append([y for words, y in g for _ in words])
    by_length = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lengths = np.array([len(seqs[i]) for i in by_length])
    width = int(lengths.max(initial=1))
    words_at = np.zeros((len(seqs), width), np.int64)
    truth = np.zeros((len(seqs), width), np.int64)
    for r, i in enumerate(by_length):
        words_at[r, : lengths[r]], truth[r, : lengths[r]] = seqs[i], labels[i]
    inside = np.arange(width)[None, :] < lengths[:, None]
    all_words = list(vocabulary)
    slots, owners, values = _features(all_words)
    in_lexicon = np.array([lexicon.get(w, -1) for w in all_words])
    n_words = inside.sum()
    share = np.bincount(truth[inside], minlength=k) / n_words
    importance = (1 / np.maximum(share, 1e-9) / k)[truth] * inside  # languages weigh alike
    flat_words, flat_truth, flat_weight = words_at[inside], truth[inside], importance[inside]
    observed = np.zeros((k, k))
    both = inside[:, 1:]
    np.add.at(observed, (truth[:, :-1][both], truth[:, 1:][both]), 1.0)
    params = {"w": np.zeros((SLOTS, k)), "x": np.zeros((k, k)), "t": np.zeros((k, k))}
    moments = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in params.items()}
    for it in range(1, ROUNDS + 1):
        emissions = np.stack([np.bincount(owners, params["w"][slots, j] * values, len(all_words)) for j in range(k)], axis=1)
        listed = in_lexicon >= 0
        emissions[listed] += params["x"][in_lexicon[listed]]
        marginal, pairs, _ = forward_backward(emissions[words_at], lengths, params["t"], sums=True)
        gap = -marginal[inside]
        gap[np.arange(len(flat_truth)), flat_truth] += 1
        gap *= flat_weight[:, None] / n_words
        per_word = np.stack([np.bincount(flat_words, gap[:, j], len(all_words)) for j in range(k)], axis=1)
        grads = {
            "w": np.stack([np.bincount(slots, per_word[owners, j] * values, SLOTS) for j in range(k)], axis=1) - L2 * params["w"],
            "x": np.stack([np.bincount(in_lexicon[listed], per_word[listed, j], k) for j in range(k)], axis=1) - L2 * params["x"],
            "t": (observed - pairs) / n_words - L2 * params["t"],
        }
        for name, g in grads.items():
            m = moments[name]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            params[name] += 0.1 * (m[0] / (1 - 0.9**it)) / (np.sqrt(m[1] / (1 - 0.99**it)) + 1e-8)
    return {
        "langs": names, "weights": np.round(params["w"], 4).tolist(), "lexicon": lexicon,
        "lexicon_weights": params["x"].tolist(), "transitions": params["t"].tolist(),
    }


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    use: Column | None = None,
    max_docs: int = MAX_DOCS,
) -> dict:
    """Model from at most ``max_docs`` documents of each language, fitted in one task."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if use is not None:
        known = known.where(use)
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_h"))
    ids = ids.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(PARTS)))
    in_part = Window.partitionBy("_lang", "_part").orderBy("_h", "_id")
    first = Window.partitionBy("_lang").orderBy("_h", "_id")
    for window in (in_part, first):  # a hot language is cut down in parts, each bounded before the last step
        ids = ids.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= max_docs).drop("_rank")
    chosen = ids
    marks = chosen.select(F.col("_id").alias("_i"), F.col("_lang").alias("_l")).distinct()
    rows = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(
        F.broadcast(marks), (F.col("_id") == F.col("_i")) & (F.col("_lang") == F.col("_l"))
    )

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_id", "_text"])
        return pd.DataFrame({"model": [json.dumps(fit(list(batch["_text"]), list(batch["_lang"])))]})

    made = rows.select("_id", "_lang", "_text", F.lit(1).alias("_all")).groupBy("_all").applyInPandas(run, "model string").collect()
    return json.loads(made[0]["model"]) if made else fit([], [])


_ready: dict[str, tuple] = {}


def _prepared(shared) -> tuple:
    key, m = shared.value
    if key not in _ready:
        _ready.clear()
        emissions = Emissions(np.array(m["weights"]), m["lexicon"], np.array(m["lexicon_weights"]))
        _ready[key] = emissions, np.array(m["transitions"])
    return _ready[key]


def marginals(texts: list[list[str]], emissions: Emissions, transitions: np.ndarray, cells: int = 400_000) -> list[np.ndarray]:
    """Per text the probabilities of its words' languages; texts of similar length run together."""
    out: list = [np.zeros((0, transitions.shape[0]))] * len(texts)
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        some = order[at : at + max(1, cells // longest)]
        at += len(some)
        lengths = np.array([len(texts[i]) for i in some])
        rows = emissions.rows([w for i in some for w in texts[i]])
        scores = np.zeros((len(some), longest, transitions.shape[0]))
        scores[np.arange(longest)[None, :] < lengths[:, None]] = rows
        found = forward_backward(scores, lengths, transitions)
        for r, i in enumerate(some):
            out[i] = found[r, : lengths[r]]
    return out


def identify(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (mean probability of that language over the
    words) and ``switches``, the places where neighbouring words' languages differ."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    @F.pandas_udf("struct<lang_pred string, score double, switches int>")
    def label(column: pd.Series) -> pd.DataFrame:
        names = shared.value[1]["langs"]
        rows: list[tuple] = []
        for a in range(0, len(column), 512):
            texts = [words_of(t) for t in column.iloc[a : a + 512]]
            if not names:
                rows += [("und", 0.0, 0)] * len(texts)
                continue
            for p in marginals(texts, *_prepared(shared)):
                if not len(p):
                    rows.append(("und", 0.0, 0))
                    continue
                mean = p.mean(axis=0)
                best = p.argmax(axis=1)
                rows.append((names[int(mean.argmax())], float(min(1.0, mean.max())), int((best[1:] != best[:-1]).sum())))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "switches"])

    labelled = docs.select(id_col, label(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_l"))
    return labelled.select(id_col, "_l.*")
