"""BPE with word ends by a deterministic tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges give. It starts as one state with
an arc for every base symbol to itself, and every merge (u, v) applies its gadget: the state behind u is copied without its v arc,
all u arcs lead to the copy, and wherever u and v could be read one after another a new arc uv leads behind v. All arcs with
one label lead to the same state, so an automaton of m merges has m + 1 states. The states behind one token form a line:
it starts as the state behind the token's second part and each copy lacks one arc more. A state is thus a line at a time, and the
table is four numbers a token and one a removed arc. Every prefix of an accepted sequence is accepted, so exactly one arc
that ends at a place of a word is on a path from its start: a word is encoded from left to right by following arcs, in time linear
in its length. Decoding emits the labels of the arcs.

Texts are split at the special tokens, normalised (canonical composition, lower case) and split into words
first; words are bytes, the last one marked as the end.

Defined results: null and empty texts have no ids and decode to the empty text. Rows may share ids or
be repeated; each is encoded by itself. A text of any length is encoded whole. Names of other columns don't matter. An
empty table gives an empty one. Characters that Unicode got after version 15.1 count as Python's tables have them. Ids without a token raise an error in decoding.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the library's patterns understand it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct words that a worker keeps encoded, about 200 bytes each.
CACHE = 400_000


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary -> byte: printable Latin-1 characters stand for themselves, others for 256 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Arcs of the automaton; merge r makes its copies and its new arcs at time r."""

    def __init__(self, base: int, merges: list[tuple[int, int, int]]) -> None:
        size = base + len(merges)
        self.size = size
        self.born = array("i", [-1]) * size  # when a token's arc and line began
        self.left = array("i", range(size))  # first and second part of a token
        self.right = array("i", range(size))
        self.read = bytearray(b"\x01") * size  # whether any text gives the token
        self.removed: dict[int, int] = {}  # line and label of an arc that a copy lacks -> time
        for r, (u, v, made) in enumerate(merges):
            self._gadget(r, u, v, made)

    def _gadget(self, r: int, u: int, v: int, made: int) -> None:
        if not (self.read[u] and self.read[v] and self.has_arc(u, v, r)):
            self.read[made] = 0
            return
        self.born[made], self.left[made], self.right[made] = r, u, v
        self.removed[u * self.size + v] = r

    def has_arc(self, line: int, token: int, time: int = 1 << 30) -> bool:
        """Whether the state behind the token ``line`` had an arc ``token`` before the gadget of that time."""
        born, left, right, removed, size = self.born, self.left, self.right, self.removed, self.size
        while True:
            if removed.get(line * size + token, time) < time:
                return False
            if born[token] < 0 and born[line] < 0:
                return True
            if born[token] >= born[line]:  # the arc came to the line's state that its own gadget left there, if that had its first part
                time = born[token] + 1
                token = left[token]
            else:  # the line began with the arcs that the line of its second part had
                time = born[line]
                line = right[line]


class Tokenizer:
    """Rules of a tokenizer file; sent to the workers with its automaton, while the words met stay with each worker."""

    def __init__(self, file: str) -> None:
        rules = json.loads(file)
        model, self.suffix = rules["model"], rules["model"]["end_of_word_suffix"]
        steps = [s["type"] for s in rules["normalizer"]["normalizers"]] + [s["type"] for s in rules["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not self.suffix or steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("the file must describe a lower-casing byte-level BPE with word ends")
        self.pattern = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        self.automaton = Automaton(len(vocabulary) - len(merges), merges)
        self.names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        values = byte_symbols()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            if self.automaton.read[i]:
                bare = token.removesuffix(self.suffix)
                (self.inner if bare == token else self.final)[bytes(values[c] for c in bare)] = i
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "older", "rule", "cut")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _prepare(self) -> None:
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.rule = regex.compile(self.pattern)
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(names)})") if names else None

    def word_ids(self, word: bytes) -> list[int]:
        """Labels of the one path that spells the word."""
        n, longest = len(word), self.longest
        if n <= longest and (whole := self.final.get(word)) is not None:
            return [whole]
        inner, has_arc = self.inner, self.automaton.has_arc
        last, start = [-1] * n, [0] * n  # label and start of the arc that ends at a place
        for at in range(n):
            before = last[at]
            if at and before < 0:
                continue
            if n - at <= longest and (token := self.final.get(word[at:])) is not None and (not at or has_arc(before, token)):
                found = [token]
                while at:
                    found.append(last[at])
                    at = start[at]
                return found[::-1]
            for end in range(at + 1, min(n - 1, at + longest) + 1):
                if last[end] < 0 and (token := inner.get(word[at:end])) is not None and (not at or has_arc(before, token)):
                    last[end], start[end] = token, at
        raise ValueError(f"no path spells the word {word!r}")

    def _remembered(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.word_ids(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            if len(self.words) >= CACHE:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for i, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            known = self.words
            for word in self.rule.findall(lowered(part)):
                ids = known.get(word)
                if ids is None:
                    ids, known = self._remembered(word), self.words
                out.append(ids)
        return b"".join(out)


def lowered(text: str) -> str:
    """Composed text in lower case, character by character: a capital sigma is never a final one."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "σ".join(part.lower() for part in text.split("Σ"))


def read_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a JSON file, compiled where the query is built."""
    with open(path, encoding="utf-8") as file:
        return Tokenizer(file.read())


def encode(docs: DataFrame, tokenizer: Tokenizer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("binary")
    def ids_of(texts: pd.Series) -> pd.Series:
        code = shared.value.encode
        return pd.Series([code(t) for t in texts], dtype=object)

    coded = docs.select(F.col(id_col), ids_of(F.col(text_col).cast("string")).alias("ids"))
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, tokenizer: Tokenizer, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the labels of the ids, joined by spaces as the tokenizer has no decoder; null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        name = shared.value.names.__getitem__
        return pd.Series([None if ids is None else " ".join(map(name, np.frombuffer(ids, "<u4").tolist())) for ids in column], dtype=object)

    return encoded.withColumn(out_col, text_of(ids_col))
