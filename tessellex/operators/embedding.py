"""Embedding of texts with a pluggable model.

A model is any function ``list[str] -> array of shape (n, dim)``. It runs in
Arrow batches on the executors; a batch that fails yields NULL embeddings with
the reason, never zero vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv

Embedder = Callable[[Sequence[str]], np.ndarray]


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Offline model: hashed word counts, unit length; a text without words is all zero."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            slots = [_slot(w) % dimension for w in re.findall(r"\w+", text.lower())]
            out[i] = np.bincount(slots, minlength=dimension) if slots else 0.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)

    return embed


def limited(embedder: Embedder, most: int) -> Embedder:
    """A model that refuses texts of more than ``most`` characters, as models with a window do."""

    def run(texts: Sequence[str]) -> np.ndarray:
        for text in texts:
            if len(text) > most:
                raise ValueError(f"{len(text)} characters, {most} allowed")
        return embedder(texts)

    return run


def embed(
    df: DataFrame, embedder: Embedder, text: str = "text", batch_size: int = fv.EMBED_BATCH, isolate: bool = False
) -> DataFrame:
    """Add ``embedding ARRAY<FLOAT>`` and ``embed_error``; NULL text gives NULL.

    With ``isolate`` a batch that fails is tried again in halves, so that only texts that fail alone carry the reason.
    """

    @F.pandas_udf("struct<embedding:array<float>,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        vectors: list = [None] * len(texts)
        errors: list = [None] * len(texts)
        wanted = [i for i, t in enumerate(texts) if t is not None]
        todo = [wanted[at : at + batch_size] for at in range(0, len(wanted), batch_size)]
        while todo:
            rows = todo.pop()
            try:
                result = np.asarray(embedder([texts.iloc[i] for i in rows]), dtype=np.float32)
                for i, vector in zip(rows, result, strict=True):
                    vectors[i] = vector
            except Exception as exc:  # noqa: BLE001 - reported per row
                if isolate and len(rows) > 1:
                    todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                    continue
                for i in rows:
                    vectors[i], errors[i] = None, f"{type(exc).__name__}: {exc}"
        return pd.DataFrame({"embedding": vectors, "error": errors})

    return (
        df.withColumn("_e", run(F.col(text)))
        .withColumn("embedding", F.col("_e.embedding"))
        .withColumn("embed_error", F.col("_e.error"))
        .drop("_e")
    )
