"""Hashed embeddings and ranking by similarity."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import cosine

DIM = 256
_WORD = re.compile(r"[^\W_]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.sqrt((v * v).sum()))
    return v / np.float32(size) if size else v


def hash_embedding(text: str, dim: int = DIM, bigrams: float = 0.0) -> np.ndarray:
    """Counts of words by the bucket of their hash, as a unit vector; bigrams: weight of each pair of bytes within a word."""
    v = np.zeros(dim, np.float32)
    for word in _WORD.findall(text.translate(_LOWER)):
        raw = word.encode()
        v[xxhash.xxh3_64_intdigest(raw) % dim] += 1
        if bigrams:
            for i in range(len(raw) - 1):
                v[xxhash.xxh3_64_intdigest(raw[i : i + 2]) % dim] += bigrams
    return _unit(v)


def embedder(dim: int = DIM, bigrams: float = 0.0):
    """A column function of texts; any other with this shape can take its place."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_embedding(t or "", dim, bigrams))

    return embed


def rank_by_similarity(rows: DataFrame, query: list[float], vector: str, key: str, k: int | None = None) -> DataFrame:
    """rows' key and cosine with the query, best first, ties to the smaller key; k: only that many, without a full sort."""
    scored = rows.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), key)
    return scored if k is None else scored.limit(k)
