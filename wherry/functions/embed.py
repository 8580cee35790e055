"""Embedders and rerank scorers: interfaces and deterministic defaults.

Models are plug-ins; without one, texts are embedded by feature hashing in column expressions, so that the
engine's plans can be run and tested offline.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.functions.text import bm25_tokens
from wherry.functions.vec import l2_normalize


class Embedder(Protocol):
    """Batches of texts to vectors; queries may carry a prefix of their own."""

    dim: int
    query_prefix: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextScorer(Protocol):
    """A logit for each pair of query and text."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


class ZeroEmbedder:
    """Vectors of zeros: the index without a model."""

    query_prefix = ""

    def __init__(self, dim: int):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dim for _ in texts]


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Signed feature hashing of a text's tokens, of unit length; no Python on the executors."""
    h = F.transform(bm25_tokens(text), lambda t: F.xxhash64(t))
    slots = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dim)) == i), F.lit(0.0), lambda s, x: s + F.when(F.shiftright(x, 40) % 2 == 0, 1.0).otherwise(-1.0)))
    return l2_normalize(slots)


def embed_with(df: DataFrame, text: str, make: "callable", batch: int = 32, query: bool = False) -> DataFrame:
    """Add ``vector`` from an embedder that ``make()`` builds once for each task; batches are sorted by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for s in range(0, len(order), batch):
                part = order[s : s + batch]
                for i, v in zip(part, model.embed([(model.query_prefix if query else "") + texts[i] for i in part])):
                    out[i] = np.asarray(v, np.float32).tolist()
            yield pdf.assign(vector=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, vector array<float>")


def mean_pool(tokens: Column) -> Column:
    """Mean of token vectors (array of arrays)."""
    n = F.size(tokens)
    dims = F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1)
    return F.transform(dims, lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.get(t, i)) / n)


def last_token(tokens: Column) -> Column:
    return F.element_at(tokens, -1)
