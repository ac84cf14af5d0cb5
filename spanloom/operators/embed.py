"""Embedders: texts to unit vectors. The default attribution needs none (it compares bags of tokens)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import bag_tokens, content_hash
from spanloom.operators import blocks

VECTORS = "content_hash string, vec array<float>"
WIDTH = 384


class Embedder(Protocol):
    def transform(self, texts: DataFrame) -> DataFrame:
        """content_hash, vec for rows of content_hash, text."""


class HashingEmbedder:
    """Signed feature hashing of a text's tokens: no model, the same everywhere."""

    def __init__(self, width: int = WIDTH):
        self.width = width

    def transform(self, texts: DataFrame) -> DataFrame:
        width = self.width

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = np.zeros((len(frame), width))
                for row, tokens in zip(rows, frame["tokens"], strict=True):
                    for token in tokens:
                        h = zlib.crc32(token.encode())
                        row[h % width] += 1.0 if h >> 31 else -1.0
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"content_hash": frame["content_hash"], "vec": list(rows.astype(np.float32))})

        return texts.select("content_hash", bag_tokens(F.col("text")).alias("tokens")).mapInPandas(embed, VECTORS)


class ModelEmbedder:
    """A model behind a function of texts, loaded once in each worker by ``load``."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load = load

    def transform(self, texts: DataFrame) -> DataFrame:
        load = self.load

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for frame in frames:
                vectors = np.asarray(model(list(frame["text"])), np.float32)
                yield pd.DataFrame({"content_hash": frame["content_hash"], "vec": list(vectors)})

        return texts.select("content_hash", "text").mapInPandas(embed, VECTORS)


class ColumnEmbedder:
    """Vectors that are an expression over ``text``."""

    def __init__(self, vec: Column):
        self.vec = vec

    def transform(self, texts: DataFrame) -> DataFrame:
        return texts.select("content_hash", self.vec.cast("array<float>").alias("vec"))


def dense_scores(
    spans: DataFrame, chunks: DataFrame, vectors: DataFrame, scope: list[str], span_key: list[str], chunk_key: list[str],
    uri: str = "uri", order: tuple[str, ...] = ("uri_ord", "chunk_ord"),
) -> DataFrame:
    """scope, span_key, chunk_key, sim by the inner product of vectors: each span's best chunks of each uri.

    All spans and chunks of a scope are compared, block by block; of each pair of blocks the best is kept.
    """
    hashed = lambda df, text: df.withColumn("content_hash", content_hash(F.col(text))).join(vectors, "content_hash")
    left = hashed(spans, "text").select(*scope, *span_key, "vec")
    right = hashed(chunks, "chunk").select(*scope, *chunk_key, "vec")
    return blocks.products(left, right, scope, span_key, chunk_key, "vec", uri, order)
