"""Embedders: anything with dim and encode(list of texts) -> array; and one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .functions.words import split_words
from .session import ship


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed word counts of norm 1: the same text has the same vector in every process."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in split_words(text or "", fold=True):
                h = zlib.crc32(word.encode())
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def with_embeddings(texts: DataFrame, embedder: Embedder, text_column: str = "text", batch: int = 512) -> DataFrame:
    """texts with a column embedding; encoded in batches by workers, null texts as empty ones."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(embedder)
    names = texts.columns
    at = names.index(text_column)
    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                made = np.asarray(shared.value.encode([t or "" for t in part.column(at).to_pylist()]), dtype=np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, "embedding"])

    return texts.mapInArrow(run, schema)
