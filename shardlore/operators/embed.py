"""The embedding plug-in: any function of texts to vectors, run in sorted batches.

No model ships with this package.  :class:`HashingEmbedder` is a deterministic
stand-in for tests: it has no semantic quality.  A real model is a class with
``dim`` and ``embed(texts) -> (n, dim) float array``; workers make one instance
each, when the first batch comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value.
BATCH = 16


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words, at unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "replace")).digest()[:4], "big")
                row[h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


_made: dict = {}


def _instance(factory: Callable[[], Embedder]) -> Embedder:
    if factory not in _made:
        _made[factory] = factory()
    return _made[factory]


def embed_texts(texts: DataFrame, factory: Callable[[], Embedder], batch: int = BATCH) -> DataFrame:
    """(id, text) -> (id, embedding). Texts of like length share a batch, so padding is small; ids make a restore step needless."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            model = _instance(factory)
            for k in range(0, part.num_rows, batch):
                piece = part.slice(k, batch)
                made = np.asarray(model.embed([t or "" for t in piece.column("text").to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["id", "embedding"])

    # by id as well: texts of one length, such as those cut at the most, are many ranges
    sized = texts.select(F.col("id").cast("long").alias("id"), "text", F.char_length(F.coalesce("text", F.lit(""))).alias("len"))
    return sized.repartitionByRange("len", "id").sortWithinPartitions("len").select("id", "text").mapInArrow(run, "id long, embedding array<float>")


def embed_query(text: str, factory: Callable[[], Embedder]) -> list[float]:
    return [float(x) for x in np.asarray(_instance(factory).embed([text]))[0]]
