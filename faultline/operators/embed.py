"""Embeddings from a caller's model: texts go to it in batches, inside the tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from faultline.functions import arrays

Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=1 << 17)
def _slot(word: str, dims: int) -> tuple[int, float]:
    h = int(md5(word.encode()).hexdigest()[:8], 16)
    return (h >> 1) % dims, 1.0 if h & 1 else -1.0


def hashing_embedder(texts: list[str], dims: int = 64) -> np.ndarray:
    """A stand-in that needs no model: signed word counts in hashed positions."""
    out = np.zeros((len(texts), dims))
    for row, text in enumerate(texts):
        for word in re.findall(r"\w{2,}", text.lower()):
            slot, sign = _slot(word, dims)
            out[row, slot] += sign
    return arrays.unit_rows(out)


def embed_batched(
    df: DataFrame, text: str, keep: Sequence[str], embedder: Embedder = hashing_embedder, batch_size: int = 64
) -> DataFrame:
    """`keep` and `embedding`. The embedder gets at most `batch_size` whole texts per call."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = np.asarray(embedder(part.column("_text").to_pylist()), dtype=np.float64)
                yield arrays.with_column(part, keep, embedding=arrays.list_column(vectors))

    schema = StructType([df.schema[c] for c in keep] + [StructField("embedding", ArrayType(DoubleType()))])
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)
