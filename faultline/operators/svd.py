"""Truncated SVD of the term matrix, without centring, and the embedding built on it.

The leading subspace is found by randomised block iteration. The driver holds a block of terms x (dims + a few more)
numbers, never terms x terms. In a pass every task multiplies its rows with the block and back again, `A'(A V)`; the
partial results are added up in a tree, sixteen at a time, in slices of bounded size. The last pass takes the QR
factor of `A V`, reduced over the same tree: a task factors its rows batch by batch, then factors of sixteen tasks are
stacked and factored again. The small factor that is left turns the block into singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from faultline.functions import arrays
from faultline.operators.reduction import batch_of, joined, slices_of, tree_reduced
from faultline.sources.shared import fewer_tasks

#: Further columns of the block, and passes that turn it towards the leading vectors.
OVERSAMPLE, ITERATIONS = 16, 6

#: Numbers of a dense block of rows.
DENSE = 1 << 21

#: What the passes read of many rows: numbers of terms, terms, weights.
_PACKED = ["lengths", "ids", "weights"]


@dataclass(frozen=True)
class SvdModel:
    components: np.ndarray  # terms x dims
    singular_values: np.ndarray
    explained_variance: float
    rows: int

    @property
    def dims(self) -> int:
        return self.components.shape[1]


def _dense_blocks(offsets: np.ndarray, ids: np.ndarray, weights: np.ndarray, terms: int) -> Iterator[np.ndarray]:
    """The rows as dense blocks of bounded size."""
    for part in arrays.chunks(len(offsets) - 1, max(16, DENSE // terms)):
        lo, hi = offsets[part.start], offsets[part.stop]
        block = np.zeros((part.stop - part.start, terms))
        block[np.repeat(np.arange(len(block)), np.diff(offsets[part.start : part.stop + 1])), ids[lo:hi]] = weights[lo:hi]
        yield block


def _packed(weighted: DataFrame, column: str) -> DataFrame:
    """The rows as bytes, many in one, which every pass copies from the cache as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.parts(batches):
            offsets, ids, weights = arrays.sparse(part.column(0))
            numbers = (np.diff(offsets).astype(np.int32), ids.astype(np.int32), weights.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in numbers], names=_PACKED)

    return weighted.select(column).mapInArrow(run, ", ".join(f"{name} binary" for name in _PACKED))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (np.int32, np.int32, np.float64)
    lengths, ids, weights = (arrays.unpacked(batch.column(c), 1, np.dtype(k))[:, 0] for c, k in zip(_PACKED, kinds))
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), ids, weights


def _turned(packed: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'(A V)."""
    terms, width = block.shape
    shared = packed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, np.zeros((terms, width))
        for batch in batches:
            for rows in _dense_blocks(*_unpacked(batch), terms):
                total += rows.T @ (rows @ v)
        yield batch_of(slices_of(total))

    found = joined(tree_reduced(packed, run))
    shared.destroy()
    return found.reshape(terms, width)


def _stacked_factor(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([p.reshape(-1, width) for p in parts]), mode="r")


def _row_factor(packed: DataFrame, block: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of A V, whose rows stay where they are."""
    terms, width = block.shape
    shared = packed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, factor = shared.value, np.zeros((0, width))
        for batch in batches:
            for rows in _dense_blocks(*_unpacked(batch), terms):
                factor = _stacked_factor([factor, rows @ v], width)
        yield batch_of({0: factor})

    found = tree_reduced(packed, run, lambda parts: _stacked_factor(parts, width))
    shared.destroy()
    return found[0].reshape(-1, width)


def fit(
    weighted: DataFrame, terms: int, dims: int = 64, column: str = "tfidf", iterations: int = ITERATIONS,
    oversample: int = OVERSAMPLE, seed: int = 42,
) -> SvdModel:
    """The leading `dims` right singular vectors. `weighted` is read twice, so it should be materialised; the passes read it
    as bytes, from a cache. The number of terms is not limited: tasks and driver hold terms x (dims + oversample) numbers.

    The vectors span the subspace that the iterations found: singular values are exact for it, products of different
    reduced columns vanish. A flat end of the spectrum is found in part only, as with any randomised SVD.
    """
    dims = min(dims, terms)
    width = min(dims + oversample, terms)
    weighted = fewer_tasks(weighted)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    packed = _packed(weighted, column).persist()
    try:
        for _ in range(iterations if width < terms else 0):  # as wide as the matrix: nothing to turn
            block = np.linalg.qr(_turned(packed, block))[0]
        _, sigma, turn = np.linalg.svd(_row_factor(packed, block))
    finally:
        packed.unpersist()
    components = (block @ turn.T)[:, :dims]
    sigma = np.concatenate([sigma, np.zeros(width - len(sigma))])[:dims]
    # The sign of a singular vector is arbitrary: make its largest entry positive.
    peaks = np.abs(components).argmax(axis=0)
    components = components * np.where(components[peaks, np.arange(components.shape[1])] < 0, -1.0, 1.0)

    stats = weighted.select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s")
    ).first().s
    n = stats["count"]
    total = stats["variance"].toArray().sum() * (n - 1) / n
    scores = (sigma**2) / n - (stats["mean"].toArray() @ components) ** 2
    return SvdModel(components, sigma, float(scores.sum() / total) if total > 0 else 0.0, n)


def project(offsets: np.ndarray, ids: np.ndarray, weights: np.ndarray, components: np.ndarray) -> np.ndarray:
    """Rows of length one in the reduced space. The dense block is bounded by the chunk, not by the batch."""
    rows = len(offsets) - 1
    out = np.empty((rows, components.shape[1]))
    for part in arrays.chunks(rows, 512):
        lo, hi = offsets[part.start], offsets[part.stop]
        block = np.zeros((part.stop - part.start, components.shape[0]))
        row_of = np.repeat(np.arange(part.stop - part.start), np.diff(offsets[part.start : part.stop + 1]))
        block[row_of, ids[lo:hi]] = weights[lo:hi]
        out[part] = block @ components
    return arrays.unit_rows(out)


def second_moments(weighted: DataFrame, model: SvdModel, column: str = "tfidf") -> np.ndarray:
    """V'GV from the rows: products of the reduced, not yet normalised rows, added up. Its size is that of the model."""
    shared = weighted.sparkSession.sparkContext.broadcast(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = shared.value
        total = np.zeros((components.shape[1],) * 2)
        for batch in batches:
            for rows in _dense_blocks(*arrays.sparse(batch.column(0)), len(components)):
                scores = rows @ components
                total += scores.T @ scores
        yield pa.RecordBatch.from_arrays([arrays.list_column(total.reshape(1, -1))], names=["total"])

    partial = weighted.select(column).mapInArrow(run, "total array<double>")
    added = partial.select(Summarizer.sum(array_to_vector("total")).alias("total")).first().total
    return added.toArray().reshape((model.dims,) * 2)


def embed(weighted: DataFrame, model: SvdModel, keep: Sequence[str], column: str = "tfidf") -> DataFrame:
    """`keep` and `embedding`; a zero row keeps a zero embedding."""
    keep = list(keep)
    shared = weighted.sparkSession.sparkContext.broadcast(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = shared.value
        for part in arrays.parts(batches):
            matrix = project(*arrays.sparse(part.column(column)), components)
            yield arrays.with_column(part, keep, embedding=arrays.list_column(matrix))

    schema = StructType(
        [weighted.schema[c] for c in keep] + [StructField("embedding", ArrayType(DoubleType(), False))]
    )
    extra = [] if column in keep else [column]
    return weighted.select(*keep, *extra).mapInArrow(run, schema)
