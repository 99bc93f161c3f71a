"""Numpy views of Arrow columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_ROWS = 2048

#: Rows of a matrix in one value of bytes.
BLOCK_ROWS = 128


def dense(column: pa.ListArray, dims: int) -> np.ndarray:
    """A list column as a matrix of doubles; every row must be `dims` wide."""
    lengths = pc.list_value_length(column)
    if column.null_count or (len(column) and (pc.min(lengths).as_py() != dims or pc.max(lengths).as_py() != dims)):
        raise ValueError(f"every vector must hold {dims} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column of equal widths as a matrix of its own type."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def list_column(rows: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    count, dims = rows.shape
    offsets = np.arange(0, (count + 1) * dims, dims, dtype=np.int32) if dims else np.zeros(count + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel(), kind))


def packed(rows: np.ndarray, size: int = BLOCK_ROWS) -> pa.Array:
    """The rows of a matrix as bytes, so many rows in a value: Spark copies such a value as a whole, where it takes a list
    number by number."""
    rows = np.ascontiguousarray(rows)
    return pa.array([rows[part].tobytes() for part in chunks(len(rows), size)], pa.binary())


def unpacked(column: pa.Array, width: int, kind: np.dtype = np.dtype(np.float64)) -> np.ndarray:
    """The matrix of a column made by `packed`."""
    if not len(column) or not width:
        return np.empty((0, width), kind)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def sparse(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse vector column as (offsets, indices, values)."""
    _, _, indices, values = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return (
        offsets,
        indices.flatten().to_numpy(zero_copy_only=False),
        values.flatten().to_numpy(zero_copy_only=False),
    )


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def squared_distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d2 = rows @ centers.T
    d2 *= -2.0
    d2 += np.einsum("ij,ij->i", rows, rows)[:, None]
    d2 += np.einsum("ij,ij->i", centers, centers)[None, :]
    return np.maximum(d2, 0.0, out=d2)


def chunks(rows: int, size: int = CHUNK_ROWS):
    for start in range(0, rows, size):
        yield slice(start, min(start + size, rows))


def parts(batches: Iterator[pa.RecordBatch], size: int = CHUNK_ROWS // 4) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones. Each row may hold hundreds of terms: what is computed for thousands of rows at once takes
    some hundred MB in each task, many times what it was read from."""
    for batch in batches:
        for part in chunks(batch.num_rows, size):
            yield batch.slice(part.start, part.stop - part.start)


def with_column(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    columns = [batch.column(name) for name in keep]
    return pa.RecordBatch.from_arrays(columns + list(new.values()), names=keep + list(new))
