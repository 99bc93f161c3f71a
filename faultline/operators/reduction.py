"""Adding up partial results of fixed size, which tasks return, in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Partial results that meet in one place, and numbers of one slice of them.
FAN_IN, SLICE = 16, 1 << 16

# Numbers go as bytes, which are copied as a whole.
_PARTIAL = "task long, slice int, numbers binary"


def _bytes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers, dtype=np.float64).tobytes()


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.float64) for x in column]


def batch_of(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    """What a task returns: one row per slice."""
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([_bytes(x) for x in found.values()], pa.binary())],
        names=["slice", "numbers"],
    )


def slices_of(numbers: np.ndarray) -> dict[int, np.ndarray]:
    """A long vector in slices of bounded size."""
    flat = numbers.ravel()
    return {i: flat[at : at + SLICE] for i, at in enumerate(range(0, max(len(flat), 1), SLICE))}


def joined(found: dict[int, np.ndarray]) -> np.ndarray:
    return np.concatenate([found[i] for i in range(len(found))])


def added(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def tree_reduced(
    rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    combine: Callable[[list[np.ndarray]], np.ndarray] = added,
) -> dict[int, np.ndarray]:
    """Apply `run` to the rows of each task; it returns `batch_of` its slices. Results of FAN_IN tasks at a time are
    combined, slice by slice, until FAN_IN are left at most, which the driver combines: what a task or the driver holds
    does not depend on the number of tasks. The order of additions is that of the tasks, whatever the shuffle does.
    """

    def merge(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("task")
        merged = combine(_numbers(ordered.column("numbers")))
        first = ordered.slice(0, 1)
        return first.set_column(2, "numbers", pa.array([_bytes(merged)], pa.binary()))

    tasks = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(run, "slice int, numbers binary")
    found = found.select(F.spark_partition_id().cast("long").alias("task"), "slice", "numbers")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        near = found.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long"))
        found = near.groupBy("task", "slice").applyInArrow(merge, _PARTIAL)
    table = found.toArrow().sort_by([("slice", "ascending"), ("task", "ascending")])
    parts: dict[int, list[np.ndarray]] = {}
    for number, values in zip(table.column("slice").to_pylist(), _numbers(table.column("numbers"))):
        parts.setdefault(number, []).append(values)
    return {number: combine(each) for number, each in parts.items()}
