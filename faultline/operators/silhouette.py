"""Silhouette: exact and Euclidean on a bounded sample, and the linear squared form for any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions import arrays

# The exact form needs every pair of the sample, and the vectors of the sample go to the driver and to all tasks.
MAX_SAMPLE_BYTES = 256 << 20


def sample_rows(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """A repeatable uniform sample of exactly `min(size, rows)` rows: the first by a hash of key and seed. Every task
    keeps its first rows while it reads; nothing is sorted as a whole."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(size).drop("_draw")


def check_sample(size: int, dims: int) -> None:
    """Refuse a sample setting whose vectors would not be small, whatever the number of rows that there are."""
    if size * dims * 8 > MAX_SAMPLE_BYTES:
        raise ValueError(f"{size} vectors of {dims} numbers are more than {MAX_SAMPLE_BYTES >> 20} MB; take a smaller sample")


def _distances(x: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Differences, not the expanded square: the distance of a row to itself must be an exact zero."""
    return np.stack([np.sqrt(((block - row) ** 2).sum(axis=1)) for row in x])


def _point_scores(distances: np.ndarray, own: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Silhouette of rows with labels `own` from their distances to the whole sample; a lone member of a cluster gets 0."""
    member = np.zeros((len(labels), k))
    member[np.arange(len(labels)), labels] = 1.0
    sizes = member.sum(axis=0)
    sums = distances @ member
    mine = np.arange(len(own))
    a = sums[mine, own] / np.maximum(sizes[own] - 1, 1)
    others = np.divide(sums, sizes, out=np.full_like(sums, np.inf), where=sizes > 0)
    others[mine, own] = np.inf
    b = others.min(axis=1)
    scale = np.maximum(a, b)
    return np.where((sizes[own] > 1) & np.isfinite(b) & (scale > 0), (b - a) / np.where(scale > 0, scale, 1.0), 0.0)


def point_scores(
    spark: SparkSession, keys: Sequence[int], block: np.ndarray, labelings: dict[str, Sequence]
) -> DataFrame:
    """Score the sampled rows under each labelling: (labelling, key, cluster position, silhouette).

    Each task compares its own slice of the sample with the whole of it, and returns one number per row.
    """
    names = list(labelings)
    coded = [np.unique(np.asarray(labelings[n]), return_inverse=True) for n in names]
    shared = spark.sparkContext.broadcast((np.asarray(keys), block, [(c, len(u)) for u, c in coded]))
    tasks = max(1, min(len(keys), spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, all_rows, codes = shared.value
        for batch in batches:
            positions = batch.column(0).to_numpy()
            for part in arrays.chunks(len(positions), 256):
                at = positions[part]
                distances = _distances(all_rows[at], all_rows)  # the same for every labelling
                for name, (labels, k) in zip(names, codes):
                    scores = _point_scores(distances, labels[at], labels, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at)), pa.array(ids[at]), pa.array(labels[at], pa.int32()), pa.array(scores)],
                        names=["labelling", "key", "position", "silhouette"],
                    )

    return spark.range(0, len(keys), 1, tasks).mapInArrow(
        run, "labelling string, key bigint, position int, silhouette double"
    )


def exact(
    df: DataFrame, key: str, vector: str, labels: Sequence[str], sample_size: int = 2000, seed: int = 42
) -> DataFrame:
    """Exact Euclidean silhouette of each sampled row, for every labelling column in `labels`."""
    width = df.select(F.size(vector)).first()
    check_sample(sample_size, width[0] if width else 0)
    rows = (
        sample_rows(df.select(key, vector, *labels), key, sample_size, seed)
        .orderBy(key)
        .collect()
    )
    block = np.array([r[vector] for r in rows], dtype=np.float64)
    return point_scores(df.sparkSession, [r[key] for r in rows], block, {c: [r[c] for r in rows] for c in labels})


def scores(points: DataFrame) -> DataFrame:
    """Mean silhouette per labelling."""
    return points.groupBy("labelling").agg(
        F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count(F.lit(1)).alias("rows")
    )


def scalable(df: DataFrame, vector: str, label: str) -> float:
    """Squared Euclidean silhouette from cluster moments: linear in the rows, and another number than `exact`."""
    ready = df.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("prediction"),
    )
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(ready)
