"""Search for k, and the final model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from faultline.config import Config
from faultline.operators import kmeans, silhouette


@dataclass
class Sweep:
    fits: list[kmeans.Fit]
    rows: list[tuple[int, float, float]]  # k, inertia, silhouette

    @property
    def best_k(self) -> int:
        """The first k that reaches the highest silhouette."""
        return max(self.rows, key=lambda r: (r[2], -r[0]))[0]


def search(points: DataFrame, key: str, cfg: Config = Config()) -> Sweep:
    """Fit every k, then score each best model on one common sample. `points` holds key, row_hash, embedding."""
    models = [(k, r) for k in cfg.k_values for r in range(cfg.sweep_restarts)]
    fits = kmeans.fit_many(kmeans.points_of(points), models, cfg.seed, cfg.sweep_max_iter, cfg.tol)
    best = {k: kmeans.best_of(fits, k) for k in cfg.k_values}

    silhouette.check_sample(cfg.silhouette_sample, next(iter(best.values())).centers.shape[1])
    sample = silhouette.sample_rows(
        points.select(key, "row_hash", "embedding"), key, cfg.silhouette_sample, cfg.seed
    ).collect()
    block = np.array([r.embedding for r in sample], dtype=np.float64)
    labelings = {str(k): kmeans.nearest(block, fit.centers) for k, fit in best.items()}
    by_point = silhouette.point_scores(points.sparkSession, [r.row_hash for r in sample], block, labelings)
    mean = {r.labelling: r.silhouette for r in by_point.groupBy("labelling").agg(
        F.avg("silhouette").alias("silhouette")).collect()}
    return Sweep(fits, [(k, best[k].inertia, mean[str(k)]) for k in cfg.k_values])


def sweep_table(spark, sweep: Sweep) -> DataFrame:
    """One row per k. `at_edge` warns that the best k is the end of the range, so a better one may lie beyond."""
    best = sweep.best_k
    edges = (sweep.rows[0][0], sweep.rows[-1][0])
    return spark.createDataFrame(
        [(k, round(i, 6), round(s, 6), k == best, k == best and k in edges) for k, i, s in sweep.rows],
        "k int, inertia double, silhouette double, is_best boolean, at_edge boolean",
    )


def best_k(table: DataFrame, k_range: Sequence[int]) -> DataFrame:
    """The first row that reaches the highest silhouette of a (k, silhouette, ...) table."""
    low, high = min(k_range), max(k_range)
    return (
        table.orderBy(F.desc("silhouette"), "k")
        .limit(1)
        .withColumn("at_edge", F.col("k").isin(low, high))
    )


def final_fit(points: DataFrame, sweep: Sweep, k: int, cfg: Config = Config()) -> kmeans.Fit:
    """The best of `final_restarts` models. Restarts that converged in the sweep are the same models, so only the
    others are fitted."""
    ready = [f for f in sweep.fits if f.k == k and f.converged and f.restart < cfg.final_restarts]
    missing = [(k, r) for r in range(cfg.final_restarts) if r not in {f.restart for f in ready}]
    if missing:
        ready += kmeans.fit_many(kmeans.points_of(points), missing, cfg.seed, cfg.final_max_iter, cfg.tol)
    return kmeans.best_of(ready, k)
