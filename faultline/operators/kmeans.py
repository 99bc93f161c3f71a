"""K-means for many (k, restart) pairs at once.

A sweep of ten values of k with ten restarts is a hundred models. Fitted one by one they would read the vectors some
thousands of times. Here every pass over the vectors serves all models that have not converged yet, so the number of
passes is that of the slowest single model. A pass is one Spark job: tasks reduce their rows to partial sums per
center, which are added up in a tree.

Of long vectors every pass takes products of the rows with the centers of all models, and sums by products again: that
costs less than to read what would be kept of each row and model, and to look at it.

Of short vectors most distances are never computed. In an anchor pass all rows are placed, and each keeps, per model, its
center, its distance to it and to the second nearest one. In the passes after it a row stays where it is if the centers have
not drifted far enough since to change that (triangle inequality), or if it is nearer to its center than half the way from
there to any other center; if not, its own distance comes first, and only those to centers that it leaves possible follow.
Sums change only by the rows that moved. When half as many distances have been computed as an anchor pass costs, the next
pass is an anchor again. An anchor is kept in the executors' caches and made from the vectors alone, so what a lost executor
held of it comes back from there.

Vectors and anchors are kept as bytes, many rows in a value, and centers are compared line by line over many rows at once: a
pass costs little more than its products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from faultline.functions import arrays
from faultline.operators.reduction import batch_of, joined, slices_of, tree_reduced
from faultline.sources.shared import fewer_tasks

#: A new anchor is made when this share of all distances has been computed since the last one.
RENEWED = 0.5

#: Numbers of a vector from which products with all centers are the faster way to settle rows than what is known of each.
WIDE = 32

#: Centers of several models that go into one product with a chunk of rows.
STACKED = 128

_MASK = (1 << 64) - 1


@dataclass
class Fit:
    """One model: its centers, its inertia, and how it was reached."""

    k: int
    restart: int
    centers: np.ndarray
    inertia: float = float("nan")
    iterations: int = 0
    converged: bool = False
    distances: int = 0  # computed in its iterations; placing every row anew each time takes rows x k x iterations


def with_row_hash(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Random draws depend on this hash of key and vector, not on the partitioning. Rows that share a key, or have none,
    race on their own; only rows that are equal in both draw together."""
    return df.withColumn("row_hash", F.xxhash64(key, vector))


def points_of(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The two columns that training reads."""
    return df.select("row_hash", F.col(vector).cast("array<double>").alias("embedding"))


def _mix(x: int) -> int:
    """A fixed 64-bit mixing of the draw number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _uniforms(row_hash: np.ndarray, stream: int) -> np.ndarray:
    """One draw in (0, 1) per row."""
    with np.errstate(over="ignore"):
        x = row_hash.astype(np.uint64) ^ np.uint64(stream)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _stream(seed: int, fit: Fit, step: int) -> int:
    x = _mix(seed)
    for part in (fit.k, fit.restart, step):
        x = _mix(x ^ part)
    return x


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("embedding")
    return arrays.dense(column, dims) if pa.types.is_list(column.type) else arrays.unpacked(column, dims)


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("row_hash")
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return arrays.unpacked(column, 1, np.dtype(np.int64))[:, 0]


def _packed(points: DataFrame, dims: int) -> DataFrame:
    """The points as bytes, many in a row, which every pass copies from the cache as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = arrays.packed(_hashes(batch).astype(np.int64, copy=False))
            yield pa.RecordBatch.from_arrays([hashes, arrays.packed(_rows(batch, dims))], names=["row_hash", "embedding"])

    return points.select("row_hash", "embedding").mapInArrow(run, "row_hash binary, embedding binary")


def _draw_centers(
    points: DataFrame, fits: Sequence[Fit], seed: int, step: int, dims: int
) -> None:
    """One k-means++ step for every model: draw a row with probability proportional to its squared distance from
    the centers drawn so far.

    The draw is an exponential race: the row with the smallest -log(u) / weight wins, so a task only has to report
    its own winner per model.
    """
    streams = [_stream(seed, f, step) for f in fits]
    drawn = len(fits[0].centers)
    some = max(1, STACKED // max(drawn, 1))  # models whose centers go into one product
    shared = points.sparkSession.sparkContext.broadcast(np.vstack([f.centers for f in fits]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        best = np.full(len(streams), np.inf)
        winner: list[np.ndarray | None] = [None] * len(streams)
        for batch in batches:
            rows = _rows(batch, dims)
            hashes = _hashes(batch)
            for part in arrays.chunks(len(rows)):
                x, h = rows[part], hashes[part]
                norms = np.einsum("ij,ij->i", x, x)
                for first in range(0, len(streams), some):
                    block = centers[first * drawn : (first + some) * drawn]
                    near = _scores(x, block).reshape(-1, drawn, len(x)).min(axis=1) + norms if drawn else None
                    for m, stream in enumerate(streams[first : first + some], first):
                        race = -np.log(_uniforms(h, stream))
                        if drawn:
                            away = near[m - first]
                            race = np.divide(race, away, out=np.full(len(x), np.inf), where=away > 1e-12)
                        i = int(race.argmin())
                        if winner[m] is None or race[i] < best[m]:
                            best[m], winner[m] = race[i], x[i].copy()
        found = [m for m, w in enumerate(winner) if w is not None]
        if found:
            yield batch_of({m: np.concatenate([[best[m]], winner[m]]) for m in found})

    # A slice is a model, its numbers are the race and then the center; the least race wins.
    found = tree_reduced(points, run, lambda parts: min(parts, key=lambda x: x[0]))
    for m, fit in enumerate(fits):
        fit.centers = np.vstack([fit.centers, found[m][1:]])
    shared.destroy()


def _scores(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less the squared length of the row, one line per center: lines are compared as a whole."""
    return (-2.0 * centers) @ x.T + np.einsum("ij,ij->i", centers, centers)[:, None]


def _two_nearest(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, score and score of the second nearest center, infinite where there is none; the first one on a tie."""
    best, second = scores[0].copy(), np.full(scores.shape[1], np.inf)
    label = np.zeros(scores.shape[1], np.int32)
    for j in range(1, len(scores)):
        np.putmask(label, scores[j] < best, j)
        np.minimum(second, np.maximum(best, scores[j]), out=second)
        np.minimum(best, scores[j], out=best)
    return label, best, second


def _nearest_shares(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of the nearest center, and whether it is each one; the first one on a tie."""
    best = scores.min(axis=0)
    share = scores == best
    if np.count_nonzero(share) != len(best):
        share = share.argmax(axis=0) == np.arange(len(scores))[:, None]
    return best, share


def _sums(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Rows and vector sum of each center, side by side, from the share of each row in each center."""
    return np.column_stack([share.sum(axis=1), share @ x])


def _shares(labels: np.ndarray, k: int) -> np.ndarray:
    return (labels == np.arange(k, dtype=labels.dtype)[:, None]).astype(np.float64)


def _groups(cuts: Sequence[slice]) -> Iterator[tuple[int, int, slice]]:
    """Neighbouring models whose centers go into one product, and where these lie: from, to, centers."""
    first = 0
    for m in range(1, len(cuts) + 1):
        if m == len(cuts) or cuts[m].stop - cuts[first].start > STACKED:
            yield first, m, slice(cuts[first].start, cuts[m - 1].stop)
            first = m


def _cuts(fits: Sequence[Fit]) -> list[slice]:
    """Where the centers of each model lie in a stack of all centers."""
    ends = np.cumsum([len(f.centers) for f in fits])
    return [slice(int(end) - len(f.centers), int(end)) for f, end in zip(fits, ends)]


def _pass(points: DataFrame, fits: Sequence[Fit], dims: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Members, vector sums and inertia of each model under its present centers, from all distances."""
    cuts, total = _cuts(fits), sum(len(f.centers) for f in fits)
    shared = points.sparkSession.sparkContext.broadcast(np.vstack([f.centers for f in fits]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, out, cost = shared.value, np.zeros((total, dims + 1)), np.zeros(len(cuts))
        for batch in batches:
            rows = _rows(batch, dims)
            for part in arrays.chunks(len(rows)):
                x = rows[part]
                norms = np.einsum("ij,ij->i", x, x)
                for first, last, block in _groups(cuts):
                    scores = _scores(x, centers[block])
                    share = np.empty(scores.shape)
                    for m in range(first, last):
                        lines = slice(cuts[m].start - block.start, cuts[m].stop - block.start)
                        best, share[lines] = _nearest_shares(scores[lines])
                        cost[m] += np.maximum(best + norms, 0.0).sum()
                    out[block] += _sums(x, share)
        yield batch_of(slices_of(np.concatenate([out.ravel(), cost])))

    found = joined(tree_reduced(points, run))
    block, cost = found[: total * (dims + 1)].reshape(total, dims + 1), found[total * (dims + 1) :]
    shared.destroy()
    return [(block[c, 0], block[c, 1:], float(cost[m])) for m, c in enumerate(cuts)]


@dataclass
class _Anchor:
    """Rows placed under the centers of one pass: for each model label, distance and distance to the second nearest."""

    rows: DataFrame  # many rows in one: embedding, and placed: three lines of one number of four bytes per model
    models: list[Fit]
    centers: list[np.ndarray]
    members: list[np.ndarray]
    sums: list[np.ndarray]
    spent: int = 0  # distances computed since

    def close(self) -> None:
        self.rows.unpersist()


def _slack(norms: np.ndarray, centers: np.ndarray) -> float:
    """More than a distance can be off that was computed from products."""
    largest = norms.max(initial=0.0) + np.einsum("ij,ij->i", centers, centers).max(initial=0.0)
    return 8.0 * float(np.sqrt(np.finfo(float).eps * largest))


@dataclass(frozen=True)
class _Bounds:
    """What a pass knows of one model: its centers; how far each, and the farthest other one, are from those of the anchor;
    how far they are from each other."""

    centers: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, centers: np.ndarray, before: np.ndarray) -> _Bounds:
        gaps = np.sqrt(arrays.squared_distances(centers, centers))
        np.fill_diagonal(gaps, np.inf)
        drift = np.sqrt(((centers - before) ** 2).sum(axis=1))
        others = np.full(len(drift), drift.max())
        others[drift.argmax()] = np.sort(drift)[-2] if len(drift) > 1 else 0.0
        return cls(centers, drift, others, gaps)

    def moved(
        self, x: np.ndarray, norms: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows whose label is another one now, these labels, and the number of distances computed, from label and bounds
        under the anchor's centers."""
        c, slack = self.centers, _slack(norms, self.centers)
        safe = np.maximum(lower - self.others[own], self.gaps.min(axis=1)[own] / 2) - slack
        at = np.flatnonzero(upper + self.drift[own] >= safe)
        near, mine = x[at], own[at]
        apart, here = near - c[mine], np.arange(len(at))
        exact = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        # Of the other centers only those matter that may have come nearer than the own one.
        reach = (exact + slack)[:, None]
        may = (lower[at, None] - self.drift <= reach) & (self.gaps[mine] <= exact[:, None] + reach)
        may[here, mine], may[exact < safe[at]] = False, False
        row, center = np.nonzero(may)
        found = np.full(may.shape, np.inf)
        found[here, mine] = exact
        found[row, center] = np.sqrt(((near[row] - c[center]) ** 2).sum(axis=1))
        label = found.argmin(axis=1)
        left = np.flatnonzero(label != mine)
        return at[left], label[left], len(at) + len(row)


def _anchor(points: DataFrame, fits: Sequence[Fit], dims: int, rows: int) -> _Anchor:
    """Place all rows, keep the result, and take members and sums of each model from it."""
    cuts, total = _cuts(fits), sum(len(f.centers) for f in fits)
    shared = points.sparkSession.sparkContext.broadcast(np.vstack([f.centers for f in fits]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            rows = _rows(batch, dims)
            for part in arrays.chunks(len(rows)):
                x = rows[part]
                norms = np.einsum("ij,ij->i", x, x)
                state = np.empty((3, len(cuts), len(x)), np.int32)
                for first, last, block in _groups(cuts):
                    scores = _scores(x, centers[block])
                    for m in range(first, last):
                        lines = scores[cuts[m].start - block.start : cuts[m].stop - block.start]
                        state[0, m], best, second = _two_nearest(lines)
                        # Kept in half the space, rounded to the safe side.
                        for line, score, side in ((1, best, np.inf), (2, second, -np.inf)):
                            distance = np.sqrt(np.maximum(score + norms, 0.0)).astype(np.float32)
                            state[line, m] = np.nextafter(distance, np.float32(side)).view(np.int32)
                by_row = state.reshape(-1, len(x)).T
                yield pa.RecordBatch.from_arrays([arrays.packed(x), arrays.packed(by_row)], names=["embedding", "placed"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((total, dims + 1))
        for batch in batches:
            for x, state in _placed_chunks(batch, dims, len(cuts)):
                for first, last, block in _groups(cuts):
                    share = [_shares(state[0, m], cuts[m].stop - cuts[m].start) for m in range(first, last)]
                    out[block] += _sums(x, np.vstack(share))
        yield batch_of(slices_of(np.concatenate([out.ravel(), np.zeros(len(cuts))])))

    placed = points.select("embedding").mapInArrow(place, "embedding binary, placed binary").persist()
    members, sums = _taken(joined(tree_reduced(placed, summed)), fits, dims)
    for fit in fits:
        fit.distances += rows * fit.k
    return _Anchor(placed, list(fits), [f.centers.copy() for f in fits], members, sums)


def _placed_chunks(batch: pa.RecordBatch, dims: int, models: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, and their state: line by model by row, so that what is known for one model lies together."""
    rows, state = _rows(batch, dims), arrays.unpacked(batch.column("placed"), 3 * models, np.dtype(np.int32))
    for part in arrays.chunks(len(rows)):
        yield rows[part], np.ascontiguousarray(state[part].T).reshape(3, models, -1)


def _places(anchor: _Anchor, fits: Sequence[Fit]) -> list[int]:
    return [next(i for i, g in enumerate(anchor.models) if g is f) for f in fits]


def _taken(found: np.ndarray, fits: Sequence[Fit], dims: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members and sums by model; the distances are added to the models' counts."""
    cuts, total = _cuts(fits), sum(len(f.centers) for f in fits)
    block = found[: total * (dims + 1)].reshape(total, dims + 1)
    for fit, n in zip(fits, found[total * (dims + 1) :]):
        fit.distances += int(n)
    return [block[c, 0] for c in cuts], [block[c, 1:] for c in cuts]


def _moved(anchor: _Anchor, fits: Sequence[Fit], dims: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members and vector sums of each model under its present centers, by the rows that left the anchor's labels."""
    cuts, total, at = _cuts(fits), sum(len(f.centers) for f in fits), _places(anchor, fits)
    known = [_Bounds.of(f.centers, anchor.centers[i]) for f, i in zip(fits, at)]
    shared = anchor.rows.sparkSession.sparkContext.broadcast(known)
    models = len(anchor.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, spent = np.zeros((total, dims + 1)), np.zeros(len(cuts))
        for batch in batches:
            for x, state in _placed_chunks(batch, dims, models):
                norms = np.einsum("ij,ij->i", x, x)
                for m, (cut, bounds) in enumerate(zip(cuts, shared.value)):
                    own, upper, lower = state[0, at[m]], *state[1:, at[m]].view(np.float32)
                    left, label, n = bounds.moved(x, norms, own, upper, lower)
                    spent[m] += n
                    if len(left):
                        k = cut.stop - cut.start
                        out[cut] += _sums(x[left], _shares(label, k) - _shares(own[left], k))
        yield batch_of(slices_of(np.concatenate([out.ravel(), spent])))

    before = sum(f.distances for f in fits)
    members, sums = _taken(joined(tree_reduced(anchor.rows, run)), fits, dims)
    shared.destroy()
    anchor.spent += sum(f.distances for f in fits) - before
    return [anchor.members[i] + x for i, x in zip(at, members)], [anchor.sums[i] + x for i, x in zip(at, sums)]


def fit_many(
    points: DataFrame,
    models: Sequence[tuple[int, int]],
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> list[Fit]:
    """Fit one model per (k, restart). `points` is read three times; the passes read the vectors as bytes, from a cache."""
    if points.isEmpty():
        raise ValueError("there are no vectors to cluster")
    points = fewer_tasks(points)
    spread = points.agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("embedding")).alias("s")
    ).first().s
    n, dims = spread["count"], len(spread["variance"])
    limit = tol * float(spread["variance"].toArray().mean()) * (n - 1) / n
    fits = [Fit(k, r, np.empty((0, dims))) for k, r in models]

    vectors = _packed(points, dims).persist()
    try:
        _train(vectors, fits, seed, max_iter, limit, n, dims)
        for fit, (_, _, inertia) in zip(fits, _pass(vectors, fits, dims)):
            fit.inertia = inertia
    finally:
        vectors.unpersist()
    return fits


def _train(points: DataFrame, fits: list[Fit], seed: int, max_iter: int, limit: float, n: int, dims: int) -> None:
    """Draw the first centers of all models, and pass over the vectors until every model has converged."""
    for step in range(max(f.k for f in fits)):
        _draw_centers(points, [f for f in fits if f.k > step], seed, step, dims)

    active, anchor = [f for f in fits if f.iterations < max_iter], None
    while active:
        if dims >= WIDE:
            whole = _pass(points, active, dims)
            found = [x[0] for x in whole], [x[1] for x in whole]
            for fit in active:
                fit.distances += n * fit.k
        elif anchor is None or anchor.spent >= RENEWED * n * sum(f.k for f in active):
            last, anchor = anchor, _anchor(points, active, dims, n)
            found = anchor.members, anchor.sums
            if last:
                last.close()
        else:
            found = _moved(anchor, active, dims)
        for fit, members, sums in zip(active, *found):
            kept = members > 0  # a center without members stays where it is
            moved = fit.centers.copy()
            moved[kept] = sums[kept] / members[kept, None]
            fit.converged = float(((moved - fit.centers) ** 2).sum()) <= limit
            fit.centers = moved
            fit.iterations += 1
        active = [f for f in active if not f.converged and f.iterations < max_iter]
    if anchor:
        anchor.close()


def step(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Members and mean of each center's rows, and the inertia, after one pass from given centers."""
    fit = Fit(len(centers), 0, np.asarray(centers, dtype=np.float64))
    ((members, sums, inertia),) = _pass(points, [fit], fit.centers.shape[1])
    means = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], fit.centers)
    return members.astype(int), means, inertia


def best_of(fits: Sequence[Fit], k: int) -> Fit:
    return min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.restart))


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center; the first one on a tie."""
    labels = np.empty(len(rows), np.int32)
    for part in arrays.chunks(len(rows)):
        labels[part] = arrays.squared_distances(rows[part], centers).argmin(axis=1)
    return labels


def assign(df: DataFrame, centers: np.ndarray, keep: Sequence[str], vector: str = "embedding") -> DataFrame:
    """`keep` and `cluster`, the nearest center. Narrow: the centers go to the rows."""
    keep = list(keep)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))
    extra = [] if vector in keep else [vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            labels = nearest(arrays.dense(batch.column(vector), centers.shape[1]), centers)
            yield arrays.with_column(batch, keep, cluster=pa.array(labels, pa.int32()))

    schema = StructType([df.schema[c] for c in keep] + [StructField("cluster", IntegerType())])
    return df.select(*keep, *extra).mapInArrow(run, schema)
