"""Vector operators and fitted models: brute force on small frames, invariants elsewhere."""

import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from faultline.config import Config
from faultline.functions import arrays
from faultline.operators import clusters, kmeans, reduction, silhouette, svd, sweep, tfidf
from faultline.operators.embed import embed_batched, hashing_embedder
from faultline.plans import taxonomy
from faultline.schemas import DEFECT_FEATURES
from faultline.sources import views

FOLDER = "/root/testdata/sf0.001"


def blobs(spark, per=40, centers=5, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 6, (centers, dims))
    x = np.concatenate([m + rng.normal(0, 0.6, (per, dims)) for m in middle])
    rows = [(i, v.tolist(), i // per) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(4, "id")
    return kmeans.with_row_hash(df, "id", "embedding"), x


def test_dense_rejects_wrong_width():
    with pytest.raises(ValueError):
        arrays.dense(pa.array([[1.0, 2.0], [3.0]]), 2)
    with pytest.raises(ValueError):
        arrays.dense(pa.array([[1.0, 2.0], None]), 2)


def test_unit_vectors_keep_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    got = {r.id: list(r.v) for r in clusters.unit_vectors(df, "v").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_draws_do_not_depend_on_partitioning(spark):
    df, _ = blobs(spark)
    a, b = (kmeans.fit_many(kmeans.points_of(p), [(5, 0), (4, 1)], seed=3) for p in (df, df.repartition(2, "label")))
    for x, y in zip(a, b):
        assert np.allclose(x.centers, y.centers) and x.inertia == pytest.approx(y.inertia)


def test_rows_with_equal_or_missing_keys_draw_on_their_own(spark):
    """Two groups of vectors under one key each, and without any key: the first center is uniform over the rows."""
    rows = [(key, [float(i), 0.0]) for key in ("same", None) for i in range(8)]
    df = kmeans.with_row_hash(spark.createDataFrame(rows, "k string, embedding array<double>"), "k", "embedding")
    assert df.select("row_hash").distinct().count() == 16
    fits = [kmeans.Fit(1, r, np.empty((0, 2))) for r in range(400)]
    kmeans._draw_centers(kmeans.points_of(df), fits, 1, 0, 2)
    hits = np.bincount([int(f.centers[0][0]) for f in fits], minlength=8)
    assert hits.min() >= 25 and hits.max() <= 80  # 50 expected each; five deviations are 33


def test_fit_finds_separated_groups_and_reports_its_inertia(spark):
    df, x = blobs(spark)
    best = kmeans.best_of(kmeans.fit_many(kmeans.points_of(df), [(5, r) for r in range(6)]), 5)
    placed = {r.id: r.cluster for r in kmeans.assign(df, best.centers, ["id"]).collect()}
    assert len(placed) == len(x) and len({(i // 40, c) for i, c in placed.items()}) == 5
    d2 = ((x[:, None] - best.centers[None]) ** 2).sum(-1)
    assert best.inertia == pytest.approx(d2.min(1).sum())


def test_inertia_is_no_worse_than_the_built_in_estimator(spark):
    rows = views.table(spark, FOLDER, "embeddings").select("vec_id", "embedding")
    points = kmeans.points_of(kmeans.with_row_hash(rows, "vec_id", "embedding")).persist()
    ours = kmeans.best_of(kmeans.fit_many(points, [(8, r) for r in range(5)]), 8).inertia
    ready = points.select(array_to_vector("embedding").alias("features"))
    theirs = min(KMeans(k=8, seed=s, maxIter=300).fit(ready).summary.trainingCost for s in range(5))
    points.unpersist()
    assert ours <= theirs * 1.02


def plain_lloyd(x, centers, rounds):
    for _ in range(rounds):
        labels = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        centers = np.array([x[labels == j].mean(0) if (labels == j).any() else c for j, c in enumerate(centers)])
    return centers


@pytest.mark.parametrize("spread", [0.6, 6.0])
def test_skipped_distances_change_no_center(spark, spread):
    """Clear groups and none at all: centers as by placing every row in every pass, with half the distances at most."""
    rng = np.random.default_rng(7)
    x = np.concatenate([m + rng.normal(0, spread, (150, 6)) for m in rng.normal(0, 6, (8, 6))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(20, "id")
    points = kmeans.points_of(kmeans.with_row_hash(frame, "id", "embedding")).persist()
    starts = {}
    for rounds in (0, 400):
        for fit in kmeans.fit_many(points, [(k, r) for k in (1, 5, 8) for r in range(4)], max_iter=rounds, tol=1e-7):
            if not rounds:
                starts[fit.k, fit.restart] = fit.centers
                continue
            assert np.allclose(fit.centers, plain_lloyd(x, starts[fit.k, fit.restart], fit.iterations), atol=1e-9)
            starts[fit.k, fit.restart] = fit.distances, len(x) * fit.k * fit.iterations
    points.unpersist()
    computed, possible = np.sum(list(starts.values()), axis=0)
    assert computed <= possible / 2


def test_long_vectors_are_settled_by_products_and_kept_as_bytes(spark):
    """Vectors of WIDE numbers and more, without clear groups: the centers are those of plain passes, and what the passes
    read is bytes, not lists."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (700, kmeans.WIDE + 3))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3, "id")
    points = kmeans.points_of(kmeans.with_row_hash(frame, "id", "embedding"))
    packed = kmeans._packed(points, x.shape[1])
    assert dict(packed.dtypes)["embedding"] == "binary"
    models = [(1, 0), (4, 0), (60, 0), (90, 1)]
    starts = kmeans.fit_many(points, models, max_iter=0)
    for fit, start in zip(kmeans.fit_many(points, models, max_iter=9, tol=0.0), starts):
        assert np.allclose(fit.centers, plain_lloyd(x, start.centers, fit.iterations), atol=1e-9)
        assert fit.inertia == pytest.approx(((x[:, None] - fit.centers[None]) ** 2).sum(-1).min(1).sum())
    for (n, sums, cost), (m, again, same) in zip(*(kmeans._pass(p, starts, x.shape[1]) for p in (points, packed))):
        assert np.array_equal(n, m) and np.allclose(sums, again) and cost == pytest.approx(same)


def test_trees_of_tasks_add_in_order(spark, monkeypatch):
    def run(batches):
        total = sum(b.column(0).to_numpy().sum() for b in batches)
        yield reduction.batch_of({0: np.array([total]), 5: np.array([1.0, 2.0])})

    rows = spark.range(0, 1000, 1, 40)
    for fan in (2, 3, 16, 64):
        monkeypatch.setattr(reduction, "FAN_IN", fan)
        found = reduction.tree_reduced(rows, run)
        assert found[0].tolist() == [499500.0] and found[5].tolist() == [40.0, 80.0]


def test_more_centers_than_distinct_points(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "id long, embedding array<double>")
    (fit,) = kmeans.fit_many(kmeans.points_of(kmeans.with_row_hash(df, "id", "embedding")), [(4, 0)])
    assert fit.centers.shape == (4, 2) and fit.inertia == pytest.approx(0.0)


def test_no_vectors_is_an_error(spark):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        kmeans.fit_many(kmeans.points_of(kmeans.with_row_hash(df, "id", "embedding")), [(2, 0)])


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mates = [j for j in range(len(x)) if labels[j] == own and j != i]
        rest = [d[i, labels == c].mean() for c in set(labels) if c != own]
        out.append(0.0 if not mates else (min(rest) - d[i, mates].mean()) / max(min(rest), d[i, mates].mean()))
    return np.array(out)


def test_silhouette_with_a_single_member(spark):
    rng = np.random.default_rng(0)
    x, labels = rng.normal(size=(30, 3)), np.array([0] * 14 + [1] * 15 + [2])
    df = spark.createDataFrame(
        [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "id long, v array<double>, c int"
    )
    got = {r.key: r.silhouette for r in silhouette.exact(df, "id", "v", ["c"]).collect()}
    assert np.allclose([got[i] for i in range(30)], brute_silhouette(x, labels))


def test_sample_is_exact_in_size_repeatable_and_ordered_by_hash(spark):
    import hashlib

    df = spark.range(5000)
    got = sorted(r.id for r in silhouette.sample_rows(df, "id", 100, 42).collect())
    want = sorted(sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:100])
    assert got == want
    assert silhouette.sample_rows(df, "id", 6000, 42).count() == 5000


def test_best_k_takes_the_first_maximum():
    found = sweep.Sweep([], [(4, 9.0, 0.2), (5, 8.0, 0.5), (6, 7.0, 0.5), (7, 6.0, 0.1)])
    assert found.best_k == 5


def test_sweep_and_final_fit(spark):
    df, _ = blobs(spark)
    cfg = Config(k_values=(3, 4, 5, 6), sweep_restarts=6, final_restarts=8)
    found = sweep.search(df, "id", cfg)
    assert found.best_k == 5
    rows = sweep.sweep_table(spark, found).collect()
    assert [r.k for r in rows if r.is_best] == [5] and not any(r.at_edge for r in rows)
    assert [r.inertia for r in rows] == sorted((r.inertia for r in rows), reverse=True)
    final = sweep.final_fit(df, found, 5, cfg)
    assert final.inertia <= kmeans.best_of(found.fits, 5).inertia + 1e-9


def test_svd_matches_a_dense_factorisation(spark):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 9))) for i in range(60)], "id long, t string")
    model = tfidf.fit(df, "t", max_features=20)
    weighted = tfidf.weights(df, "t", model, ["id"]).persist()
    x = np.stack([r.tfidf.toArray() for r in weighted.orderBy("id").collect()])
    fitted = svd.fit(weighted, len(model), 4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fitted.singular_values, s[:4])
    assert np.allclose(np.abs(fitted.components.T @ vt[:4].T), np.eye(4), atol=1e-6)
    scores = x @ vt[:4].T
    assert fitted.explained_variance == pytest.approx(scores.var(0).sum() / x.var(0).sum())
    embedded = np.array([r.embedding for r in svd.embed(weighted, fitted, ["id"]).orderBy("id").collect()])
    want = arrays.unit_rows(x @ fitted.components)
    assert np.allclose(embedded, want)
    weighted.unpersist()


def test_products_of_reduced_rows_take_bounded_memory():
    """A batch of 10,000 rows of 300 terms: what was computed at once took 3.1 GB in a task."""

    class Found(Exception):
        pass

    def stop(run, schema):
        raise Found(run)

    rng, terms, rows, each = np.random.default_rng(4), 3000, 10_000, 300
    ids = np.concatenate([np.sort(rng.choice(terms, each, replace=False)) for _ in range(rows)]).astype(np.int32)
    weights, cuts = rng.random(rows * each), np.arange(0, rows * each + 1, each, dtype=np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (ids, weights)]
    kinds = [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, terms, np.int32))]
    column = pa.StructArray.from_arrays(kinds + lists, names=["type", "size", "indices", "values"])
    model = svd.SvdModel(rng.normal(size=(terms, 64)), np.ones(64), 0.0, rows)
    context = SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))
    frame = SimpleNamespace(
        sparkSession=SimpleNamespace(sparkContext=context), select=lambda c: SimpleNamespace(mapInArrow=stop)
    )
    with pytest.raises(Found) as found:
        svd.second_moments(frame, model)
    tracemalloc.start()
    (total,) = found.value.args[0](iter([pa.RecordBatch.from_arrays([column], names=["tfidf"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    dense = np.zeros((rows, terms))
    dense[np.repeat(np.arange(rows), each), ids] = weights
    want = (dense @ model.components).T @ (dense @ model.components)
    assert np.allclose(np.array(total.column(0)[0].as_py()).reshape(64, 64), want)


def test_weights_are_computed_for_few_rows_at_once(spark, monkeypatch):
    plain = tfidf.weigh

    def checked(counts, idf_of):
        assert len(counts) <= 1024
        return plain(counts, idf_of)

    df = spark.createDataFrame([(i, f"alpha beta gamma{i % 7} _x9 alpha") for i in range(3000)], "id long, t string").coalesce(1)
    model = tfidf.fit(df, "t")
    expected = {r.id: r.tfidf for r in tfidf.weights(df, "t", model, ["id"]).collect()}
    monkeypatch.setattr(tfidf, "weigh", checked)
    assert {r.id: r.tfidf for r in tfidf.weights(df, "t", model, ["id"]).collect()} == expected


def sparse_rows(spark, x, parts):
    """A matrix as a table of sparse vectors, in so many partitions."""
    rows = [(i, Vectors.sparse(x.shape[1], np.flatnonzero(r), r[np.flatnonzero(r)])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "tfidf"]).repartition(parts, "id")


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_block_iteration_finds_the_leading_vectors(spark, parts):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(150, 8)) * np.linspace(9, 4, 8)) @ rng.normal(size=(8, 90)) + rng.normal(size=(150, 90)) * 0.3
    fitted = svd.fit(sparse_rows(spark, x, parts), 90, 8, oversample=6)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(fitted.singular_values, s[:8], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(fitted.components.T * vt[:8], axis=1)), 1.0, atol=1e-6)
    scores = x @ fitted.components
    assert np.allclose(scores.T @ scores, np.diag(fitted.singular_values**2), atol=1e-6 * s[0] ** 2)
    assert fitted.explained_variance == pytest.approx(scores.var(0).sum() / x.var(0).sum())


def test_flat_spectra_lose_little(spark):
    x = np.random.default_rng(4).normal(size=(400, 120))
    fitted = svd.fit(sparse_rows(spark, x, 4), 120, 20)
    best = (np.linalg.svd(x, compute_uv=False)[:20] ** 2).sum()
    assert 0.985 * best < (fitted.singular_values**2).sum() <= best * (1 + 1e-9)


def test_no_rows_with_terms_and_more_terms_than_rows(spark):
    zero = svd.fit(sparse_rows(spark, np.zeros((4, 6)), 2), 6, 3)
    assert np.allclose(zero.singular_values, 0) and zero.explained_variance == 0.0 and zero.components.shape == (6, 3)
    x = np.random.default_rng(1).normal(size=(3, 50))
    few = svd.fit(sparse_rows(spark, x, 3), 50, 5)
    assert np.allclose(few.singular_values, [*np.linalg.svd(x, compute_uv=False), 0, 0], atol=1e-9)


def test_twenty_thousand_terms(spark):
    """Beyond any Gramian: the block has 20,000 x 12 numbers, a product of all terms would have 3.2 GB."""
    rng = np.random.default_rng(3)
    rows = [(i, Vectors.sparse(20_000, {int(t): 1.0 for t in {*rng.integers(0, 20_000, 30), i % 4}})) for i in range(300)]
    fitted = svd.fit(spark.createDataFrame(rows, ["id", "tfidf"]), 20_000, 4, oversample=8)
    assert fitted.components.shape == (20_000, 4)
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(4), atol=1e-9)
    assert {int(np.abs(c).argmax()) for c in fitted.components.T} == {0, 1, 2, 3}


def test_caps_are_in_bytes(spark, monkeypatch):
    with pytest.raises(ValueError, match="MB"):
        silhouette.check_sample(100_000, 1024)
    silhouette.check_sample(2000, 1024)
    with pytest.raises(ValueError, match="MB"):
        tfidf.fit(spark.createDataFrame([("a b",)], "t string"), "t", max_features=1_000_000)


def test_embedder_gets_whole_texts_in_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    def count_calls(texts):
        seen.add(1)
        assert len(texts) <= 64
        return hashing_embedder(texts)

    docs = views.table(spark, FOLDER, "documents").coalesce(1)
    rows = embed_batched(docs, "text", ["doc_id"], count_calls).collect()
    assert len(rows) == docs.count() and seen.value == -(-len(rows) // 64)
    norms = [np.linalg.norm(r.embedding) for r in rows]
    assert all(abs(n - 1) < 1e-9 or n == 0 for n in norms)


@pytest.fixture(scope="module")
def built(spark):
    cfg = Config(k_values=(4, 5, 6), sweep_restarts=3, final_restarts=4, embedding_dims=16, max_features=800)
    return taxonomy.build(views.text_work_orders(spark, FOLDER), cfg), cfg


def test_taxonomy_scores_every_kept_record(spark, built):
    result, cfg = built
    rows = result.features
    assert rows.columns == DEFECT_FEATURES.fieldNames()
    assert dict(rows.dtypes) == {f.name: f.dataType.simpleString() for f in DEFECT_FEATURES}
    total = views.table(spark, FOLDER, "documents").count()
    assert rows.count() + result.rejected.count() == total
    assert rows.filter(F.col("cluster").isNull() | (F.col("quality_score") < 0.5)).count() == 0
    sizes = {r.cluster: r.records for r in clusters.sizes(rows, "cluster").collect()}
    kept = sorted(c for c in sizes if c >= 0)
    assert kept == list(range(len(kept))) and all(sizes[c] >= cfg.min_cluster_size for c in kept)


def test_final_scoring_equals_the_training_labels(spark, built):
    """Records are scored again in one narrow pass; it must give what the models gave on the training vectors."""
    result, _ = built
    crowded = result.features.drop("cluster").withColumns({c: F.lit(c) for c in ("words", "terms", "tf")})
    again = taxonomy.predict(crowded, "defect_description", result.models)
    assert again.select("words", "terms", "tf").distinct().collect() == [("words", "terms", "tf")]
    moved = again.join(result.features.select("record_id", "cluster"), "record_id")
    assert {(r.cluster_raw, r.cluster) for r in moved.select("cluster_raw", "cluster").distinct().collect()} == {
        (raw, new) for raw, new in result.remap.items()
    }


def test_summary_of_a_run(spark, built):
    result, cfg = built
    (row,) = taxonomy.summary(result, cfg).collect()
    assert row.input_records == views.table(spark, FOLDER, "documents").count()
    assert row.kept_records == result.features.count() and row.best_k == result.sweep.best_k
    assert row.embedding_dims == 16 and row.final_clusters <= row.best_k


def test_taxonomy_with_vectors_of_another_model(spark):
    cfg = Config(k_values=(3, 4), sweep_restarts=2, final_restarts=2)
    orders = views.text_work_orders(spark, FOLDER)
    result = taxonomy.build(orders, cfg, hashing_embedder)
    assert dict(result.features.dtypes) == {f.name: f.dataType.simpleString() for f in DEFECT_FEATURES}
    kept = {r.record_id: r.days_to_failure for r in result.features.collect()}
    source = {r.record_id: r.days_to_failure for r in orders.collect()}
    assert kept == {k: source[k] for k in kept} and len(kept) + result.rejected.count() == len(source)
    assert result.models.centers.shape[1] == 64 and result.terms.count() > 0


def test_approximate_distinct_count_is_close(built):
    from faultline.operators.features import equipment_agg

    result, _ = built
    exact = {r.equipment_id: r.distinct_defects for r in result.equipment.collect()}
    sketch = {r.equipment_id: r.distinct_defects for r in equipment_agg(result.features, approximate=True).collect()}
    assert all(abs(exact[k] - sketch[k]) <= 1 for k in exact)


def test_published_tables_can_be_read_back(spark, built):
    result, cfg = built
    before = spark.catalog.currentDatabase()
    cfg = Config(schema="faultline_published")
    taxonomy.publish(result, cfg)
    assert spark.table("faultline_published.defect_features").count() == result.features.count()
    assert spark.table("faultline_published.equipment_cluster_agg").count() == 50
    spark.catalog.setCurrentDatabase(before)
    spark.sql("DROP DATABASE faultline_published CASCADE")


def test_taxonomy_terms_and_agreement(built):
    result, cfg = built
    ranked = result.terms.collect()
    assert max(r.rank for r in ranked) <= cfg.top_terms and -1 not in {r.cluster for r in ranked}
    assert -0.5 <= taxonomy.agreement(result.features).first().ari <= 1.0
    assert result.equipment.count() == 50


def test_terms_come_from_the_stored_weights(spark, built):
    result, cfg = built
    shown = result.terms._jdf.queryExecution().optimizedPlan().toString()
    assert "defect_description" not in shown and "Join" in shown
    texts = result.features.filter("cluster >= 0")
    again = clusters.top_terms(
        tfidf.weights(texts, "defect_description", result.models.tfidf, ["cluster"]), "cluster",
        tfidf.term_table(spark, result.models.tfidf), cfg.top_terms,
    )
    assert sorted(map(tuple, result.terms.collect())) == sorted(map(tuple, again.collect()))


def test_a_killed_job_goes_on_where_it_was(spark, monkeypatch):
    """The driver dies in the search; the rerun neither weighs texts nor factors again, and ends with the same rows."""
    cfg = Config(k_values=(3, 4), sweep_restarts=2, final_restarts=2, embedding_dims=8, max_features=300)
    orders = views.text_work_orders(spark, FOLDER)
    whole = taxonomy.build(orders, cfg)
    context, tracker, name = spark.sparkContext, spark.sparkContext.statusTracker(), f"restart-{time.time_ns()}"

    def jobs(group, run):
        context.setJobGroup(group, group)
        try:
            return run()
        finally:
            context._jsc.clearJobGroup()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(sweep, "search", killed)
        with pytest.raises(KeyboardInterrupt):
            jobs("first", lambda: taxonomy.build(orders, cfg, job=name))
    with monkeypatch.context() as patch:
        for module, step in ((tfidf, "fit"), (tfidf, "weights"), (svd, "fit")):
            patch.setattr(module, step, killed)
        second = jobs("second", lambda: taxonomy.build(orders, cfg, job=name))
    assert second.stages.reused == ["weights", "embedding"]
    with monkeypatch.context() as patch:
        patch.setattr(sweep, "search", killed)
        third = jobs("third", lambda: taxonomy.build(orders, cfg, job=name))
    assert third.stages.reused == ["weights", "embedding", "search", "final", "labels"]
    counts = [len(tracker.getJobIdsForGroup(g)) for g in ("first", "second", "third")]
    assert counts[2] < min(counts[0], counts[1]) / 2
    key = "record_id"
    for result in (second, third):
        assert result.features.orderBy(key).collect() == whole.features.orderBy(key).collect()
    assert taxonomy.build(orders, Config(**{**vars(cfg), "seed": 1}), job=name).stages.reused == []
    for result in (whole, third):
        result.close()
    assert not third.stages.finished("weights")
