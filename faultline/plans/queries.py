"""Every operator as a named query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.config import Config, LABEL_SEVERITY
from faultline.functions import scalars, text as txt
from faultline.functions.stopwords import ENGLISH_STOP_WORDS
from faultline.operators import clusters, embed, features, kmeans, quality, silhouette, svd, sweep, tfidf, validate
from faultline.operators.quantiles import quantiles
from faultline.plans import reports, taxonomy
from faultline.schemas import WORK_ORDERS
from faultline.sources import tables, views
from faultline.sources.shared import fresh_path, materialise, spread

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

MIN_VECTORS = 50  # some of the ten vector labels fall below it
FILTERS = {
    "equipment_types": ["Type 1", "Type 3", "Type 5"],
    "severities": ["High", "Medium"],
    "locations": None,
}


def query(fn: Query) -> Query:
    _registry[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = views.table(spark, folder, "documents").select("doc_id", "text", "lang")
    return spread(docs)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def _long(df: DataFrame, *keys: str, vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.round("value", 6))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query
def scan_csv_roundtrip(spark, folder):
    orders = views.scored(spark, folder, with_location=True).select(*WORK_ORDERS.fieldNames())
    path = fresh_path(spark, "work_orders_csv")
    tables.write_csv(orders, path)
    return tables.read_csv(spark, path, WORK_ORDERS, escaped=True)


@query
def scan_csv_texts(spark, folder):
    """Whole documents as descriptions, line breaks and all."""
    orders = quality.with_score(views.text_work_orders(spark, folder)).withColumn("technician_id", F.lit("TECH-001"))
    path = fresh_path(spark, "text_orders_csv")
    tables.write_csv(orders.select(*WORK_ORDERS.fieldNames()), path)
    return tables.read_csv(spark, path, WORK_ORDERS, escaped=True).select(
        "record_id", "defect_description", "true_defect_label", "visit_date"
    )


@query
def scan_table(spark, folder):
    views.table(spark, folder, "supplier").createOrReplaceTempView("faultline_supplier")
    return tables.read_table(spark, "faultline_supplier").select("s_suppkey", "s_name", "s_acctbal")


@query
def sink_table_roundtrip(spark, folder):
    path = fresh_path(spark, "equipment_master")
    name = f"faultline_master_{path.split('/')[-2][:12]}"
    tables.write_table(views.equipment_master(spark, folder), name, path=path)
    out = tables.read_table(spark, name)
    spark.sql(f"DROP TABLE {name}")  # the rows are in the folder, which the result reads
    return out


@query
def small_dim_from_rows(spark, folder):
    dim = tables.rows_to_table(
        spark,
        [(f, s, float("nan") if f == "N" else 1.0) for f, s in views.FLAG_SEVERITY.items()],
        "l_returnflag string, severity string, weight double",
    )
    return (
        views.table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("records"))
        .join(F.broadcast(dim), "l_returnflag")
        .select("severity", "weight", "records")
    )


@query
def list_tables(spark, folder):
    found = {}
    for name in views.TABLES:
        view = f"faultline_src_{name}"
        views.table(spark, folder, name).createOrReplaceTempView(view)
        found[name] = spark.table(view)
    counts = tables.row_counts(found)
    listed = tables.list_tables(spark).select(F.regexp_extract("tableName", "^faultline_src_(.*)$", 1).alias("tbl"))
    return counts.join(listed, "tbl")


@query
def describe_schema(spark, folder):
    return tables.describe_schema(views.table(spark, folder, "lineitem")).drop("nullable")


@query
def list_files(spark, folder):
    files = tables.list_files(spark, folder, "*.parquet")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")


@query
def first_row(spark, folder):
    return tables.first_row(
        reports.defect_data(views.defect_features(spark, folder)).drop("location"),
        "record_id", "visit_date", "repair_duration_hrs", "downtime_hrs", "equipment_id",
    )


# --- projections, filters, predicates -------------------------------------------------------------------------------


@query
def quality_score(spark, folder):
    return views.scored(spark, folder).select("record_id", "equipment_id", "visit_date", "quality_score")


@query
def quality_filter_pass(spark, folder):
    kept, _ = quality.split(views.scored(spark, folder))
    return kept.select("record_id", "equipment_id", "quality_score")


@query
def quality_filter_reject(spark, folder):
    _, rejected = quality.split(views.scored(spark, folder))
    return rejected.select("record_id", "equipment_id", "quality_score")


@query
def quality_split(spark, folder):
    return quality.split_counts(views.scored(spark, folder))


@query
def feature_table(spark, folder):
    return views.defect_features(spark, folder, with_location=True)


@query
def derive_age(spark, folder):
    return views.equipment_master(spark, folder).select("equipment_id", "installation_year", "age_years")


@query
def severity_lookup(spark, folder):
    labels = list(LABEL_SEVERITY)
    names = F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("l_linenumber").cast("int"))
    return (
        views.table(spark, folder, "lineitem")
        .select(names.alias("label"))
        .withColumn("severity", scalars.lookup(F.col("label"), LABEL_SEVERITY))
        .groupBy("label", "severity")
        .agg(F.count(F.lit(1)).alias("records"))
    )


@query
def row_count_audit(spark, folder):
    feats = views.defect_features(spark, folder)
    return tables.row_counts(
        {
            "equipment_master": views.equipment_master(spark, folder),
            "work_orders": views.work_orders(spark, folder, with_location=False),
            "defect_features": feats,
            "equipment_cluster_agg": features.equipment_agg(feats),
        }
    )


@query
def format_ids(spark, folder):
    return views.table(spark, folder, "orders").select(
        scalars.padded_id("WO", F.col("o_orderkey"), 5).alias("record_id"),
        scalars.padded_id("EQ", F.col("o_custkey"), 4).alias("equipment_id"),
        scalars.padded_id("TECH", F.col("o_custkey") % 20 + 1, 3).alias("technician_id"),
    )


@query
def visit_dates(spark, folder):
    visit = scalars.offset_date("2022-01-01", F.col("o_orderkey") % 731)
    return views.table(spark, folder, "orders").select(
        "o_orderkey", visit.alias("visit_date"), scalars.iso_date(visit).alias("visit_text")
    )


@query
def nullable_when(spark, folder):
    return views.work_orders(spark, folder, with_location=False).select("record_id", "equipment_id", "days_to_failure")


# --- quality summaries ----------------------------------------------------------------------------------------------


@query
def quality_describe(spark, folder):
    return quality.describe(views.defect_features(spark, folder), "quality_score")


@query
def price_describe(spark, folder):
    return quality.describe(views.table(spark, folder, "lineitem"), "l_extendedprice", digits=2, few=False)


@query
def event_quantiles(spark, folder):
    """Of values with many decimals: the two values around each rank, and how far between them."""
    found = quantiles(views.table(spark, folder, "events"), "value", {"low": 0.01, "middle": 0.5, "high": 0.999})
    rows = found.select(F.expr("stack(3, 'low', low, 'middle', middle, 'high', high) AS (quantile, found)"))
    return rows.select("quantile", "found.lower", "found.upper", F.round("found.part", 6).alias("part"))


@query
def quality_histogram(spark, folder):
    return quality.histogram(views.scored(spark, folder), "quality_score")


@query
def event_histogram(spark, folder):
    return quality.histogram(views.table(spark, folder, "events"), "value")


@query
def date_range(spark, folder):
    return quality.date_range(views.work_orders(spark, folder, with_location=False))


@query
def run_summary(spark, folder):
    return taxonomy.run_summary(views.scored(spark, folder), 0.50, "true_defect_label", "cluster")


# --- equipment and reports ------------------------------------------------------------------------------------------


@query
def equipment_agg(spark, folder):
    return features.equipment_agg(views.defect_features(spark, folder))


@query
def top_equipment(spark, folder):
    return reports.top_equipment(features.equipment_agg(views.defect_features(spark, folder)))


@query
def report_equipment(spark, folder):
    agg = features.equipment_agg(views.defect_features(spark, folder))
    return reports.equipment_health(agg, views.equipment_master(spark, folder))


@query
def report_defect_data(spark, folder):
    return reports.defect_data(views.defect_features(spark, folder, with_location=True))


@query
def report_filtered(spark, folder):
    data = reports.filtered(views.defect_features(spark, folder, with_location=True), **FILTERS)
    return reports.defect_data(data)


@query
def filter_choices(spark, folder):
    return reports.filter_choices(views.defect_features(spark, folder, with_location=True))


@query
def report_monthly_trend(spark, folder):
    return reports.monthly_trend(views.defect_features(spark, folder))


@query
def report_kpis(spark, folder):
    return reports.kpis(views.defect_features(spark, folder))


@query
def report_by_cluster(spark, folder):
    return reports.by_cluster(views.defect_features(spark, folder))


@query
def report_by_severity(spark, folder):
    return reports.by_severity(views.defect_features(spark, folder))


@query
def report_downtime_by_type(spark, folder):
    return reports.downtime_by_type(views.defect_features(spark, folder))


@query
def report_quality_by_type(spark, folder):
    return reports.quality_by_type(views.defect_features(spark, folder))


# --- text -----------------------------------------------------------------------------------------------------------


def _words(df: DataFrame, column: str, words) -> DataFrame:
    return df.withColumn(column, words).select(
        "doc_id", F.size(column).alias("n"), F.array_join(column, "|").alias(column)
    )


@query
def tokenise(spark, folder):
    return _words(_documents(spark, folder), "tokens", txt.tokens(F.col("text")))


@query
def remove_stopwords(spark, folder):
    return _words(
        _documents(spark, folder), "words", txt.drop_stop_words(txt.tokens(F.col("text")), ENGLISH_STOP_WORDS)
    )


@query
def ngrams(spark, folder):
    docs = tfidf.with_terms(_documents(spark, folder), "text")
    return _words(docs, "terms", F.col("terms"))


@query
def tfidf_vocabulary(spark, folder):
    return tfidf.vocabulary(_documents(spark, folder), "text").withColumn("idf", F.round("idf", 6))


@query
def tfidf_weights(spark, folder):
    docs = _documents(spark, folder)
    model = tfidf.fit(docs, "text")
    return tfidf.long_weights(docs, "text", model, ["doc_id"]).withColumn("weight", F.round("weight", 6))


@query
def tfidf_transform(spark, folder):
    """Vocabulary of the documents, applied to the conversations."""
    model = tfidf.fit(_documents(spark, folder), "text")
    turns = views.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return tfidf.long_weights(turns, "text", model, ["conv_id", "turn"]).withColumn("weight", F.round("weight", 6))


def _top_terms(spark, folder):
    docs = _documents(spark, folder)
    model = tfidf.fit(docs, "text")
    weighted = tfidf.weights(docs, "text", model, ["doc_id", "lang"])
    return clusters.top_terms(weighted, "lang", tfidf.term_table(spark, model), Config().top_terms)


@query
def cluster_top_terms(spark, folder):
    return _top_terms(spark, folder).withColumn("score", F.round("score", 6))


@query
def cluster_term_labels(spark, folder):
    return clusters.term_labels(_top_terms(spark, folder), "lang", Config().label_terms)


@query
def embed_batched(spark, folder):
    embedded = embed.embed_batched(_documents(spark, folder), "text", ["doc_id"])
    return _long(embedded, "doc_id", vector="embedding")


@query
def svd_embed(spark, folder):
    built = taxonomy.embed_texts(_documents(spark, folder), "doc_id", "text")
    return _long(built.points, "doc_id", vector="embedding")


@query
def embedding_stats(spark, folder):
    built = taxonomy.embed_texts(_documents(spark, folder), "doc_id", "text")
    return built.points.agg(
        F.count(F.lit(1)).alias("documents"),
        F.lit(len(built.tfidf)).alias("vocabulary_size"),
        F.max(F.size("embedding")).alias("dims"),
        F.lit(round(built.svd.explained_variance, 6)).alias("explained_variance"),
    )


# --- vectors and clusters -------------------------------------------------------------------------------------------


@query
def l2_normalise(spark, folder):
    return _long(clusters.unit_vectors(_vectors(spark, folder), "embedding"), "vec_id", vector="embedding")


@query
def cluster_centroids(spark, folder):
    return _long(clusters.centroids(_vectors(spark, folder), "label", "embedding"), "label", vector="centroid")


@query
def nearest_centroid(spark, folder):
    vectors = _vectors(spark, folder)
    fitted = clusters.centroids(vectors, "label", "embedding").orderBy("label").collect()
    placed = kmeans.assign(vectors, np.array([r.centroid for r in fitted]), ["vec_id"])
    nearest = clusters.assigned_labels([r.label for r in fitted], F.col("cluster"))
    return placed.select("vec_id", nearest.alias("nearest"))


@query
def inertia(spark, folder):
    return clusters.inertia(_vectors(spark, folder), "label", "embedding").withColumn(
        "inertia", F.round("inertia", 6)
    )


@query
def silhouette_exact(spark, folder):
    points = silhouette.exact(_vectors(spark, folder), "vec_id", "embedding", ["label"])
    return silhouette.scores(points).select("silhouette", "rows")


@query
def silhouette_points(spark, folder):
    points = silhouette.exact(_vectors(spark, folder), "vec_id", "embedding", ["label"])
    return points.select(F.col("key").alias("vec_id"), F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_scalable(spark, folder):
    vectors = _vectors(spark, folder)
    value = silhouette.scalable(vectors, "embedding", "label")
    return vectors.agg(F.count(F.lit(1)).alias("rows")).withColumn("silhouette", F.lit(round(value, 6)))


@query
def best_k_from_sweep(spark, folder):
    """Labellings `label mod k` stand for the sweep; from k = 10 on they are equal, so the first must win."""
    ks = Config().k_values
    vectors = _vectors(spark, folder).select(
        "vec_id", "embedding", *[(F.col("label") % k).alias(f"k{k}") for k in ks]
    )
    points = silhouette.exact(vectors, "vec_id", "embedding", [f"k{k}" for k in ks])
    table = silhouette.scores(points).select(F.substring("labelling", 2, 9).cast("int").alias("k"), "silhouette")
    return sweep.best_k(table, ks)


@query
def cluster_sizes(spark, folder):
    return clusters.sizes(_vectors(spark, folder), "label")


@query
def small_clusters(spark, folder):
    return clusters.small(_vectors(spark, folder), "label", MIN_VECTORS)


@query
def merge_small_clusters(spark, folder):
    vectors = _vectors(spark, folder).select("vec_id", "label")
    return clusters.merge_small(vectors, "label", MIN_VECTORS)


def _renumbered(spark, folder):
    return clusters.reindex(_vectors(spark, folder).select("vec_id", "label"), "label", MIN_VECTORS)


@query
def reindex_clusters(spark, folder):
    return _renumbered(spark, folder)


@query
def cluster_names(spark, folder):
    """Both ways to a name: renumbered clusters (with "Other"), and raw labels beyond the fixed names."""
    named = clusters.with_names(_renumbered(spark, folder))
    return named.withColumn("raw_name", scalars.cluster_name(F.col("label"), Config().cluster_names))


@query
def final_cluster_count(spark, folder):
    return clusters.final_count(_renumbered(spark, folder))


@query
def cluster_membership(spark, folder):
    return clusters.membership(clusters.with_names(_renumbered(spark, folder)))


@query
def cluster_sizes_flagged(spark, folder):
    return clusters.sizes_flagged(clusters.with_names(_renumbered(spark, folder)))


@query
def ari(spark, folder):
    return validate.ari(validate.contingency(views.defect_features(spark, folder), "true_defect_label", "cluster"))


@query
def crosstab_normalised(spark, folder):
    cells = validate.contingency(views.defect_features(spark, folder), "true_defect_label", "defect_cluster_name")
    return validate.crosstab_cells(cells)


# --- fitted models --------------------------------------------------------------------------------------------------


def _points(spark, folder):
    vectors = clusters.unit_vectors(_vectors(spark, folder), "embedding")
    return materialise(kmeans.with_row_hash(spread(vectors), "vec_id", "embedding"), "vectors")


@query
def kmeans_step(spark, folder):
    """One pass of the fitting code from the means of the labels: members and new means."""
    vectors = _vectors(spark, folder)
    start = clusters.centroids(vectors, "label", "embedding").orderBy("label").collect()
    points = kmeans.points_of(kmeans.with_row_hash(vectors, "vec_id", "embedding"))
    members, means, _ = kmeans.step(points, np.array([r.centroid for r in start]))
    rows = [(r.label, int(n), m.tolist()) for r, n, m in zip(start, members, means)]
    found = spark.createDataFrame(rows, f"label {vectors.schema['label'].dataType.simpleString()}, members long, mean array<double>")
    return _long(found, "label", "members", vector="mean")


@query
def embedding_shape(spark, folder):
    """Documents, terms, and documents without any known term, which have the zero vector."""
    built = taxonomy.embed_texts(_documents(spark, folder), "doc_id", "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return built.points.agg(
        F.count(F.lit(1)).alias("documents"),
        F.lit(len(built.tfidf)).cast("long").alias("vocabulary_size"),
        F.count_if(norm == 0).alias("zero_vectors"),
        F.count_if((norm > 0) & (F.abs(norm - 1) > 1e-9)).alias("other_lengths"),
    )


@query
def svd_residual(spark, folder):
    """How far the products of the reduced rows are from the squared singular values, relative to the largest."""
    built = taxonomy.embed_texts(_documents(spark, folder), "doc_id", "text")
    rest = svd.second_moments(built.weights, built.svd) - np.diag(built.svd.singular_values**2)
    worst = np.abs(rest).max(axis=0) / built.svd.singular_values[0] ** 2
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(worst)], "component long, residual double")


@query
def kmeans_fit(spark, folder):
    """Ten restarts with k = 10: size and inertia of each cluster of the best one."""
    cfg, points = Config(), _points(spark, folder)
    models = [(10, r) for r in range(cfg.sweep_restarts)]
    best = kmeans.best_of(kmeans.fit_many(kmeans.points_of(points), models, cfg.seed, cfg.sweep_max_iter, cfg.tol), 10)
    placed = kmeans.assign(points, best.centers, ["vec_id", "embedding"])
    return clusters.inertia(placed, "cluster", "embedding").withColumn("inertia", F.round("inertia", 6))


@query
def kmeans_sweep(spark, folder):
    return sweep.sweep_table(spark, sweep.search(_points(spark, folder), "vec_id"))


@query
def sweep_checks(spark, folder):
    """For each k of the search: whether the inertia holds when plain expressions add it up over the placed rows, and
    whether it is the only best."""
    points = _points(spark, folder)
    total = points.count()
    found = sweep.search(points, "vec_id")
    rows = []
    for k, inertia, _ in found.rows:
        centers = kmeans.best_of(found.fits, k).centers
        placed = kmeans.assign(points, centers, ["vec_id", "embedding"])
        own = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
        squares = F.zip_with("embedding", "center", lambda x, c: (x - c) * (x - c))
        again = placed.join(F.broadcast(own), "cluster").agg(  # one row per center
            F.sum(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("inertia"), F.count("cluster").alias("placed")
        ).first()
        rows.append((k, abs(again.inertia - inertia) <= 1e-6 * inertia, again.placed == total, k == found.best_k))
    table = spark.createDataFrame(rows, "k long, inertia_holds boolean, all_placed boolean, is_best boolean")
    best = F.sum(F.col("is_best").cast("long")).over(Window.partitionBy())
    return table.select("k", "inertia_holds", "all_placed", best.alias("best_rows"))


@query
def cluster_precomputed(spark, folder):
    """The same search and final fit on vectors that came from elsewhere."""
    points = _points(spark, folder)
    found = sweep.search(points, "vec_id")
    final = sweep.final_fit(points, found, found.best_k)
    return kmeans.assign(points, final.centers, ["vec_id"])


@query
def projection_2d(spark, folder):
    """The first two reduced dimensions of each document, with its language as group."""
    docs = _documents(spark, folder)
    model = tfidf.fit(docs, "text")
    weights = materialise(tfidf.weights(docs, "text", model, ["doc_id", "lang"]), "tfidf")
    reduced = svd.fit(weights, len(model), Config().embedding_dims)
    return svd.embed(weights, reduced, ["doc_id", "lang"]).select(
        "doc_id",
        F.col("lang").alias("cluster_name"),
        F.round(F.col("embedding")[0], 6).alias("x"),
        F.round(F.col("embedding")[1], 6).alias("y"),
    )


def _published(spark, folder):
    """The whole job: both tables written and read back, its intermediates deleted."""
    result = taxonomy.build(views.text_work_orders(spark, folder))
    path = fresh_path(spark, "published")
    cfg, before = Config(schema=f"faultline_{path.split('/')[-2][:12]}"), spark.catalog.currentDatabase()
    try:
        feature_rows, equipment = taxonomy.publish(result, cfg, path)
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE IF EXISTS {cfg.schema} CASCADE")  # the rows are in the folder, which the results read
    return result, feature_rows, equipment


@query
def defect_taxonomy(spark, folder):
    result, feature_rows, _ = _published(spark, folder)
    result.close()
    return feature_rows


@query
def taxonomy_records(spark, folder):
    """What the job keeps of every record, but for the cluster."""
    return defect_taxonomy(spark, folder).drop("cluster", "defect_cluster_name")


@query
def pipeline_summary(spark, folder):
    """What the job reports at its end."""
    result, feature_rows, equipment = _published(spark, folder)
    row = taxonomy.summary(result)
    out = materialise(row.withColumn("equipment", F.lit(equipment.count())), "summary")
    result.close()
    return out
