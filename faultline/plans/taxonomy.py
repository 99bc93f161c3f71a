"""The composed job: score, filter, embed, cluster, name, validate, write.

Raw records are read by narrow plans: twice for the vocabulary, once for the term weights, and at the end to score
them with the fitted models. Only the term weights and the 64-wide embeddings are written in between. No
record is joined back to its vector: the last pass recomputes it, which costs less than a shuffle of whole records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from faultline.config import Config
from faultline.functions import arrays, words
from faultline.functions.scalars import lookup
from faultline.operators import clusters, embed, features, kmeans, quality, svd, sweep, tfidf, validate
from faultline.schemas import DEFECT_FEATURES
from faultline.sources.shared import materialise, spread
from faultline.sources.stages import Stages, fingerprint
from faultline.sources.tables import use_namespace, write_table

TEXT = "defect_description"


@dataclass(frozen=True)
class Models:
    """All fitted state. Its size depends on the settings, not on the data."""

    tfidf: tfidf.TfidfModel
    svd: svd.SvdModel | None
    centers: np.ndarray


@dataclass(frozen=True)
class Embedded:
    """Training data in the shared folder: `weights` holds record_id and tfidf, `points` record_id, row_hash and
    embedding."""

    tfidf: tfidf.TfidfModel
    svd: svd.SvdModel
    weights: DataFrame
    points: DataFrame


@dataclass(frozen=True)
class Taxonomy:
    models: Models
    sweep: sweep.Sweep
    remap: dict[int, int]
    features: DataFrame
    equipment: DataFrame
    rejected: DataFrame
    terms: DataFrame
    stages: Stages | None = None

    def close(self) -> None:
        """Delete what the job wrote for itself. The published tables do not need it."""
        if self.stages:
            self.stages.drop()


def embed_texts(texts: DataFrame, key: str, text: str, cfg: Config = Config()) -> Embedded:
    texts = spread(texts.select(key, text))
    vocabulary = tfidf.fit(texts, text, cfg.stop_words, cfg.max_features, cfg.min_df)
    weights = materialise(tfidf.weights(texts, text, vocabulary, [key]), "tfidf")
    reduced = svd.fit(weights, len(vocabulary), cfg.embedding_dims)
    points = materialise(kmeans.with_row_hash(svd.embed(weights, reduced, [key]), key, "embedding"), "embedding")
    return Embedded(vocabulary, reduced, weights, points)


def predict(df: DataFrame, text: str, models: Models) -> DataFrame:
    """Add `cluster_raw` to whole records: text to cluster in one Arrow step."""
    keep = df.columns
    counter = tfidf.Counter(df.sparkSession, models.tfidf)
    shared = df.sparkSession.sparkContext.broadcast(
        (counter, np.array(models.tfidf.idf), models.svd.components, models.centers)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, idf_of, components, centers = shared.value
        for part in words.text_parts(batches, "_lower"):
            rows = svd.project(*tfidf.weigh(counter(part.column("_lower")), idf_of), components)
            yield arrays.with_column(part, keep, cluster_raw=pa.array(kmeans.nearest(rows, centers), pa.int32()))

    schema = StructType(list(df.schema.fields) + [StructField("cluster_raw", IntegerType())])
    return df.select(*keep, words.lowered(F.col(text)).alias("_lower")).mapInArrow(run, schema)


def _remap(labelled: DataFrame, min_size: int) -> dict[int, int]:
    """New id of each raw cluster; one row per cluster reaches the driver."""
    return {r.cluster_raw: r.cluster for r in clusters.renumbering(labelled, "cluster_raw", min_size).collect()}


def build(
    work_orders: DataFrame, cfg: Config = Config(), embedder: embed.Embedder | None = None, job: str | None = None
) -> Taxonomy:
    """The whole job. With an `embedder` its vectors take the place of TF-IDF and SVD; all else is the same.

    Its stages (vocabulary and weights, embedding, search, final fit, labels) are written to the shared folder one by one.
    With a `job` name, a rerun over the same input and settings takes up what an earlier run has finished, also after the
    loss of its driver; without one, every run stands for itself. `close` deletes the stages.
    """
    spark = work_orders.sparkSession
    model = f"{embedder.__module__}.{embedder.__qualname__}" if embedder else None
    digest = fingerprint(work_orders, cfg, model) if job else uuid.uuid4().hex
    stages = Stages(spark, job or "run", digest)
    scored = quality.with_score(work_orders, cfg.quality_weights)
    kept, rejected = quality.split(scored, cfg.quality_threshold)
    kept = spread(kept)

    def weighed():
        texts = kept.select("record_id", TEXT)
        vocabulary = tfidf.fit(texts, TEXT, cfg.stop_words, cfg.max_features, cfg.min_df)
        if embedder:
            return vocabulary, {}
        return vocabulary, {"tfidf": tfidf.weights(texts, TEXT, vocabulary, ["record_id"])}

    vocabulary, weights = stages.run("weights", weighed)

    def embedded():
        if embedder:
            # A model call costs more than storage: whole records are written with their vector, never embedded twice.
            return None, {"points": embed.embed_batched(kept, TEXT, kept.columns, embedder)}
        reduced = svd.fit(weights["tfidf"], len(vocabulary), cfg.embedding_dims)
        return reduced, {"points": svd.embed(weights["tfidf"], reduced, ["record_id"])}

    reduced, tables = stages.run("embedding", embedded)
    points = kmeans.with_row_hash(tables["points"].select("record_id", "embedding"), "record_id", "embedding")
    found, _ = stages.run("search", lambda: (sweep.search(points, "record_id", cfg), {}))
    final, _ = stages.run("final", lambda: (sweep.final_fit(points, found, found.best_k, cfg), {}))
    models = Models(vocabulary, reduced, final.centers)

    def placed():
        if embedder is None:
            labelled = predict(kept, TEXT, models)
        else:
            labelled = kmeans.assign(tables["points"], final.centers, kept.columns).withColumnRenamed("cluster", "cluster_raw")
        # Sizes are counted on the very labels that the records keep, so both are written once.
        kept_columns = [c for c in DEFECT_FEATURES.fieldNames() if c not in ("cluster", "defect_cluster_name")]
        return None, {"labelled": labelled.select(*kept_columns, "cluster_raw")}

    labelled = stages.run("labels", placed)[1]["labelled"]
    remap = _remap(labelled, cfg.min_cluster_size)
    numbered = labelled.withColumn("cluster", lookup(F.col("cluster_raw"), remap))
    feature_rows = features.feature_table(clusters.with_names(numbered, cfg.cluster_names))
    return Taxonomy(
        models,
        found,
        remap,
        feature_rows,
        features.equipment_agg(feature_rows),
        rejected,
        cluster_terms(labelled, remap, weights.get("tfidf"), models, cfg.top_terms),
        stages,
    )


def cluster_terms(
    labelled: DataFrame, remap: dict[int, int], weights: DataFrame | None, models: Models, top_n: int
) -> DataFrame:
    """Top terms of all clusters in one plan; the "Other" bucket has none.

    The stored weights are placed by the models as the records were, without a join; the texts are not read. Only where
    no weights were written, as with vectors of another model, texts are weighed here.
    """
    if weights is None:
        placed = tfidf.weights(labelled, TEXT, models.tfidf, ["cluster_raw"])
    else:
        placed = kmeans.assign(svd.embed(weights, models.svd, ["tfidf"]), models.centers, ["tfidf"])
        placed = placed.withColumnRenamed("cluster", "cluster_raw")
    members = placed.withColumn("cluster", lookup(F.col("cluster_raw"), remap)).filter(F.col("cluster") != clusters.OTHER)
    return clusters.top_terms(members, "cluster", tfidf.term_table(labelled.sparkSession, models.tfidf), top_n)


def summary(taxonomy: Taxonomy, cfg: Config = Config()) -> DataFrame:
    """What the job reports at its end, as one row."""
    counts = taxonomy.features.agg(
        F.count(F.lit(1)).alias("kept_records"),
        F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("final_clusters"),
        F.count_if(F.col("cluster") == clusters.OTHER).alias("other_records"),
    )
    rejected = taxonomy.rejected.agg(F.count(F.lit(1))).scalar()
    return counts.select(
        (F.col("kept_records") + rejected).alias("input_records"),
        "kept_records",
        F.lit(taxonomy.sweep.best_k).alias("best_k"),
        "final_clusters",
        "other_records",
        F.lit(cfg.min_cluster_size).alias("min_cluster_size"),
        agreement(taxonomy.features).scalar().alias("ari"),
        F.lit(taxonomy.models.centers.shape[1]).alias("embedding_dims"),
    )


def agreement(features_df: DataFrame) -> DataFrame:
    return validate.ari(validate.contingency(features_df, "true_defect_label", "cluster"))


def run_summary(scored: DataFrame, threshold: float, truth: str, cluster: str) -> DataFrame:
    """Input rows, kept rows, pass rate, final clusters and agreement with the labels.

    One grouped scan gives everything; what follows works on (label, cluster) counts.
    """
    passes = F.col("quality_score") >= threshold
    cells = scored.groupBy(
        F.col(truth).cast("string").alias("label"), F.col(cluster).cast("string").alias("cluster")
    ).agg(F.count(F.lit(1)).alias("inputs"), F.count_if(passes).alias("records"))
    kept = cells.filter(F.col("records") > 0)
    totals = cells.agg(
        F.sum("inputs").alias("input_records"),
        F.sum("records").alias("kept_records"),
        F.countDistinct(F.when((F.col("records") > 0) & (F.col("cluster").cast("int") >= 0), F.col("cluster"))).alias(
            "final_clusters"
        ),
    )
    share = F.round(F.try_divide(F.col("kept_records") * 100.0, F.col("input_records")), 1)
    agreement_value = validate.ari(kept.select("label", "cluster", "records")).scalar()
    return totals.select(
        "input_records", "kept_records", share.alias("pass_pct"), "final_clusters", agreement_value.alias("ari")
    )


def publish(taxonomy: Taxonomy, cfg: Config = Config(), folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the two result tables, in `folder` if one is given, and read them back. If a record lost its cluster
    on the way that is an error, and the tables stay what they were."""
    spark = taxonomy.features.sparkSession
    use_namespace(spark, cfg.schema, cfg.catalog)
    found = []

    def complete(written: DataFrame) -> None:
        if written.filter(F.col("cluster").isNull()).limit(1).count():
            raise ValueError("a record has no cluster")

    for name, df, check in (
        ("defect_features", taxonomy.features, complete), ("equipment_cluster_agg", taxonomy.equipment, None),
    ):
        write_table(df, name, cfg.table_format, f"{folder}/{name}" if folder else None, check)
        found.append(spark.table(name))
    return found[0], found[1]
