"""Work on a finished clustering: sizes, the "Other" bucket, renumbering, names, centroids and top terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.config import CLUSTER_NAMES
from faultline.functions.scalars import cluster_name, percent_of
from faultline.sources.tables import small_side

OTHER = -1


def sizes(df: DataFrame, column: str) -> DataFrame:
    """Frequency table, largest first. Rows without a value are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), column)
    )


def small(df: DataFrame, column: str, min_size: int) -> DataFrame:
    return sizes(df, column).filter(F.col("records") < min_size)


def renumbering(df: DataFrame, column: str, min_size: int) -> DataFrame:
    """One row per cluster: its merged id (-1 when it is too small) and its new dense id."""
    is_small = F.col("records") < min_size
    rank = F.dense_rank().over(Window.partitionBy(is_small).orderBy(column))
    return sizes(df, column).select(
        column,
        F.when(is_small, F.lit(OTHER)).otherwise(F.col(column)).cast("int").alias("merged"),
        F.when(is_small, F.lit(OTHER)).otherwise(rank - 1).cast("int").alias("cluster"),
    )


def merge_small(df: DataFrame, column: str, min_size: int) -> DataFrame:
    """Add `merged`: the cluster, or -1 where it has fewer than `min_size` members."""
    ids = small_side(renumbering(df, column, min_size).drop("cluster"))
    return df.join(ids, column, "left")


def reindex(df: DataFrame, column: str, min_size: int) -> DataFrame:
    """Add `cluster`: survivors renumbered from 0 in id order, everything else -1."""
    ids = small_side(renumbering(df, column, min_size).drop("merged"))
    return df.join(ids, column, "left")


def with_names(df: DataFrame, names: Mapping[int, str] = CLUSTER_NAMES, column: str = "cluster") -> DataFrame:
    return df.withColumn("defect_cluster_name", cluster_name(F.col(column), names))


def final_count(df: DataFrame, column: str = "cluster") -> DataFrame:
    return df.filter(F.col(column) >= 0).agg(F.countDistinct(column).alias("clusters"))


def membership(named: DataFrame) -> DataFrame:
    """Members and share of each cluster; the window runs over one row per cluster."""
    counts = named.groupBy("cluster", "defect_cluster_name").agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy())
    return counts.withColumn("pct", percent_of(F.col("records"), total)).orderBy("cluster")


def sizes_flagged(named: DataFrame) -> DataFrame:
    return sizes(named, "defect_cluster_name").withColumn(
        "is_other", F.col("defect_cluster_name").contains("Other")
    )


def _vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def unit_vectors(df: DataFrame, column: str) -> DataFrame:
    """L2 normalisation by the built-in transformer; a zero vector stays zero."""
    ready = df.withColumn("_v", _vector(column))
    scaled = Normalizer(inputCol="_v", outputCol="_unit", p=2.0).transform(ready)
    return scaled.withColumn(column, vector_to_array("_unit")).drop("_v", "_unit")


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster. Vectors are summed inside the tasks first, never exploded."""
    return (
        df.groupBy(cluster)
        .agg(Summarizer.mean(_vector(vector)).alias("_mean"))
        .select(cluster, vector_to_array("_mean").alias("centroid"))
    )


def inertia(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Sum of squared distances to the own centroid, per cluster, in one pass from the variances."""
    stats = Summarizer.metrics("variance", "count").summary(_vector(vector))
    spread = F.aggregate(vector_to_array(F.col("s.variance")), F.lit(0.0), lambda a, x: a + x)
    return (
        df.groupBy(cluster)
        .agg(stats.alias("s"))
        .select(
            cluster,
            F.col("s.count").alias("members"),
            F.when(F.col("s.count") > 1, spread * (F.col("s.count") - 1)).otherwise(0.0).alias("inertia"),
        )
    )


def top_terms(weighted: DataFrame, cluster: str, terms: DataFrame, top_n: int = 8, column: str = "tfidf") -> DataFrame:
    """The terms of highest mean weight in each cluster; a document without a term counts as 0.

    Means come from one vector aggregate per cluster. Scores are compared at 9 digits, then by term, so that the
    order of partial sums cannot change the ranking.
    """
    means = weighted.groupBy(cluster).agg(vector_to_array(Summarizer.mean(F.col(column))).alias("_means"))
    scored = (
        means.select(cluster, F.posexplode("_means").alias("term_id", "score"))
        .filter(F.col("score") > 0)
        .withColumn("score", F.round("score", 9))
        .join(F.broadcast(terms), "term_id")
    )
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))
    return (
        scored.withColumn("rank", place)
        .filter(F.col("rank") <= top_n)
        .select(cluster, "rank", "term", "score")
    )


def term_labels(ranked: DataFrame, cluster: str, first: int = 6) -> DataFrame:
    """The first terms of each cluster as one string; at most `first` rows per cluster are gathered."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return (
        ranked.filter(F.col("rank") <= first)
        .groupBy(cluster)
        .agg(F.array_join(F.transform(pairs, lambda p: p["term"]), ", ").alias("terms"))
    )


def assigned_labels(values: Sequence, column: Column) -> Column:
    """The cluster value at a centroid position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), column + 1)
