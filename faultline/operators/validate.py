"""Comparison of a clustering with known labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Rows per (label, cluster): the only pass over the data that the measures below need."""
    return df.groupBy(
        F.col(truth).cast("string").alias("label"), F.col(cluster).cast("string").alias("cluster")
    ).agg(F.count(F.lit(1)).alias("records"))


def ari(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index of a contingency table.

    Cells, both margins and the total are the four grouping sets of one cube over the small table. Two labellings
    that leave nothing to adjust agree perfectly: 1.
    """
    level = F.grouping_id()
    totals = cells.cube("label", "cluster").agg(level.alias("level"), F.sum("records").cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2

    def at(which: int):
        return F.sum(F.when(F.col("level") == which, pairs).otherwise(0.0))

    sums = totals.agg(at(0).alias("both"), at(1).alias("rows"), at(2).alias("cols"), at(3).alias("total"))
    expected = F.try_divide(F.col("rows") * F.col("cols"), F.col("total"))
    room = (F.col("rows") + F.col("cols")) / 2 - expected
    return sums.select(F.round(F.coalesce(F.try_divide(F.col("both") - expected, room), F.lit(1.0)), 6).alias("ari"))


def crosstab_cells(cells: DataFrame) -> DataFrame:
    """Share of each label's rows per cluster, two decimals, as a heat map needs it: every label with every cluster,
    absent pairs 0. Rows without a label or without a cluster do not count."""
    known = cells.filter(F.col("label").isNotNull() & F.col("cluster").isNotNull())
    # One row per label with its counts by cluster; the list of clusters is a scalar of the same small table.
    rows = known.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", "records"))).alias("records"), F.sum("records").alias("total")
    )
    names = known.agg(F.sort_array(F.collect_set("cluster")).alias("names")).scalar()
    grid = rows.select("label", "records", "total", F.explode(names).alias("cluster"))
    count = F.coalesce(F.try_element_at("records", F.col("cluster")), F.lit(0))
    return grid.select("label", "cluster", (F.rint(count / F.col("total") * 100.0) / 100.0).alias("share"))


def crosstab(cells: DataFrame, clusters: Sequence[str] | None = None) -> DataFrame:
    """The same with one column per cluster, those given or all of them."""
    long = crosstab_cells(cells).groupBy("label")
    wide = long.pivot("cluster", list(clusters)) if clusters else long.pivot("cluster")
    return wide.agg(F.first("share"))
