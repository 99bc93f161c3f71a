"""Data quality: composite score, threshold split, summary and histogram."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from faultline.config import QUALITY_WEIGHTS
from faultline.functions.scalars import half_even, mean_half_even
from faultline.operators.quantiles import quantiles


def composite(weights: Mapping[str, float] = QUALITY_WEIGHTS) -> Column:
    return half_even(reduce(add, [F.col(dim) * F.lit(w) for dim, w in weights.items()]), 3)


def with_score(df: DataFrame, weights: Mapping[str, float] = QUALITY_WEIGHTS) -> DataFrame:
    """Always recomputed: a stored score is overwritten."""
    return df.withColumn("quality_score", composite(weights))


def split(scored: DataFrame, threshold: float = 0.50) -> tuple[DataFrame, DataFrame]:
    """Rows at or above the threshold, and rows below it. A null score is in neither."""
    score = F.col("quality_score")
    return scored.filter(score >= threshold), scored.filter(score < threshold)


def describe(df: DataFrame, column: str, digits: int = 3, few: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles at three places, of values with at most `digits` decimals.

    With `few`, for columns such as scores with 1,001 different values at most, percentiles keep one counter per distinct
    value. Without, quartiles are bracketed by sketches and then selected, see `quantiles`: memory does not grow with the
    number of distinct values. Both are taken of whole numbers of the last decimal, which interpolate without error. A
    value with more decimals is an error.
    """
    value, unit = F.col(column), 10.0**digits

    def placed(units: Column) -> Column:
        return F.rint(units * 10 ** max(3 - digits, 0) / 10 ** max(digits - 3, 0)) / 1000.0

    names = {"q1": 0.25, "median": 0.50, "q3": 0.75}
    if few:
        quartiles = {name: placed(F.percentile(F.round(value * unit), share)) for name, share in names.items()}
    else:
        found = quantiles(df, column, names).select(F.struct(*names).alias("found")).scalar()
        quartiles = {}
        for name in names:
            at, lower, upper = found[name], F.round(found[name]["lower"] * unit), F.round(found[name]["upper"] * unit)
            quartiles[name] = placed(lower + at["part"] * (upper - lower))
    finer = F.raise_error(F.concat(F.lit(f"{column} has more than {digits} decimals: "), value.cast("string"))).cast("double")
    checked = df.select(F.when(F.round(value, digits) == value, value).when(value.isNotNull(), finer).alias(column))
    return checked.agg(
        F.count(value).alias("n"),
        mean_half_even(value, 3, digits).alias("mean"),
        (F.rint(F.stddev_samp(value) * 1000.0) / 1000.0).alias("std"),
        F.min(value).alias("min"),
        *(q.alias(name) for name, q in quartiles.items()),
        F.max(value).alias("max"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from minimum to maximum with the last one closed; empty bins count 0.

    As in array libraries, a value belongs to the bin between whose edges it lies: the computed position is corrected
    by the edges themselves. A single value lies in the middle of bins from half below to half above it.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    # Each bound is a scalar subquery: one partial aggregate, folded into the scan that follows as a literal.
    single = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    limits = values.agg(F.struct((F.min("x") - single).alias("lo"), (F.max("x") + single).alias("hi")).alias("limits"))
    lo, hi = limits.select("limits.lo").scalar(), limits.select("limits.hi").scalar()

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i * ((hi - lo) / bins) + lo)

    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("x") - lo, hi - lo) * bins).cast("int"))
    placed = values.withColumn("at", at)
    moved = (
        F.when(F.col("x") < edge(F.col("at")), F.col("at") - 1)
        .when((F.col("x") >= edge(F.col("at") + 1)) & (F.col("at") < bins - 1), F.col("at") + 1)
        .otherwise(F.col("at"))
    )
    counts = placed.groupBy(moved.alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            F.round(edge(F.col("bin")), 6).alias("bin_start"),
            F.round(edge(F.col("bin") + 1), 6).alias("bin_end"),
            F.coalesce("records", F.lit(0)).alias("records"),
        )
        .orderBy("bin")
    )


def split_counts(scored: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Rows on either side of the threshold, from one pass."""
    score = F.col("quality_score")
    counts = scored.agg(F.count_if(score >= threshold).alias("pass"), F.count_if(score < threshold).alias("reject"))
    return counts.unpivot([], ["pass", "reject"], "tbl", "row_count")


def date_range(df: DataFrame, column: str = "visit_date") -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))
