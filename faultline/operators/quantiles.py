"""Exact quantiles of a column with any number of distinct values, without sorting it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Steps of the grid that a sketch reports.
STEPS = 1_000
#: One part in this many is the sketch's error in rank, a tenth of a step.
ACCURACY = 10_000


def _grid(x: Column) -> Column:
    return F.percentile_approx(x, [i / STEPS for i in range(STEPS + 1)], ACCURACY)


def _bracket(rank: Column, rows: Column, grid: Column) -> list[Column]:
    """Grid points below a rank and above the next one among the rows of a grid, two steps off: twenty times the error."""
    step = F.lit(float(STEPS)) / F.greatest(rows, F.lit(1))
    low, high = F.floor(rank * step) - 2, F.ceil((rank + 2) * step) + 2

    def point(at: Column) -> Column:
        return F.element_at(grid, F.least(F.greatest(at, F.lit(0)), F.lit(STEPS)).cast("int") + 1)

    return [point(low).alias("lo"), point(high).alias("hi")]


def _beside(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """(x, b): each value with the brackets that it lies in or below; the brackets are one row, read as a constant."""
    held = brackets.agg(F.collect_list(F.struct("k", "rank", "part", "lo", "hi"))).scalar()
    return values.select("x", F.explode(held).alias("b")).filter(F.col("x") <= F.col("b.hi"))


def quantiles(df: DataFrame, column: str, shares: Mapping[str, float]) -> DataFrame:
    """One row, a struct (lower, upper, part) per name: the quantile is lower + part * (upper - lower).

    A mergeable sketch of all values brackets each rank, a second one of the values in the bracket narrows it, and the
    values that are left (about one in 40,000, unless equal) are counted and ranked exactly. Values below a bracket are
    counted, not kept. Three passes over one column; nothing is sorted whole or sent to the driver. A rank outside its
    bracket, which the sketch's bound rules out, is an error and never a wrong number. Nulls are left out, NaN is the
    largest value, equal values count each; without values the structs are null.
    """
    x = F.col("x")
    values = df.select(F.col(column).cast("double").alias("x")).filter(x.isNotNull())
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares.values())))
    position = F.col("s.share") * (F.col("rows") - 1)
    first = (
        values.agg(F.count("x").alias("rows"), _grid(x).alias("grid"))
        .filter("rows > 0")
        .select("rows", "grid", F.explode(each).alias("s"))
        .select("rows", "grid", F.col("s.k").alias("k"), F.floor(position).alias("rank"), (position - F.floor(position)).alias("part"))
    )
    wide = first.select("k", "rank", "part", *_bracket(F.col("rank"), F.col("rows"), F.col("grid")))
    inside = F.when(x >= F.col("b.lo"), x)
    second = _beside(values, wide).groupBy("b.k", "b.rank", "b.part").agg(
        F.count_if(inside.isNull()).alias("below"), F.count(inside).alias("rows"), _grid(inside).alias("grid")
    )
    narrow = second.select("k", "rank", "part", *_bracket(F.col("rank") - F.col("below"), F.col("rows"), F.col("grid")))
    counted = _beside(values, narrow).groupBy("b.k", "b.rank", "b.part", inside.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("value")))
    ranked = counted.withColumn("upto", upto).groupBy("k", "rank", "part").agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.col("value"))).alias("lower"),
        F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("value"))).alias("upper"),
        F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"),
    )
    outside = F.col("lower").isNull() | (F.col("below") > F.col("rank")) | ((F.col("part") > 0) & F.col("upper").isNull())
    upper = F.when(F.col("part") > 0, F.col("upper")).otherwise(F.col("lower"))
    lower = F.when(outside, F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")).otherwise(F.col("lower"))
    found = ranked.select("k", F.struct(lower.alias("lower"), upper.alias("upper"), "part").alias("found"))
    return found.agg(*(F.max(F.when(F.col("k") == k, F.col("found"))).alias(name) for k, name in enumerate(shares)))
