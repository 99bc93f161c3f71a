"""Connected components of a link table by alternating large and small stars.

Every round is two aggregations, combined in the tasks, and joins over the links. The smallest neighbours are written
before they are joined, so that adaptive execution can split the links of a vertex that has many: a join with an aggregate
of the same stage is never split. Rounds are written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import materialise


def _large(links: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the smallest vertex around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every vertex hands itself and its smaller neighbours to the smallest of them. Links run from larger to smaller."""
    links = materialise(links, "links")
    least = materialise(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every vertex that has a link, root being the smallest vertex of its component. `links` has the
    columns a and b, in any order, repeated or not; a vertex linked with itself alone is left out."""
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(ordered, "links")
    mark = _mark(now)
    while True:
        now = materialise(_small(_large(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
