"""Operator 9: exact duplicates, with frequent digests split off.

A Misra-Gries sketch finds the digests that many rows may share; it is merged in two levels, so that no task takes the
sketches of all others. Its candidates are counted exactly, and the verified ones are broadcast: their rows are settled
where they are. The remaining digests are shuffled in the ordinary way, and none of them can be frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import BLANK, pick, table
from faultline.sources.shared import materialise

#: Counters of a sketch, candidates taken from it, and sketches of the first level.
COUNTERS, CANDIDATES, GROUPS = 16_384, 4_096, 64


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, head, row): one narrow row per row of `docs`, written once. The digest is that of the text with
    every run of ASCII white space made one blank; `row` is unique."""
    rows = pick(docs, key, text).select(
        "key", F.unhex(F.sha2(F.regexp_replace("text", BLANK, " "), 256)).alias("digest")
    )
    head = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return materialise(
        rows.select("key", "digest", head.alias("head"), F.monotonically_increasing_id().alias("row")), "digests"
    )


def frequent_heads(rows: DataFrame) -> DataFrame:
    """(head): at most CANDIDATES digest heads, among them every one of more than 1/CANDIDATES of all rows.

    The built-in frequent-items sketch is a Misra-Gries summary: with m counters its error is below 3.5 / m of the rows.
    """
    first = rows.groupBy((F.spark_partition_id() % GROUPS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(head, {COUNTERS})").alias("sketch")
    )
    # Grouped by a constant: a global aggregate would also merge a buffer for each empty partition, which has no type.
    merged = first.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {CANDIDATES})")).alias("top"))
    return top.filter("top.count > 1").select("top.item").withColumnRenamed("item", "head").dropna()


def _first():
    """The row that stays: the smallest key, a null key last; of equal keys the first row."""
    return F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after replacing each run of ASCII white space by one blank; null counts as
    empty. Exactly one row of a group is kept: that with the smallest key (null keys come last, so keep_id is null only
    if all keys of the group are), and one of them if rows repeat a key. Other columns are ignored.
    """
    rows = digests(docs, key, text)
    # At most CANDIDATES heads: this side may be broadcast whatever the size of the corpus.
    heads = materialise(frequent_heads(rows), "heads")
    winners = materialise(
        rows.join(F.broadcast(heads), "head")
        .groupBy("digest")
        .agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "winners",
    )
    heavy = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "key", "row", F.min(_first()).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    columns = ("digest", "key", "row", "first", "group_size")
    return heavy.select(*columns).unionByName(rest.select(*columns)).select(
        F.col("key").alias(key),
        F.col("first.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(table(spark, folder, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""
