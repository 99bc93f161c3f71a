"""Join of records to a dimension whose size, and whose hot keys, are not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.sources.shared import plan_bytes

# A file's rows take more room in memory than on disk. This many times is assumed.
UNPACKED = 8

# Records without a key are dealt out over this many values of a second key.
SALTS = 1_024


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, bound: DataFrame | None = None) -> DataFrame:
    """Left join on a key that is unique in `dim`. Nothing runs while the plan is built.

    `bound` is a table of which `dim` has at most a row per row. If its size, from the statistics of its files, is within
    Spark's own limit for broadcasts, the dimension is broadcast and the records stay where they are. Otherwise Spark
    joins by shuffle, and adaptive execution splits a partition that has grown beyond its limit in bytes, whether one
    hot key filled it or many lukewarm ones. Records without a key match nothing; a second key spreads them, so that
    they do not meet in one task. Every record comes out exactly once.
    """
    limit = facts.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if bound is not None and plan_bytes(bound) * UNPACKED <= limit:
        return facts.join(F.broadcast(dim), key, "left")
    salt = "_null_salt"
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS))).otherwise(F.lit(0))
    joined = facts.withColumn(salt, spread.cast("int")).join(dim.withColumn(salt, F.lit(0)), [key, salt], "left")
    return joined.drop(salt)
