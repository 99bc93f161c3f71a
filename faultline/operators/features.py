"""The feature table and the per-equipment aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.scalars import mean_half_even
from faultline.schemas import DEFECT_FEATURES


def feature_table(df: DataFrame) -> DataFrame:
    return df.select(*DEFECT_FEATURES.fieldNames())


def equipment_agg(features: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per unit. Rows without a unit are left out; a null severity counts as not high.

    The distinct count is planned by Spark as (unit, cluster) first and unit second, so a unit that holds a large
    part of all visits is reduced to a few rows per task before anything is shuffled. With `approximate` a sketch
    takes its place, which saves that first shuffle.
    """
    distinct = F.approx_count_distinct("cluster") if approximate else F.countDistinct("cluster")
    high = F.when(F.col("severity") == "High", 1.0).otherwise(0.0)
    return (
        features.filter(F.col("equipment_id").isNotNull())
        .groupBy("equipment_id")
        .agg(
            F.count("record_id").alias("total_visits"),
            distinct.alias("distinct_defects"),
            mean_half_even(F.col("quality_score"), 3, 3).alias("avg_quality_score"),
            mean_half_even(F.col("repair_duration_hrs"), 3, 6).alias("avg_repair_hrs"),
            mean_half_even(F.col("downtime_hrs"), 3, 6).alias("avg_downtime_hrs"),
            mean_half_even(high, 3, 0).alias("pct_high_severity"),
            F.max("visit_date").alias("last_visit_date"),
        )
    )
