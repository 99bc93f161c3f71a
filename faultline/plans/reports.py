"""The data sets behind the dashboard. Each is one lazy plan over the feature table or the aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from faultline.functions.scalars import is_any, mean_half_up, percent, percent_of, with_all


def defect_data(features: DataFrame) -> DataFrame:
    # The columns of the published data set, in its order.
    return features.select(
        "record_id",
        "equipment_id",
        "equipment_type",
        "location",
        "visit_date",
        "defect_cluster_name",
        "severity",
        "days_to_failure",
        "repair_duration_hrs",
        "downtime_hrs",
        "parts_replaced",
        "quality_score",
    )


def monthly_trend(features: DataFrame) -> DataFrame:
    return (
        features.groupBy(F.date_trunc("month", "visit_date").cast("date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("visits"),
            mean_half_up(F.col("quality_score"), 3, 3).alias("avg_quality"),
        )
        .orderBy("month")
    )


def equipment_health(agg: DataFrame, master: DataFrame) -> DataFrame:
    """Aggregate with the unit's master data; units without visits vanish.

    Both sides hold one row per unit. Spark broadcasts the master when its size allows and shuffles it otherwise.
    """
    return (
        agg.join(
            master.select("equipment_id", "equipment_type", "location", "manufacturer", "criticality"),
            "equipment_id",
        )
        .select(
            "equipment_id",
            "equipment_type",
            "location",
            "manufacturer",
            "criticality",
            "total_visits",
            "distinct_defects",
            "avg_quality_score",
            F.round("avg_repair_hrs", 1).alias("avg_repair_hrs"),
            F.round("avg_downtime_hrs", 1).alias("avg_downtime_hrs"),
            percent(F.col("pct_high_severity")).alias("pct_high_severity"),
            "last_visit_date",
        )
        .orderBy(F.desc("total_visits"), "equipment_id")
    )


def top_equipment(agg: DataFrame, n: int = 5) -> DataFrame:
    """The n most visited units; equal counts in id order."""
    return (
        agg.orderBy(F.desc("total_visits"), "equipment_id")
        .limit(n)
        .select(
            "equipment_id",
            "total_visits",
            "distinct_defects",
            F.round("avg_repair_hrs", 1).alias("avg_repair_hrs"),
            percent(F.col("pct_high_severity")).alias("pct_high_severity"),
        )
    )


def filtered(
    features: DataFrame,
    equipment_types: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    locations: Sequence[str] | None = None,
) -> DataFrame:
    """The three multi-select filters; an empty selection does not restrict."""
    return with_all(
        features,
        [
            is_any("equipment_type", equipment_types),
            is_any("severity", severities),
            is_any("location", locations),
        ],
    )


def filter_choices(features: DataFrame, fields: Sequence[str] = ("equipment_type", "severity", "location")) -> DataFrame:
    """The values each filter offers, from a single scan."""
    fields = list(fields)
    return (
        features.select(*fields)
        .distinct()
        .unpivot([], fields, "field", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def kpis(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("record_id").alias("total_work_orders"),
        F.round(F.avg("repair_duration_hrs"), 6).alias("avg_repair_hrs"),
        F.round(F.sum("downtime_hrs"), 4).alias("total_downtime_hrs"),
    )


def by_cluster(features: DataFrame) -> DataFrame:
    return features.groupBy("defect_cluster_name").agg(F.count("record_id").alias("records"))


def by_severity(features: DataFrame) -> DataFrame:
    counts = features.groupBy("severity").agg(F.count("record_id").alias("records"))
    return counts.withColumn("pct", percent_of(F.col("records"), F.sum("records").over(Window.partitionBy())))


def downtime_by_type(features: DataFrame) -> DataFrame:
    return features.groupBy("equipment_type").agg(F.round(F.avg("downtime_hrs"), 6).alias("avg_downtime_hrs"))


def quality_by_type(features: DataFrame) -> DataFrame:
    return features.groupBy("equipment_type").agg(
        F.count(F.lit(1)).alias("visits"),
        mean_half_up(F.col("quality_score"), 3, 3).alias("avg_quality"),
    )
