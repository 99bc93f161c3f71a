"""Fixed schemas of the four model tables. Inference is offered by the CSV reader, never relied on."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields])


# Column names, order and types of the model tables.
WORK_ORDERS = _struct(
    ("record_id", StringType),
    ("equipment_id", StringType),
    ("equipment_type", StringType),
    ("location", StringType),
    ("visit_date", DateType),
    ("technician_id", StringType),
    ("defect_description", StringType),
    ("true_defect_label", StringType),
    ("severity", StringType),
    ("days_to_failure", IntegerType),
    ("repair_duration_hrs", DoubleType),
    ("downtime_hrs", DoubleType),
    ("parts_replaced", StringType),
    ("data_quality_frequency", DoubleType),
    ("data_quality_freshness", DoubleType),
    ("data_quality_completeness", DoubleType),
    ("data_quality_pertinence", DoubleType),
    ("quality_score", DoubleType),
)

EQUIPMENT_MASTER = _struct(
    ("equipment_id", StringType),
    ("equipment_type", StringType),
    ("location", StringType),
    ("installation_year", IntegerType),
    ("age_years", IntegerType),
    ("manufacturer", StringType),
    ("criticality", StringType),
)

DEFECT_FEATURES = _struct(
    ("record_id", StringType),
    ("equipment_id", StringType),
    ("equipment_type", StringType),
    ("location", StringType),
    ("visit_date", DateType),
    ("defect_description", StringType),
    ("true_defect_label", StringType),
    ("cluster", IntegerType),
    ("defect_cluster_name", StringType),
    ("severity", StringType),
    ("days_to_failure", IntegerType),
    ("repair_duration_hrs", DoubleType),
    ("downtime_hrs", DoubleType),
    ("parts_replaced", StringType),
    ("quality_score", DoubleType),
    ("data_quality_frequency", DoubleType),
    ("data_quality_freshness", DoubleType),
    ("data_quality_completeness", DoubleType),
    ("data_quality_pertinence", DoubleType),
)

EQUIPMENT_CLUSTER_AGG = _struct(
    ("equipment_id", StringType),
    ("total_visits", LongType),
    ("distinct_defects", LongType),
    ("avg_quality_score", DoubleType),
    ("avg_repair_hrs", DoubleType),
    ("avg_downtime_hrs", DoubleType),
    ("pct_high_severity", DoubleType),
    ("last_visit_date", DateType),
)
