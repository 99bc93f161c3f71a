"""The model tables as views over the given star schema, so that every operator runs on whole tables.

| model table | given tables |
|---|---|
| equipment_master | supplier, nation, region |
| work_orders | lineitem, with the unit's location |
| text work orders | documents |
| vectors | embeddings |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions import scalars
from faultline.operators import quality
from faultline.operators.clusters import with_names
from faultline.operators.features import feature_table
from faultline.operators.joins import with_dimension

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FLAG_SEVERITY = {"R": "High", "A": "Medium", "N": "Low"}
LANG_SEVERITY = {"en": "High", "fr": "Medium", "de": "Low", "es": "Low"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def equipment_master(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.col("s_suppkey")
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    built = (2010 + unit % 13).cast("int")
    return (
        table(spark, folder, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            unit.cast("string").alias("equipment_id"),
            F.concat(F.lit("Type "), (unit % 8).cast("string")).alias("equipment_type"),
            F.col("n_name").alias("location"),
            built.alias("installation_year"),
            scalars.age_in(2024, built).alias("age_years"),
            F.col("r_name").alias("manufacturer"),
            F.when(F.col("s_acctbal") >= 6000, "High")
            .when(F.col("s_acctbal") >= 2000, "Medium")
            .otherwise("Low")
            .alias("criticality"),
        )
    )


def work_orders(spark: SparkSession, folder: str, with_location: bool = True) -> DataFrame:
    """One record per line item. Reports that do not show the location leave its join out."""
    flag = F.col("l_returnflag")
    rows = table(spark, folder, "lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("record_id"),
        F.col("l_suppkey").cast("string").alias("equipment_id"),
        F.concat(F.lit("Type "), (F.col("l_suppkey") % 8).cast("string")).alias("equipment_type"),
        F.col("l_shipdate").cast("date").alias("visit_date"),
        scalars.padded_id("TECH", F.col("l_partkey") % 20 + 1, 3).alias("technician_id"),
        F.concat(F.lit("Returned "), flag, F.lit(", status "), F.col("l_linestatus")).alias("defect_description"),
        flag.alias("true_defect_label"),
        scalars.lookup(flag, FLAG_SEVERITY).alias("severity"),
        scalars.keep_when(F.col("l_linenumber") % 5 < 3, (F.col("l_partkey") % 180 + 1).cast("int")).alias(
            "days_to_failure"
        ),
        F.col("l_quantity").alias("repair_duration_hrs"),
        (F.col("l_extendedprice") / 1000).alias("downtime_hrs"),
        F.concat(F.lit("Part "), (F.col("l_partkey") % 9).cast("string")).alias("parts_replaced"),
        (F.col("l_quantity") / 50).alias("data_quality_frequency"),
        (F.col("l_discount") * 10).alias("data_quality_freshness"),
        (F.col("l_tax") * 12.5).alias("data_quality_completeness"),
        (F.col("l_linenumber") / 7).alias("data_quality_pertinence"),
        F.col("l_linenumber").cast("int").alias("cluster"),
    )
    if not with_location:
        return rows.withColumn("location", F.lit(None).cast("string"))
    homes = equipment_master(spark, folder).select("equipment_id", "location")
    return with_dimension(rows, homes, "equipment_id", bound=table(spark, folder, "supplier"))


def scored(spark: SparkSession, folder: str, with_location: bool = False) -> DataFrame:
    return quality.with_score(work_orders(spark, folder, with_location))


def defect_features(spark: SparkSession, folder: str, with_location: bool = False) -> DataFrame:
    kept, _ = quality.split(scored(spark, folder, with_location))
    return feature_table(with_names(kept))


def text_work_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the description of one work order. The quality dimensions have two decimals and the ranges
    of real ones, so that about one record in a hundred fails the threshold."""
    doc = F.col("doc_id")
    unit = (doc % 50 + 1).cast("int")
    repair = 0.5 + (doc % 156) / 10.0
    return table(spark, folder, "documents").select(
        scalars.padded_id("WO", doc + 1, 5).alias("record_id"),
        scalars.padded_id("EQ", unit, 4).alias("equipment_id"),
        F.concat(F.lit("Type "), (unit % 8).cast("string")).alias("equipment_type"),
        F.concat(F.lit("Site "), (unit % 6).cast("string")).alias("location"),
        scalars.offset_date("2022-01-01", doc % 731).alias("visit_date"),
        F.col("text").alias("defect_description"),
        F.col("lang").alias("true_defect_label"),
        scalars.lookup(F.col("lang"), LANG_SEVERITY).alias("severity"),
        scalars.keep_when(doc % 5 < 3, (doc % 180 + 1).cast("int")).alias("days_to_failure"),
        F.round(repair, 1).alias("repair_duration_hrs"),
        F.round((5 + doc % 156) * (doc % 7) / 40.0, 1).alias("downtime_hrs"),
        F.col("source").alias("parts_replaced"),
        (0.30 + (doc % 71) / 100.0).alias("data_quality_frequency"),
        (0.40 + (doc * 7 % 61) / 100.0).alias("data_quality_freshness"),
        (0.50 + (doc * 11 % 51) / 100.0).alias("data_quality_completeness"),
        (0.40 + (doc * 13 % 61) / 100.0).alias("data_quality_pertinence"),
    )
