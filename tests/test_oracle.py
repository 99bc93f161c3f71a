"""Every query with an SQL counterpart, on whole tables, column by column and value by value."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from faultline.sources.shared import shared_dir
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()
SPARK_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, con, SQL[name]) is None
    described = con.execute("DESCRIBE " + SQL[name]).fetchall()
    assert {c: SPARK_TYPE.get(t, t) for c, t, *_ in described} == dict(df.dtypes)


#: The order that belongs to the result of a report.
ORDER = {
    "cluster_sizes": lambda r: (-r.records, r.label),
    "cluster_sizes_flagged": lambda r: (-r.records, r.defect_cluster_name),
    "cluster_membership": lambda r: r.cluster,
    "quality_histogram": lambda r: r.bin,
    "event_histogram": lambda r: r.bin,
    "report_monthly_trend": lambda r: r.month,
    "report_equipment": lambda r: (-r.total_visits, r.equipment_id),
    "top_equipment": lambda r: (-r.total_visits, r.equipment_id),
}


@pytest.mark.parametrize("name", sorted(ORDER))
def test_rows_come_in_order(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) > 1 and rows == sorted(rows, key=ORDER[name])


def test_the_job_leaves_nothing_but_its_tables_behind(spark):
    root = Path(shared_dir(spark).removeprefix("file:")) / "faultline"
    tables = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    before = set(root.rglob("*.parquet")) if root.exists() else set()
    QUERIES["defect_taxonomy"](spark, FOLDER).count()
    new = set(root.rglob("*.parquet")) - before
    assert new and {p.parent.name for p in new} == {"defect_features", "equipment_cluster_agg"}
    QUERIES["sink_table_roundtrip"](spark, FOLDER).count()
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == tables
