"""Readers, writers, catalog inspection and plan checks."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import features, kmeans, quality, tfidf
from faultline.operators.joins import with_dimension
from faultline.plans import reports, taxonomy
from faultline.schemas import EQUIPMENT_CLUSTER_AGG
from faultline.sources import shared, stages, tables, views

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_with_and_without_schema(spark, tmp_path):
    rows = [("E1", 3, 2, 0.5, 1.0, 2.0, 0.0, dt.date(2024, 1, 1)), ("E2", 1, 1, None, 1.5, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, EQUIPMENT_CLUSTER_AGG)
    path = str(tmp_path / "agg")
    tables.write_csv(df, path)
    assert sorted(map(tuple, tables.read_csv(spark, path, EQUIPMENT_CLUSTER_AGG).collect())) == rows
    inferred = dict(tables.read_csv(spark, path).dtypes)
    assert inferred["last_visit_date"] == "date" and inferred["total_visits"] == "int"


def test_csv_keeps_any_text(spark, tmp_path):
    texts = [
        'plain', 'a, b', 'say "hi"', '"', 'back\\slash', 'tail\\', '\\n', '\\\\s', '', None, ' padded ', 'two\nlines', 'a\r\nb\r', '\n',
        'x\x1ey', '5 MΩ 65°C',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    path = str(tmp_path / "text")
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path, df.schema, escaped=True)
    # An empty field is a missing value, in Spark as in other readers.
    assert [r.t for r in back.orderBy("i").collect()] == [t or None for t in texts]
    assert len(spark.read.text(path).filter("value <> 'i,t'").collect()) == len(texts)


def test_a_torn_record_is_an_error(spark, tmp_path):
    (tmp_path / "torn.csv").write_text('i,t\n1,"two\nlines"\n2,plain\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv(spark, str(tmp_path / "torn.csv"), "i int, t string").collect()


def test_csv_of_other_writers(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"i": [1, 2], "t": ['say "hi", twice', "c:\\x"], "n": [1.5, None]}).to_csv(tmp_path / "p.csv", index=False)
    rows = tables.read_csv(spark, str(tmp_path / "p.csv")).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", twice', 1.5), (2, "c:\\x", None)]


@pytest.mark.parametrize("outside", [True, False])
def test_replacing_a_table_is_all_or_nothing(spark, tmp_path, outside):
    name, path = f"faultline_atomic_{outside}".lower(), str(tmp_path / "t") if outside else None
    tables.write_table(spark.range(3), name, path=path)
    broken = spark.range(9).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))

    def refuse(written):
        assert written.count() == 7
        raise ValueError("refused")

    for new, check, error in ((broken, None, Exception), (spark.range(7), refuse, ValueError)):
        with pytest.raises(error):
            tables.write_table(new, name, path=path, check=check)
        assert spark.table(name).count() == 3
    # From its own rows, with another schema, and with the same one again; no old version and no other table is left.
    tables.write_table(spark.table(name).select((F.col("id") * 2).alias("id"), F.lit("x").alias("t")), name, path=path)
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, "x"), (2, "x"), (4, "x")]
    reader = spark.table(name)
    tables.write_table(reader.unionByName(reader), name, path=path)
    assert spark.table(name).count() == 6
    if outside:
        assert len(list((tmp_path / "t").iterdir())) == 1
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    spark.sql(f"DROP TABLE {name}")


def test_a_failed_switch_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    name = "faultline_switch"
    tables.write_table(spark.range(3), name, path=str(tmp_path / "t"))
    plain = type(spark).sql

    def sql(self, query, *args, **more):
        if "_new_" in query and "RENAME" in query:
            raise RuntimeError("catalog lost")
        return plain(self, query, *args, **more)

    monkeypatch.setattr(type(spark), "sql", sql)
    with pytest.raises(RuntimeError):
        tables.write_table(spark.range(5).select(F.lit("x").alias("t")), name, path=str(tmp_path / "t"))
    monkeypatch.undo()
    assert spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")


def test_stages_are_run_once(spark):
    rows = spark.range(50)
    keys = [stages.fingerprint(rows, "a"), stages.fingerprint(rows, "b"), stages.fingerprint(spark.range(51), "a")]
    assert len(set(keys)) == 3 and stages.fingerprint(spark.range(50).repartition(7), "a") == keys[0]
    calls, name = [], time.time_ns()

    def compute():
        calls.append(1)
        return {"n": np.arange(3)}, {"rows": rows}

    for _ in range(2):
        job = stages.Stages(spark, f"test-{name}", keys[0])
        state, tables_ = job.run("one", compute)
        assert state["n"].tolist() == [0, 1, 2] and tables_["rows"].count() == 50
    assert len(calls) == 1 and job.reused == ["one"]
    with pytest.raises(ZeroDivisionError):
        job.run("two", lambda: (1 // 0, {}))
    assert not job.finished("two")
    job.drop()
    assert not job.finished("one")


def test_a_file_that_changes_changes_the_digest(spark, tmp_path):
    for n in (4, 5):
        spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "in"))
        found = stages.fingerprint(spark.read.parquet(str(tmp_path / "in")))
        assert found == stages.fingerprint(spark.read.parquet(str(tmp_path / "in")))
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert found != stages.fingerprint(spark.read.parquet(str(tmp_path / "in")))


def test_table_is_replaced_with_its_schema(spark, tmp_path):
    name = "faultline_replace_test"
    tables.write_table(spark.range(3).select(F.lit(1).alias("a")), name, path=str(tmp_path / "t"))
    tables.write_table(spark.range(2).select(F.lit("x").alias("b")), name, path=str(tmp_path / "t"))
    assert [r.b for r in tables.read_table(spark, name).collect()] == ["x", "x"]
    assert name in [r.tableName for r in tables.list_tables(spark).collect()]
    spark.sql(f"DROP TABLE {name}")


def test_namespace_is_created_and_chosen(spark):
    before = spark.catalog.currentDatabase()
    tables.use_namespace(spark, "faultline_ns")
    assert spark.catalog.currentDatabase() == "faultline_ns"
    spark.catalog.setCurrentDatabase(before)
    spark.sql("DROP DATABASE faultline_ns")


def test_nan_becomes_null(spark):
    df = tables.rows_to_table(spark, [("a", float("nan")), ("b", 1.0)], "k string, v double")
    assert df.filter("v is null").count() == 1


def test_files_by_glob(spark):
    names = {r.path.rsplit("/", 1)[1] for r in tables.list_files(spark, FOLDER, "e*.parquet").collect()}
    assert names == {"embeddings.parquet", "events.parquet"}


def test_schema_listing_counts_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in tables.describe_schema(df).orderBy("position").collect()] == [
        (0, "a", "int", True, 2), (1, "b", "string", True, 1),
    ]


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert shared.shared_dir(spark) == configured.rstrip("/")
    df = shared.materialise(spark.range(5), "numbers")
    assert df.count() == 5 and shared.shared_dir(spark) in df.inputFiles()[0]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, applicationId = "yarn", "x"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_report_reads_only_its_columns_and_needs_no_python(spark):
    text = plan(reports.monthly_trend(views.defect_features(spark, FOLDER)))
    assert "Python" not in text and "Join" not in text
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_comment" not in schema and "l_partkey" not in schema and "l_extendedprice" not in schema


def test_small_master_is_broadcast_by_its_size(spark):
    agg = features.equipment_agg(views.defect_features(spark, FOLDER))
    assert "BroadcastHashJoin" in plan(reports.equipment_health(agg, views.equipment_master(spark, FOLDER)))


def test_large_master_is_joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        agg = features.equipment_agg(views.defect_features(spark, FOLDER))
        joined = reports.equipment_health(agg, views.equipment_master(spark, FOLDER))
        assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def joined_rows(joined):
    return sorted((r.id, r.k or "", r.v) for r in joined.collect())


def test_dimension_join_keeps_every_record_once(spark, no_broadcast):
    """A hot key, many lukewarm ones, keys without a match and no key at all."""
    rows = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(60000)] + [(-1, None), (-2, None), (-3, "unknown")]
    facts = spark.createDataFrame(rows, "id int, k string").repartition(8)
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    want = sorted((i, k or "", None if k in (None, "unknown") else 1 if k == "hot" else int(k[1:])) for i, k in rows)
    shuffled = with_dimension(facts, dim, "k")
    assert joined_rows(shuffled) == want
    assert "skew=true" in plan(shuffled)


def test_records_without_a_key_are_spread(spark, no_broadcast):
    facts = spark.createDataFrame([(i, None if i % 4 else f"k{i}") for i in range(40000)], "id int, k string")
    dim = spark.createDataFrame([(f"k{i}", i) for i in range(0, 40000, 8)], "k string, v int")
    joined = with_dimension(facts, dim, "k")
    assert "_null_salt" in plan(joined) and joined.count() == 40000
    assert sorted(r.id for r in joined.filter("v is not null").collect()) == list(range(0, 40000, 8))
    largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 4 * 40000 / 32


def test_no_job_runs_while_a_report_is_planned(spark):
    tracker, group = spark.sparkContext.statusTracker(), "planning only"
    spark.sparkContext.setJobGroup(group, "")
    for with_location in (True, False):
        reports.defect_data(views.defect_features(spark, FOLDER, with_location=with_location))
    shared.spread(views.table(spark, FOLDER, "documents").groupBy("lang").count())
    # Spark reads a Parquet footer for the schema of a table; nothing else may run.
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(s is None or s.numTasks <= 1 for s in stages)


def test_records_are_not_shuffled_for_a_small_dimension(spark):
    assert "Exchange hashpartitioning(equipment_id" not in plan(views.defect_features(spark, FOLDER, with_location=True))


def test_filter_on_a_stored_score_is_pushed_to_the_scan(spark):
    stored = shared.materialise(views.defect_features(spark, FOLDER), "features")
    kept = stored.filter((F.col("quality_score") >= 0.9) & F.col("severity").isin("High"))
    assert "GreaterThanOrEqual(quality_score,0.9)" in plan(reports.defect_data(kept))


def test_applying_a_vocabulary_does_not_shuffle(spark):
    docs = views.table(spark, FOLDER, "documents").select("doc_id", "text")
    model = tfidf.fit(docs, "text", max_features=100)
    assert "Exchange" not in plan(tfidf.weights(docs, "text", model, ["doc_id"]))


def test_no_plan_holds_a_cross_join(spark):
    scored = views.scored(spark, FOLDER)
    for df in (
        quality.histogram(scored, "quality_score"),
        taxonomy.run_summary(scored, 0.5, "true_defect_label", "cluster"),
    ):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_row_hash_is_stable(spark):
    rows = spark.range(3).withColumn("v", F.array("id"))
    a = [r.row_hash for r in kmeans.with_row_hash(rows, "id", "v").orderBy("id").collect()]
    assert a == [r.row_hash for r in kmeans.with_row_hash(rows.repartition(3), "id", "v").orderBy("id").collect()]
