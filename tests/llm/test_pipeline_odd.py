"""The pipeline on odd rows, and what its similarity stage leaves behind."""

from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from faultline.llm import shingle_join
from faultline.llm.common import table
from faultline.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_nulls_empty_texts_repeated_rows_and_clashing_names(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(40)
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no key " * 30, "en", "s", 210), (9003, " \n\n ", "en", "s", 4)]
    rows = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(odd, docs.schema))
    clash = rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("n_removed_lines", "gone", "row", "self", "value", "key"))])
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    now = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == clash.columns, name
    assert now.count() > 0 and now.agg(F.max("length")).first()[0] <= 4096


def test_an_empty_table_stays_empty(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_similarity_stage_leaves_one_small_table(spark):
    home = Path(shared_dir(spark).removeprefix("file:")) / "faultline"
    before = set(home.iterdir()) if home.exists() else set()
    kept = shingle_join.one_of_each(table(spark, SF, "documents"))
    assert kept.count() > 0
    left = [p.name for d in set(home.iterdir()) - before for p in d.iterdir()]
    assert left == ["gone"]
