"""A manifest of the finished stages of a job, so that a rerun starts at the first unfinished one.

Each stage is a folder in the shared folder: tables as Parquet, and what is known on the driver (fitted models) as one
row. The row is written last and counts only with the marker that a complete write leaves. Folders are named by a digest
of the input and the parameters, so other data or settings never meet old results.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from faultline.sources.shared import shared_dir

_STATE = "state binary, tables map<string,string>"


def fingerprint(inputs: DataFrame, *parameters: object) -> str:
    """A digest of the files that the input reads (path, length and time of change), its columns and the parameters.

    Input that reads no files is told apart by its rows: their number and the sum of their hashes, in any order. The
    files are listed by Spark; no content is read.
    """
    spark, files = inputs.sparkSession, inputs.inputFiles()
    if files:
        listed = spark.read.format("binaryFile").load(list(files)).select("path", "length", "modificationTime")
    else:
        listed = inputs
    mark = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in listed.columns]).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((tuple(mark), inputs.schema.json(), parameters)).encode()).hexdigest()[:32]


class Stages:
    """The stages of one job; `name` tells jobs over the same input and parameters apart."""

    def __init__(self, spark: SparkSession, name: str, digest: str) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/faultline/jobs/{name}-{digest}"
        self.reused: list[str] = []

    def _path(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def finished(self, stage: str) -> bool:
        system, path = self._path(f"{self.folder}/{stage}/state/_SUCCESS")
        return system.exists(path)

    def run(self, stage: str, compute: Callable[[], tuple[Any, dict[str, DataFrame]]]) -> tuple[Any, dict[str, DataFrame]]:
        """State and tables of a stage. `compute` runs only if no earlier run finished the stage."""
        folder = f"{self.folder}/{stage}"
        if not self.finished(stage):
            state, tables = compute()
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
            row = (bytearray(pickle.dumps(state)), {n: df.schema.json() for n, df in tables.items()})
            kept = self.spark.createDataFrame([row], _STATE)
            kept.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state")
        else:
            self.reused.append(stage)
        row = self.spark.read.schema(_STATE).parquet(f"{folder}/state").first()
        schemas = {name: StructType.fromJson(json.loads(schema)) for name, schema in row.tables.items()}
        return pickle.loads(bytes(row.state)), {n: self.spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in schemas.items()}

    def drop(self) -> None:
        """Delete what the stages wrote: the job is done, or shall start anew."""
        system, path = self._path(self.folder)
        system.delete(path, True)
