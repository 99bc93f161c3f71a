"""Intermediate results in the shared folder of the cluster.

A written table cuts lineage and survives the loss of any executor; reading it back keeps column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Only a local session may fall back to a folder of its own."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="faultline-")
    return _local_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/faultline/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a plan, from the sizes of its files. Nothing runs for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _splits(df: DataFrame) -> int:
    """About as many tasks as a scan of this size has."""
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(max(1, -(-plan_bytes(df) // split)), 1 << 20)  # a plan of unknown size counts as a very large one


def spread(df: DataFrame) -> DataFrame:
    """Deal small inputs, of fewer splits than cores, out over all cores; large ones pass through unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _splits(df) < cores else df


def fewer_tasks(df: DataFrame) -> DataFrame:
    """For jobs whose tasks each return a result of fixed size: fewer and longer tasks leave less to add up.

    They stay at a few per core, and no task takes more than 16 splits, in case the cluster has yet to grow.
    """
    spark = df.sparkSession
    slots = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.coalesce(max(slots, _splits(df) // 16))


def drop_tables(df: DataFrame) -> None:
    """Delete the folders in the shared folder that this plan reads. For intermediates that nobody reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/faultline/" in folder and root.removeprefix("file:").rstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
