"""Readers, writers and catalog inspection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

# A lookup side this small may be broadcast; beyond it the join is left to the shuffle strategies.
BROADCAST_ROWS = 10_000


# Quotes inside a value are doubled, as most writers do; a backslash is an ordinary character; blanks are kept.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# How `write_csv` writes what would end a line. After it every backslash is followed by one of these letters.
ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, escaped: bool = False) -> DataFrame:
    """CSV with a header, one record per line. Without a schema the types are inferred, at the price of a second pass.

    A record that does not fit its schema is an error, not a row of nulls. `escaped` is for files of `write_csv`.
    """
    reader = spark.read.options(**CSV, mode="FAILFAST")
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return _each_text(rows, lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], c)) if escaped else rows


def write_csv(df: DataFrame, path: str) -> None:
    """Any text survives, and every record is one line, so the files can be split between tasks: line breaks and
    backslashes inside texts are written as escapes."""
    escaped = _each_text(df, lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c))
    escaped.write.mode("overwrite").options(**CSV).csv(path)


def _each_text(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*[(change(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


#: Formats whose own overwrite is one transaction.
TRANSACTIONAL = ("delta", "iceberg", "hudi")


def write_table(
    df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None, check: Callable[[DataFrame], None] | None = None
) -> None:
    """Replace the table and its schema. Readers have the old rows until the new ones are complete.

    The rows are written aside, as a table of another name, and `check` may raise on what was written. Then the names are
    switched in the catalog, and the old rows deleted. If writing or checking fails the old table is untouched and what was
    written is deleted, so a table can be overwritten from its own rows. With `path` every version has a folder of its own
    below it, with its files in one named like the table; a version of equal schema takes the place of the last one in a single catalog call.
    """
    spark = df.sparkSession
    if fmt in TRANSACTIONAL:
        if check:
            check(df)
        writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
        (writer.option("path", path) if path else writer).saveAsTable(name)
        return
    version = uuid.uuid4().hex
    aside, old, folder = f"{name}_new_{version}", f"{name}_old_{version}", f"{path}/{version}" if path else None
    files = f"{folder}/{path.rstrip('/').rsplit('/', 1)[-1]}" if folder else None
    writer = df.write.format(fmt)
    try:
        (writer.option("path", files) if folder else writer).saveAsTable(aside)
        if check:
            check(spark.table(aside))
    except BaseException:
        _drop(spark, aside, folder)
        raise
    before = _location(spark, name) if spark.catalog.tableExists(name) else None
    if before and folder and _external(spark, name) and spark.table(name).schema == spark.table(aside).schema:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{files}'")
        spark.catalog.refreshTable(name)
        _drop(spark, aside, None)
        _delete(spark, _version(before, path) or before)
        return
    if before:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
    except BaseException:
        if before:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        _drop(spark, aside, folder)
        raise
    if before:
        _drop(spark, old, _version(before, path) if path else None)


def _version(location: str, path: str) -> str | None:
    """The folder of a version that lies below `path`."""
    top = f"{_plain(path)}/"
    return top + location[len(top) :].split("/", 1)[0] if location.startswith(top) else None


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}


def _plain(path: str) -> str:
    return path.removeprefix("file:").rstrip("/")


def _location(spark: SparkSession, name: str) -> str:
    return _plain(_described(spark, name)["Location"])


def _external(spark: SparkSession, name: str) -> bool:
    return _described(spark, name).get("Type") == "EXTERNAL"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop(spark: SparkSession, name: str, folder: str | None) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if folder:
        _delete(spark, folder)


def use_namespace(spark: SparkSession, schema: str, catalog: str | None = None) -> None:
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    spark.catalog.setCurrentDatabase(schema)


def rows_to_table(spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """A small dimension from local rows. NaN is no value: it becomes null, whatever the Arrow setting."""
    clean = [tuple(None if isinstance(v, float) and v != v else v for v in row) for row in rows]
    return spark.createDataFrame(clean, schema)


def compact(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate an aggregate once if it is small: its rows as a local table, and whether it was.

    At most `max_rows + 1` rows reach the driver. A larger result is returned as the plan it was.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup side once its size is known to be small; leave a larger one to a shuffle join."""
    side, is_small = compact(df, max_rows)
    return F.broadcast(side) if is_small else side


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of one tagged count per table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("tbl"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def describe_schema(df: DataFrame) -> DataFrame:
    """Name, type and nullability of each column, with its number of values; one scan."""
    spark = df.sparkSession
    fields = rows_to_table(
        spark,
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)],
        "position int, name string, type string, nullable boolean",
    )
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "name", "non_null"
    )
    return F.broadcast(fields).join(filled, "name").select("position", "name", "type", "nullable", "non_null")


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and sizes by glob. The content column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime")


def first_row(df: DataFrame, *keys: str) -> DataFrame:
    """The sample row: the first by key, so that it does not depend on partitioning."""
    return df.orderBy(*keys).limit(1)
