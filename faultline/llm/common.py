"""What the operators of this subpackage share: tables by folder, batches of rows, column names that cannot clash."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.sources import shared

#: ASCII white space, as the contracts of this subpackage use it, in a form for Java's and DuckDB's expressions.
BLANK = r"[\x20\x09-\x0D]+"

#: Results that a worker keeps per generation, and the length of an argument that is worth keeping.
KEPT, SHORT = 300_000, 64


class Recent(dict):
    """`fn` with the results of recent short arguments, in two generations of `kept` entries at most: what nobody
    asked for while one generation filled up is forgotten."""

    def __init__(self, fn: Callable, kept: int = KEPT, short: int = SHORT) -> None:
        super().__init__()
        self.fn, self.kept, self.short, self.before = fn, kept, short, {}

    def __missing__(self, text: str | bytes):
        if (result := self.before.get(text)) is None:
            result = self.fn(text)
        if len(text) <= self.short:
            if len(self) >= self.kept:
                self.before = dict(self)
                self.clear()
            self[text] = result
        return result


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver's garbage is collected, which a driver with little garbage
    does late; until then they fill the disks of the executors. Results are not affected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_scopes: list[list[DataFrame]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back. Within `scratch` the table lives as long as its block."""
    written = shared.materialise(df, name)
    if _scopes:
        _scopes[-1].append(written)
    return written


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes in this block are deleted at its end, also after an error, and shuffle files of
    its jobs are released. What the block hands on must be written by `shared.materialise` before."""
    _scopes.append([])
    try:
        yield
    finally:
        for written in _scopes.pop():
            shared.drop_tables(written)
        release_shuffles(spark)


def text_of(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def pick(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, under fixed names, whatever other columns `df` has."""
    return df.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))


def key_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["key"].dataType)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that `df` does not have yet, in any case of letters."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def by_row(fn: Callable[[str], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow` over `pick`'s columns: key kept, `fn(text)` gives the other fields of `schema`.

    One text is a Python string at a time; a batch holds at most what Spark's byte limit for Arrow batches admits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            rows = [fn(texts[i].as_py()) for i in range(len(texts))]
            columns = list(zip(*rows)) if rows else [()] * (len(schema) - 1)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), *arrays], schema=schema)

    return run
