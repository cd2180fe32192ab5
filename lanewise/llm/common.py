"""Reading tables and handing work to Arrow tasks."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import materialize, shared_dir

__all__ = ["materialize", "numbered", "shared_dir", "table", "partitions", "batch_of", "few_rows", "parts_for", "trimmed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` stored with a number of each row, so that every later read meets the same numbers, and the number's column."""
    row = "_row"
    while row in map(str.lower, df.columns):
        row += "_"
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, total_bytes: float, each: float = 24e6) -> int:
    """Partitions for so many bytes, at least as many as the session shuffles to."""
    return max(partitions(spark), math.ceil(total_bytes / each))


@contextlib.contextmanager
def few_rows(spark: SparkSession, n: int):
    """Plans made in here hand at most `n` rows at once to Python, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task` for mapInArrow, which gives its memory back at its end: Python workers live on and are used again by later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
