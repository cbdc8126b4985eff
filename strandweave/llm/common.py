"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import parts, settle  # noqa: F401

#: Rows and bytes of what a kernel over whole texts takes at a time. Spark itself bounds a batch by 64 MB.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20

#: Rows for each file of a settled table that holds texts, or on whose rows a kernel has much to do.
PART_ROWS = 5000

#: A row id beside columns that are not ours, and so what ours are called there.
ROW = "__sw_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and, but for single rows, about bounded bytes; nothing is copied."""
    for b in batches:
        step = max(1, min(rows, int(size / max(1, b.nbytes) * b.num_rows)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a unique id a row. Two evaluations need not agree: settle the result before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def join_small(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, limit: int = 20_000) -> DataFrame:
    """Join, broadcasting the right side only if its counted rows are within the limit."""
    return left.join(F.broadcast(right) if right_rows <= limit else right, on, how)


def as_many_parts(out: DataFrame, source: DataFrame) -> DataFrame:
    """At most as many partitions as the source is read in, so that a row-wise result isn't left in crumbs.

    Only for a plain scan: to know how many parts a shuffle makes, it would have to be run.
    """
    plan = source._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return out
    return out.coalesce(max(1, plan.toRdd().getNumPartitions()))


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Inside, what is run hands its kernels batches of at most about ``size`` bytes; a batch of texts is held several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
