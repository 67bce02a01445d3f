"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import scratch_dir

#: Rows turned into Python objects at a time; bounds a task's memory whatever the Arrow batch holds.
ROWS_AT_ONCE = 256
#: Characters handled at a time; a longer text is a slice of its own.
CHARS_AT_ONCE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):               # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of few rows and few bytes of the column `text`.

    When they end, memory kept for later goes back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
        before, start = np.concatenate([[0], np.cumsum(size)]), 0
        while start < batch.num_rows:
            end = int(np.searchsorted(before, before[start] + CHARS_AT_ONCE, side="right")) - 1
            end = min(max(end, start + 1), start + ROWS_AT_ONCE, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    release()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the cluster's shared folder and read again: worked out once, and safe from lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held(df: DataFrame, *own: Column) -> DataFrame:
    """The columns under numbers (in0_, in1_, ...), so that no name of theirs can clash with an operator's own columns."""
    return df.select(*[F.col(f"`{c}`").alias(f"in{i}_") for i, c in enumerate(df.columns)], *own)


def released(names: list[str], replaced: dict[str, Column] | None = None) -> list[Column]:
    """The select list that gives numbered columns their names back, with new values for some."""
    return [(replaced or {}).get(c, F.col(f"in{i}_")).alias(c) for i, c in enumerate(names)]
