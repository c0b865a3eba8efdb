"""What several operators of this subpackage share: reading tables, durable intermediate tables, batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_dir

#: Rows of an Arrow batch for Python tasks. Long texts are the reason for a low number: a batch is held in memory.
TEXTS_PER_BATCH = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch that Spark hands to a Python task while a table is stored.
BATCH_BYTES = 4 << 20

_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Within it, batches of long texts are cut by their bytes before they reach Python; the session's own bound returns."""
    before = spark.conf.get(_BYTES_SETTING, None)
    spark.conf.set(_BYTES_SETTING, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BYTES_SETTING) if before is None else spark.conf.set(_BYTES_SETTING, before)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers, which Spark uses again, return free memory to the system at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidied, schema)


def stored(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: lineage ends at files that all executors share,
    so what is built on it survives the loss of an executor and is not computed again."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with small_batches(spark):
        df.write.format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def chunks(table: pa.RecordBatch, rows: int = TEXTS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows; nothing is copied."""
    for start in range(0, table.num_rows, rows):
        yield table.slice(start, rows)


def sized(table: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have ``most`` bytes together, or one row; nothing is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < table.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield table.slice(at, end - at)
        at = end


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that never cut a group, with the places where groups begin and the number of rows.

    Only the rows of the last group of a batch are held back for the next, so groups must be of bounded size.
    """

    def begins(part: pa.Table) -> np.ndarray:
        new = np.zeros(max(part.num_rows - 1, 0), bool)
        for k in keys:
            column = part.column(k)
            new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        if not part.num_rows:
            continue
        at = begins(part)
        held = part.slice(int(at[-1]))
        if len(at) > 1:
            yield part.slice(0, int(at[-1])), at
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])
