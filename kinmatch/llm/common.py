"""Shared helpers: table access, stored tables, Arrow row maps and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import checkpoint as checkpoint
from ..operators.graph import connected_components as connected_components
from ..operators.graph import remove_stored as remove_stored
from ..operators.graph import stored as stored

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of an action go at its end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which its worker gives freed memory back: workers that wait for a task keep it else, beside all others."""

    @functools.wraps(run)
    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return to_the_end


def map_rows(df: DataFrame, rows: Callable[[list, ...], dict], columns: list[str], schema: str, arrow: pa.Schema, step: int = 256) -> DataFrame:
    """Applies ``rows(*column_lists) -> {output column: list}`` to slices of ``step`` rows of the given columns.

    One output row for each input row, in a narrow stage: nothing is shuffled, and memory is bound by one slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
