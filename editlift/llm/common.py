"""Reading, staging and batch helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlift.session import scratch_path, ship_package, small_batches

#: Text handled at once inside a task; a longer text is handled alone.
PIECE_BYTES = 4 << 20

#: Separators of words: blank and the control characters tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it (as ``schema``): cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path) if schema else df.sparkSession.read.parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of a column."""
    try:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            start, size = 0, 0
            for row, n in enumerate(pc.binary_length(col).to_pylist()):
                if size and size + (n or 0) > limit:
                    yield batch.slice(start, row - start)
                    start, size = row, 0
                size += n or 0
            if batch.num_rows > start:
                yield batch.slice(start)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task and may long wait for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
