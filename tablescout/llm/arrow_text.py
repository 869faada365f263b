"""Arrow batches of texts inside Spark tasks: whole texts, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Bytes of text that a task works on at once. One text that is longer makes a slice of its own.
SLICE_BYTES = 1 << 19

# Bytes of an Arrow batch between Spark and Python, where the session has Spark's own default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep batches small: a batch of long texts is otherwise held several times over by each task."""
    if spark.conf.get(_BATCH_CONF).rstrip("bB") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and n + 1 offsets into it. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    array = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most `limit` bytes of text (at least one row each)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def append_columns(
    df: DataFrame, text_column: str, compute: Callable[[pa.Array], list[pa.Array]], fields: T.StructType
) -> DataFrame:
    """`df` with the columns that `compute` makes of the texts.

    A column of the input that has the name of a new one is replaced; all others stay as they are.
    """
    bound_batches(df.sparkSession)
    kept = df.drop(*fields.names)
    schema = T.StructType([*kept.schema.fields, *fields.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                made = compute(part.column(text_column))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return kept.mapInArrow(run, schema)


def map_texts(
    df: DataFrame, text_column: str, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """The rows that `rows` makes of each slice of the input."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                yield from rows(part)

    return df.mapInArrow(run, schema)
