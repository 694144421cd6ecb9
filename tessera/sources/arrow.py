"""Results as Arrow IPC streams, made where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def to_ipc(df: DataFrame) -> DataFrame:
    """One row a batch, ``ipc``: a whole Arrow IPC stream of its rows.

    A reader can take the streams one by one (``toLocalIterator``) or have them
    written as files; the driver never holds the whole result.  An empty frame
    gives no streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    return df.mapInArrow(run, "ipc binary")


def from_ipc(streams: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of streams that ``to_ipc`` made of a frame with that schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("ipc"):
                with pa.ipc.open_stream(stream.as_buffer()) as reader:
                    yield from reader

    return streams.select("ipc").mapInArrow(run, schema)
