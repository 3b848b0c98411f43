"""Callbacks over Arrow record batches, run by ``mapInArrow`` on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernis.errors import QuernisError


def map_batches(df: DataFrame, fn, schema: T.StructType | str | None = None) -> DataFrame:
    schema = df.schema if schema is None else schema

    def run(batches):
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, mask, nulls: str = "drop") -> DataFrame:
    if nulls not in ("drop", "emit"):
        raise QuernisError('nulls is "drop" or "emit"')

    def run(batches):
        for b in batches:
            m = mask(b)
            if m is None:
                raise QuernisError("the mask function returned nothing")
            m = m.combine_chunks() if isinstance(m, pa.ChunkedArray) else m if isinstance(m, pa.Array) else pa.array(m, pa.bool_())
            if len(m) != b.num_rows:
                raise QuernisError(f"the mask has {len(m)} entries for {b.num_rows} rows")
            yield pa.RecordBatch.from_arrays([pc.filter(c, m, null_selection_behavior="emit_null" if nulls == "emit" else "drop") for c in b.columns], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def iter_batches(df: DataFrame, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pulls one partition after the other to the driver as Arrow IPC and slices it."""
    if rows is not None and rows <= 0:
        raise QuernisError("a batch has at least one row")

    def ship(batches):
        for b in batches:
            step = rows or b.num_rows or 1
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])

    for row in df.mapInArrow(ship, "ipc binary").toLocalIterator():
        yield from pa.ipc.open_stream(row[0])
