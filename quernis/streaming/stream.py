"""The same checked operators over a Structured Streaming source."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quernis.errors import QuernisError
from quernis.operators.frame import Frame


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> Frame:
    """A frame over the files that arrive in a folder; select, project, filter and group_by apply to it."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Frame(reader.parquet(path), source="stream")


def write_stream(frame: Frame, sink: str, checkpoint: str, mode: str = "append", **options) -> StreamingQuery:
    """Starts a query that ends when all that is there has been read; the checkpoint makes it resumable."""
    if not frame.spark.isStreaming:
        raise QuernisError("not a streaming frame")
    w = frame.spark.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.format(sink).options(**options).start()
