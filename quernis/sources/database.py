"""Tables of databases that have a JDBC driver on Spark's class path.

A filter or a choice of columns made later is sent to the database. With a
numeric, date or timestamp column and its bounds the read is split among tasks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quernis.errors import QuernisError
from quernis.operators.frame import Frame


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    split_by: str | None = None,
    bounds: tuple | None = None,
    parts: int = 1,
    fetch_rows: int = 10_000,
    **options: str,
) -> Frame:
    """A table or ``(select ...) name``. Rows outside ``bounds`` are read too; the bounds only shape the parts."""
    if not url or not table:
        raise QuernisError("a database needs a url and a table")
    if (split_by is None) != (bounds is None):
        raise QuernisError("a split needs its column and its bounds")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_rows, **options)
    if split_by:
        reader = reader.options(partitionColumn=split_by, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return Frame(reader.load(), source="database")


def write_database(frame: Frame, url: str, table: str, mode: str = "append", batch_rows: int = 10_000, **options: str) -> None:
    """Writes from all tasks; ``mode`` is Spark's: append, overwrite, ignore or error."""
    if frame is None:
        raise QuernisError("no frame to write")
    frame.spark.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_rows, **options).mode(mode).save()
