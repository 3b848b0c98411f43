"""Tables written to the folder that driver and executors share.

They cut lineage: a lost executor costs the tasks that ran there, never what
was written before.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a local folder if all runs in one JVM, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not told and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return told or f"file://{tempfile.gettempdir()}/quernis-shared"


def quoted(name: str) -> str:
    """A column's name as a reference: whole, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """Named tables of one run. What is left of them goes when the JVM ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex[:12]}")
        self._fs().deleteOnExit(self._hadoop(self.path))
        self._n = 0

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{name}-{self._n}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the rows and returns them as read from the files."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for df in tables:
            self._fs().delete(self._hadoop(df._scratch_path), True)
