"""Quernis: strict, bind-time-checked dataframes on Spark.

A :class:`Frame` wraps a ``pyspark.sql.DataFrame``; every method validates
names and types first and then delegates to Catalyst, so plans keep pushdown,
pruning and whole-stage codegen.
"""

from quernis.functions.expr import col, lit, typed
from quernis.operators.frame import Frame, Series, concat_columns
from quernis.errors import BindError, QuernisError

__all__ = ["BindError", "Frame", "QuernisError", "Series", "col", "concat_columns", "lit", "typed"]
