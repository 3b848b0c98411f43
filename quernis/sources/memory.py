"""Frames from Python values and from Arrow data, with the types Spark lacks carried over."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.errors import BindError, QuernisError
from quernis.functions import types as t
from quernis.plans.binder import check_unique, quoted


@dataclass(frozen=True)
class Values:
    """A named in-memory column: Python values or an Arrow array, with an optional type."""

    name: str
    data: object
    dtype: str | t.DType | None = None

    def __post_init__(self):
        if not self.name:
            raise QuernisError("a series needs a name")
        if self.data is None:
            raise QuernisError(f"series {self.name!r} has no values")
        self.array()

    def array(self) -> pa.Array:
        if isinstance(self.data, pa.ChunkedArray):
            return self.data.combine_chunks()
        if isinstance(self.data, pa.Array):
            return self.data
        if not isinstance(self.data, (list, tuple)):
            raise QuernisError(f"unsupported series values type {type(self.data).__name__}")
        if self.dtype is not None:
            return pa.array(list(self.data), arrow_type(t.parse(self.dtype)))
        first = next((v for v in self.data if v is not None), None)
        known = {bool: pa.bool_(), int: pa.int64(), float: pa.float64(), str: pa.string(), bytes: pa.binary(), dt.datetime: pa.timestamp("us", "UTC"), dt.date: pa.date32(), type(None): pa.null()}
        if type(first) not in known:
            raise QuernisError(f"unsupported series values type {type(first).__name__}")
        return pa.array(list(self.data), known[type(first)])


def nulls(name: str, n: int) -> Values:
    if n < 0:
        raise QuernisError("a series has no negative length")
    return Values(name, pa.nulls(n))


def fixed_binary(name: str, data, width: int) -> Values:
    if width <= 0:
        raise QuernisError("a fixed width is positive")
    return Values(name, pa.array(list(data), pa.binary(width)))


def arrow_type(d: t.DType) -> pa.DataType:
    plain = {
        "null": pa.null(), "bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(),
        "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(), "float16": pa.float16(),
        "float32": pa.float32(), "float64": pa.float64(), "utf8": pa.string(), "large_utf8": pa.large_string(), "string_view": pa.string_view(),
        "binary": pa.binary(), "large_binary": pa.large_binary(), "binary_view": pa.binary_view(), "date32": pa.date32(), "date64": pa.date64(),
        "interval_month_day_nano": pa.month_day_nano_interval(),
    }
    if d.tag in plain:
        return plain[d.tag]
    if d.tag == "timestamp":
        return pa.timestamp(*(d.params or ("us", "UTC")))
    if d.tag == "duration":
        return pa.duration(*(d.params or ("us",)))
    if d.tag == "time32":
        return pa.time32(*(d.params or ("ms",)))
    if d.tag == "time64":
        return pa.time64(*(d.params or ("us",)))
    if d.tag == "decimal128":
        return pa.decimal128(*d.params)
    if d.tag == "decimal256":
        return pa.decimal256(*d.params)
    raise BindError(f"no in-memory constructor for {d.tag}")


def logical(a: pa.DataType) -> t.DType:
    """The tag of an Arrow type."""
    p = pa.types
    if p.is_dictionary(a):
        return logical(a.value_type)
    if p.is_run_end_encoded(a):
        return logical(a.value_type)
    if isinstance(a, pa.BaseExtensionType):
        return logical(a.storage_type)
    if p.is_timestamp(a):
        return t.DType("timestamp", (a.unit, a.tz or ""))
    if p.is_duration(a):
        return t.DType("duration", (a.unit,))
    if p.is_time32(a) or p.is_time64(a):
        return t.DType("time32" if p.is_time32(a) else "time64", (a.unit,))
    if p.is_decimal(a):
        return t.DType("decimal256" if p.is_decimal256(a) else "decimal128", (a.precision, a.scale))
    if p.is_fixed_size_binary(a):
        return t.DType("fixed_size_binary", (a.byte_width,))
    if p.is_struct(a):
        return t.DType("struct", tuple((f.name, logical(f.type)) for f in a))
    if p.is_map(a):
        return t.DType("map", (logical(a.key_type), logical(a.item_type)))
    for name, test in (("list", p.is_list), ("large_list", p.is_large_list), ("fixed_size_list", p.is_fixed_size_list), ("list_view", p.is_list_view), ("large_list_view", p.is_large_list_view)):
        if test(a):
            return t.DType(name, (logical(a.value_type),))
    if p.is_union(a):
        raise BindError("Spark has no union type")
    names = {"halffloat": "float16", "float": "float32", "double": "float64", "string": "utf8", "large_string": "large_utf8", "date32[day]": "date32", "date64[ms]": "date64", "month_day_nano_interval": "interval_month_day_nano"}
    return t.DType(names.get(str(a), str(a)))


def carried(a: pa.ChunkedArray) -> tuple[pa.ChunkedArray, t.DType]:
    """The values in a type that Spark takes, and the tag they had."""
    d = logical(a.type)
    if pa.types.is_dictionary(a.type):
        a = a.cast(a.type.value_type)
    if pa.types.is_run_end_encoded(a.type):
        a = pa.chunked_array([pc.run_end_decode(c) for c in a.chunks], a.type.value_type)
    if isinstance(a.type, pa.BaseExtensionType):
        a = pa.chunked_array([c.storage for c in a.chunks], a.type.storage_type)
    if d.tag == "decimal256":
        t.to_spark(d)
        return a.cast(pa.decimal128(*d.params)), d
    to = {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "float16": pa.float32(), "large_utf8": pa.string(), "string_view": pa.string(), "large_binary": pa.binary(), "binary_view": pa.binary(), "fixed_size_binary": pa.binary(), "date64": pa.date32(), "large_list": None, "time32": pa.time64("us")}.get(d.tag)
    if to is not None:
        return a.cast(to), d
    if d.tag == "interval_month_day_nano":
        rows = [None if v is None else {"months": v.months, "days": v.days, "nanos": v.nanoseconds} for v in a.to_pylist()]
        return pa.chunked_array([pa.array(rows, pa.struct([("months", pa.int32()), ("days", pa.int32()), ("nanos", pa.int64())]))]), d
    if d.tag in ("large_list", "list_view", "large_list_view", "fixed_size_list"):
        return a.cast(pa.list_(a.type.value_type)), d
    if d.tag in ("timestamp", "duration", "time64") and a.type.unit == "ns":
        to = {"timestamp": lambda: pa.timestamp("us", a.type.tz), "duration": lambda: pa.duration("us"), "time64": lambda: pa.time64("us")}[d.tag]()
        return a.cast(to, safe=False), d
    return a, d


def from_arrow(spark: SparkSession, data, schema: pa.Schema | None = None) -> DataFrame:
    """A table, or a sequence of record batches with an optional schema (needed when there are none)."""
    if not isinstance(data, pa.Table):
        batches = list(data)
        if schema is None:
            if not batches:
                raise QuernisError("no batches and no schema")
            schema = batches[0].schema
        for b in batches:
            if b.num_columns != len(schema):
                raise QuernisError(f"a batch has {b.num_columns} columns, the schema {len(schema)}")
        data = pa.Table.from_batches([b.cast(schema) if b.schema != schema else b for b in batches], schema)
    check_unique(data.column_names)
    cols = [carried(data.column(i)) for i in range(data.num_columns)]
    table = pa.table([c for c, _ in cols], names=[f"c{i}" for i in range(len(cols))])
    if any(d.tag == "timestamp" and not d.params[1] for _, d in cols):
        # Spark reads a zoneless Arrow timestamp as a zoned one: it is told the type instead.
        fields = [T.StructField(f"c{i}", t.to_spark(d) if d.tag == "timestamp" else _spark_type(c.type)) for i, (c, d) in enumerate(cols)]
        df = spark.createDataFrame(table, schema=T.StructType(fields))
    else:
        df = spark.createDataFrame(table)
    return df.select([F.col(f"c{i}").alias(n, metadata=t.metadata_for(d) or {}) for i, (n, (_, d)) in enumerate(zip(data.column_names, cols, strict=True))])


def _spark_type(a: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(a)


def frame_of(spark: SparkSession, columns: list[Values]) -> DataFrame:
    """Columns of equal length and distinct names."""
    if any(c is None for c in columns):
        raise QuernisError("nil series")
    check_unique([c.name for c in columns], "series")
    arrays = [c.array() for c in columns]
    if len({len(a) for a in arrays}) > 1:
        raise QuernisError("series lengths differ: " + ", ".join(f"{c.name} len={len(a)}" for c, a in zip(columns, arrays, strict=True)))
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    return from_arrow(spark, pa.table(arrays, names=[c.name for c in columns]))


def select_in_order(df: DataFrame, columns: list[str] | None) -> DataFrame:
    if not columns:
        return df
    check_unique(columns)
    for c in columns:
        if c not in df.columns:
            raise BindError(f"unknown column {c!r}")
    return df.select([F.col(quoted(c)) for c in columns])
