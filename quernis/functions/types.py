"""Logical column types, their Spark carriers and the numeric promotion rules.

A logical type is a family tag plus parameters. Spark has no unsigned or
half-width types, so those are carried in the next wider Spark type and the
tag travels in the field's metadata under ``dtype``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from quernis.errors import BindError

META = "dtype"


@dataclass(frozen=True)
class DType:
    tag: str
    params: tuple = ()

    def __str__(self) -> str:
        return self.tag


def _t(tag: str) -> DType:
    return DType(tag)


NULL, BOOL = _t("null"), _t("bool")
INT8, INT16, INT32, INT64 = map(_t, ("int8", "int16", "int32", "int64"))
UINT8, UINT16, UINT32, UINT64 = map(_t, ("uint8", "uint16", "uint32", "uint64"))
FLOAT16, FLOAT32, FLOAT64 = map(_t, ("float16", "float32", "float64"))
UTF8, BINARY, DATE32 = map(_t, ("utf8", "binary", "date32"))

# Tag -> Spark type whose values hold the tag's whole range.
CARRIERS: dict[str, T.DataType] = {
    "null": T.NullType(),
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "utf8": T.StringType(),
    "large_utf8": T.StringType(),
    "string_view": T.StringType(),
    "binary": T.BinaryType(),
    "large_binary": T.BinaryType(),
    "fixed_size_binary": T.BinaryType(),
    "binary_view": T.BinaryType(),
    "date32": T.DateType(),
    "date64": T.DateType(),
    "duration": T.DayTimeIntervalType(),
    "interval_month": T.YearMonthIntervalType(),
    "interval_day_time": T.DayTimeIntervalType(),
    "interval_month_day_nano": T.StructType(
        [T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]
    ),
}

# The plain tag of each Spark type that carries no metadata.
_PLAIN: dict[str, str] = {
    "void": "null",
    "boolean": "bool",
    "tinyint": "int8",
    "smallint": "int16",
    "int": "int32",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "string": "utf8",
    "binary": "binary",
    "date": "date32",
}

SIGNED = {"int8": 8, "int16": 16, "int32": 32, "int64": 64}
UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
FLOATS = {"float32": 32, "float64": 64}


def is_signed(t: DType) -> bool:
    return t.tag in SIGNED


def is_unsigned(t: DType) -> bool:
    return t.tag in UNSIGNED


def is_integer(t: DType) -> bool:
    return is_signed(t) or is_unsigned(t)


def is_float(t: DType) -> bool:
    return t.tag in FLOATS


def is_decimal(t: DType) -> bool:
    return t.tag in ("decimal128", "decimal256")


def is_numeric(t: DType) -> bool:
    return is_integer(t) or is_float(t)


def integer_range(t: DType) -> tuple[int, int]:
    if is_signed(t):
        half = 1 << (SIGNED[t.tag] - 1)
        return -half, half - 1
    return 0, (1 << UNSIGNED[t.tag]) - 1


def to_spark(t: DType) -> T.DataType:
    if t.tag in CARRIERS:
        return CARRIERS[t.tag]
    if t.tag == "timestamp":
        return T.TimestampType() if len(t.params) > 1 and t.params[1] else T.TimestampNTZType()
    if t.tag in ("time32", "time64"):
        return T.TimeType(6)
    if is_decimal(t):
        p, s = t.params
        if p > 38:
            raise BindError(f"decimal precision {p} is beyond Spark's 38 digits")
        return T.DecimalType(p, s)
    if t.tag in ("list", "large_list", "fixed_size_list", "list_view", "large_list_view"):
        return T.ArrayType(to_spark(t.params[0]))
    if t.tag == "struct":
        return T.StructType([T.StructField(n, to_spark(f)) for n, f in t.params])
    if t.tag == "map":
        return T.MapType(to_spark(t.params[0]), to_spark(t.params[1]))
    raise BindError(f"no Spark type carries {t.tag}")


def from_spark(t: T.DataType) -> DType:
    name = t.simpleString()
    if name in _PLAIN:
        return DType(_PLAIN[name])
    if isinstance(t, T.StringType):
        return UTF8
    if isinstance(t, T.TimestampType):
        return DType("timestamp", ("us", "UTC"))
    if isinstance(t, T.TimestampNTZType):
        return DType("timestamp", ("us", ""))
    if isinstance(t, T.DecimalType):
        return DType("decimal128", (t.precision, t.scale))
    if isinstance(t, T.ArrayType):
        return DType("list", (from_spark(t.elementType),))
    if isinstance(t, T.StructType):
        return DType("struct", tuple((f.name, field_dtype(f)) for f in t.fields))
    if isinstance(t, T.MapType):
        return DType("map", (from_spark(t.keyType), from_spark(t.valueType)))
    if isinstance(t, T.DayTimeIntervalType):
        return DType("duration", ("us",))
    if isinstance(t, T.YearMonthIntervalType):
        return DType("interval_month")
    if name.startswith("time("):
        return DType("time64", ("us",))
    return DType(re.sub(r"\W.*", "", name))


def field_dtype(f: T.StructField) -> DType:
    tag = (f.metadata or {}).get(META)
    if not tag:
        return from_spark(f.dataType)
    plain = from_spark(f.dataType)
    return DType(tag, plain.params)


def metadata_for(t: DType) -> dict | None:
    """Metadata to keep when the carrier alone would forget the tag."""
    return {META: t.tag} if t.tag in CARRIERS and from_spark(CARRIERS[t.tag]).tag != t.tag else None


def parse(name: str | DType) -> DType:
    """``int64``, ``float32``, ``timestamp``, ``decimal128(10,2)`` and the like."""
    if isinstance(name, DType):
        return name
    m = re.fullmatch(r"(\w+)(?:\(([^)]*)\))?", name.strip())
    if not m:
        raise BindError(f"unknown type {name!r}")
    tag, args = m[1], tuple(x.strip() for x in (m[2] or "").split(",") if x.strip())
    tag = {"string": "utf8"}.get(tag, tag)
    if tag.startswith("decimal"):
        args = tuple(int(x) for x in args)
    t = DType(tag, args)
    to_spark(t)
    return t


def is_moment(t: DType) -> bool:
    return t.tag in ("date32", "date64", "timestamp")


def _digits(t: DType) -> tuple[int, int]:
    """Precision and scale of a number in decimal arithmetic."""
    if is_decimal(t):
        return t.params
    return {8: 3, 16: 5, 32: 10, 64: 20}[(SIGNED | UNSIGNED)[t.tag]], 0


def _decimal(a: DType, b: DType, op: str) -> DType:
    """Spark's own result type: all digits if 38 hold them, else at least six decimals."""
    (p, s), (q, r) = _digits(a), _digits(b)
    precision, scale = (p + q + 1, s + r) if op == "*" else (max(p - s, q - r) + max(s, r) + 1, max(s, r))
    if precision > 38:
        precision, scale = 38, max(38 - (precision - scale), min(scale, 6))
    return DType("decimal128", (precision, scale))


def promote(a: DType, b: DType, op: str = "+") -> DType:
    """Type of ``a + b``, ``a - b`` and ``a * b``."""
    for t in (a, b):
        if not is_numeric(t) and not is_decimal(t):
            raise BindError(f"arithmetic needs numbers, not {t.tag}")
    if is_decimal(a) or is_decimal(b):
        return FLOAT64 if is_float(a) or is_float(b) else _decimal(a, b, op)
    if is_float(a) or is_float(b):
        return FLOAT32 if a == b == FLOAT32 else FLOAT64
    if is_signed(a) and is_signed(b):
        return a if SIGNED[a.tag] >= SIGNED[b.tag] else b
    if is_unsigned(a) and is_unsigned(b):
        return a if UNSIGNED[a.tag] >= UNSIGNED[b.tag] else b
    return INT64


def can_compare(a: DType, b: DType) -> bool:
    number = lambda t: is_numeric(t) or is_decimal(t)
    zone = lambda t: bool(t.params[1]) if t.tag == "timestamp" and len(t.params) > 1 else None
    return (number(a) and number(b)) or (a.tag == b.tag and zone(a) == zone(b))
