"""Text tables: at most ten rows from either end, widths over the whole column."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.functions import types as t
from quernis.plans.binder import quoted

EDGE = 10
# Short labels; other types print their tag.
LABELS = {"utf8": "str", "int32": "i32", "int64": "i64", "float32": "f32", "float64": "f64", "bool": "bool"}
SHOWN = {"null", "bool", "int32", "int64", "float32", "float64", "utf8", "timestamp", "date32", "date64"}


def float_text(v: float, single: bool = False) -> str:
    """Shortest form without an exponent; whole numbers have no point."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    if single:
        import numpy as np

        return np.format_float_positional(np.float32(v), trim="-")
    text = format(Decimal(repr(v)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def cell(v, d: t.DType) -> str:
    if v is None:
        return "null"
    if d.tag not in SHOWN:
        return "<unsupported>"
    if d.tag == "bool":
        return "true" if v else "false"
    if t.is_float(d):
        return float_text(v, d.tag == "float32")
    if d.tag == "timestamp":
        return v.replace(microsecond=0, tzinfo=None).isoformat() + "Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _ends(df: DataFrame, total: int) -> list:
    if total <= 2 * EDGE:
        return df.collect()
    return df.limit(EDGE).collect() + df.tail(EDGE)


def render(df: DataFrame | None, series: bool = False) -> str:
    """The table; widths of strings and integers cover all rows, of other types the rows shown."""
    if df is None:
        return "<nil>"
    fields = df.schema.fields
    kinds = [t.field_dtype(f) for f in fields]
    wide = [F.max(F.char_length(F.col(quoted(f.name)).cast("string"))) if d.tag in ("utf8", "int32", "int64") else F.lit(0) for f, d in zip(fields, kinds, strict=True)]
    df = df.select([F.to_utc_timestamp(F.col(quoted(f.name)), F.current_timezone()).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(quoted(f.name)) for f in fields])
    stats = df.agg(F.count(F.lit(1)), *wide).first()
    total, rows = stats[0], _ends(df, stats[0])
    body = [[cell(v, d) for v, d in zip(r, kinds, strict=True)] for r in rows]
    head = [[f.name for f in fields], ["---"] * len(fields), [LABELS.get(d.tag, d.tag) for d in kinds]]
    widths = [max(len(r[i]) for r in (*head, *body)) for i in range(len(fields))]
    widths = [max(w, n or 0) for w, n in zip(widths, stats[1:], strict=True)]
    if total > 2 * EDGE:
        body = [*body[:EDGE], ["…"] * len(fields), *body[EDGE:]]
    rule = lambda a, line, b, c: a + b.join(line * (w + 2) for w in widths) + c
    line = lambda r: "│" + "│".join(f" {v}{' ' * (w - len(v))} " for v, w in zip(r, widths, strict=True)) + "│"
    shape = f"shape: ({total},)" if series else f"shape: ({total}, {len(fields)})"
    return "\n".join([shape, rule("┌", "─", "┬", "┐"), *map(line, head), rule("╞", "═", "╪", "╡"), *map(line, body), rule("└", "─", "┴", "┘")])
