"""Lowers expressions to Spark columns after checking names and types.

The literal, never the column, is cast, so comparisons reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.errors import BindError
from quernis.functions import expr as x
from quernis.functions import types as t


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def check_unique(names: Sequence[str], what: str = "column") -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise BindError(f"duplicate {what} name {n!r}")
        seen.add(n)


class Binder:
    """Binds expressions against one schema; ``ieee_nan`` makes NaN compare unequal to all."""

    def __init__(self, schema: T.StructType, ieee_nan: bool = False):
        check_unique(schema.names)
        self.types = {f.name: t.field_dtype(f) for f in schema.fields}
        self.ieee_nan = ieee_nan

    def dtype(self, e: x.Expr) -> t.DType:
        return self.bind(e)[1]

    def column(self, e: x.Expr) -> SparkColumn:
        return self.bind(e)[0]

    def promoted(self, e: x.Expr) -> x.Expr:
        """The tree with every open literal in its sibling's type."""

        def change(n: x.Expr) -> x.Expr:
            if not isinstance(n, x.Binary) or n.op not in x.COMPARE | x.ARITH:
                return n
            left, right = n.left, n.right
            if isinstance(left, x.Literal) == isinstance(right, x.Literal):
                return n
            if isinstance(left, x.Literal):
                new = self._adopt(left, self.dtype(right), n.op)
                return n if new is left else x.Binary(n.op, new, right)
            new = self._adopt(right, self.dtype(left), n.op)
            return n if new is right else x.Binary(n.op, left, new)

        return x.rewrite(e, change)

    @staticmethod
    def _adopt(lit: x.Literal, other: t.DType, op: str) -> x.Literal:
        if not lit.fixed and t.is_moment(lit.dtype) and t.is_moment(other) and op in x.COMPARE:
            return x.Literal(x.fit(lit.value, other), other, True)
        if lit.fixed or not t.is_numeric(lit.dtype) or not t.is_numeric(other) or op == "/":
            return lit
        if op in x.COMPARE:
            return x.Literal(x.fit(lit.value, other), other, True)
        if isinstance(lit.value, float):
            return x.Literal(lit.value, other if t.is_float(other) else t.FLOAT64, True)
        try:
            return x.Literal(x.fit(lit.value, other), other, True)
        except BindError:
            return x.Literal(lit.value, lit.dtype, True)

    def bind(self, e: x.Expr) -> tuple[SparkColumn, t.DType]:
        if not isinstance(e, x.Expr):
            raise BindError(f"not an expression: {e!r}")
        return self._bind(self.promoted(e))

    def _bind(self, e: x.Expr) -> tuple[SparkColumn, t.DType]:
        if isinstance(e, x.Column):
            if e.name not in self.types:
                raise BindError(f"unknown column {e.name!r}; there are {', '.join(self.types) or 'none'}")
            return F.col(quoted(e.name)), self.types[e.name]
        if isinstance(e, x.Literal):
            # Moments go as text, so that no local time zone has a say.
            value = str(e.value) if t.is_moment(e.dtype) else e.value
            return F.lit(value).cast(t.to_spark(e.dtype)), e.dtype
        if isinstance(e, x.Alias):
            if not e.name.strip():
                raise BindError("an alias needs a name")
            c, d = self._bind(e.inner)
            return c.alias(e.name), d
        if isinstance(e, x.Cast):
            c, _ = self._bind(e.inner)
            return c.cast(t.to_spark(e.dtype)), e.dtype
        if isinstance(e, x.Agg):
            return self._agg(e)
        if isinstance(e, x.Unary):
            return self._unary(e)
        if isinstance(e, x.Binary):
            return self._binary(e)
        raise BindError(f"unknown expression {type(e).__name__}")

    def _unary(self, e: x.Unary) -> tuple[SparkColumn, t.DType]:
        c, d = self._bind(e.inner)
        if e.op == "is_null":
            return c.isNull(), t.BOOL
        if e.op == "is_not_null":
            return c.isNotNull(), t.BOOL
        if e.op == "not":
            if d != t.BOOL:
                raise BindError(f"not() needs a bool, not {d}")
            return ~c, t.BOOL
        if t.is_unsigned(d):
            return -c.cast("bigint"), t.INT64
        if not t.is_numeric(d) and not t.is_decimal(d):
            raise BindError(f"negation needs a number, not {d}")
        return -c, d

    def _binary(self, e: x.Binary) -> tuple[SparkColumn, t.DType]:
        (a, da), (b, db) = self._bind(e.left), self._bind(e.right)
        if e.op in x.LOGIC:
            if da != t.BOOL or db != t.BOOL:
                raise BindError(f"{e.op} needs bools, not {da} and {db}")
            return (a & b if e.op == "and" else a | b), t.BOOL
        if e.op in x.COMPARE:
            if not t.can_compare(da, db):
                raise BindError(f"cannot compare {da} with {db} in {e}")
            if da == t.BOOL and e.op not in ("==", "!="):
                raise BindError(f"bools have no order in {e}")
            out = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
            if self.ieee_nan and (t.is_float(da) or t.is_float(db)):
                nan = F.lit(False)
                for c, d in ((a, da), (b, db)):
                    nan = nan | F.isnan(c) if t.is_float(d) else nan
                both = a.isNotNull() & b.isNotNull()
                out = F.when(both & nan, F.lit(e.op == "!=")).otherwise(out)
            return out, t.BOOL
        if e.op == "/":
            for d in (da, db):
                if not t.is_numeric(d) and not t.is_decimal(d):
                    raise BindError(f"division needs numbers, not {d}")
            return a.cast("double") / b.cast("double"), t.FLOAT64
        d = t.promote(da, db, e.op)
        if not t.is_decimal(d):
            carrier = t.to_spark(d)
            a, b = (c if t.to_spark(k) == carrier else c.cast(carrier) for c, k in ((a, da), (b, db)))
        out = {"+": a + b, "-": a - b, "*": a * b}[e.op]
        return (out.cast(t.to_spark(d)) if t.is_unsigned(d) or t.is_decimal(d) else out), d

    def _agg(self, e: x.Agg) -> tuple[SparkColumn, t.DType]:
        if x.has_agg(e.inner):
            raise BindError(f"nested aggregate in {e}")
        c, d = self._bind(e.inner)
        if e.op == "count":
            return F.count(c), t.INT64
        if e.op in ("sum", "mean") and not t.is_numeric(d) and not t.is_decimal(d):
            raise BindError(f"{e.op} needs a number, not {d}")
        if e.op == "mean":
            return F.avg(c.cast("double")), t.FLOAT64
        if e.op == "sum":
            if t.is_float(d):
                return F.sum(c.cast("double")), t.FLOAT64
            if t.is_unsigned(d):
                return F.sum(c.cast("decimal(20,0)")).cast("decimal(20,0)"), t.UINT64
            return F.sum(c), (d if t.is_decimal(d) else t.INT64)
        return (F.min(c) if e.op == "min" else F.max(c)), d

    def named(self, e: x.Expr) -> SparkColumn:
        """The bound column under its output name, with its tag in the metadata where Spark needs it."""
        c, d = self.bind(e)
        meta = t.metadata_for(d)
        return c.alias(x.output_name(e), metadata=meta) if meta else c.alias(x.output_name(e))
