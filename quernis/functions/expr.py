"""The closed expression language: columns, literals, operators, aggregates.

Trees are immutable; :class:`Expr` methods build them, ``str()`` prints them and
:mod:`quernis.plans.binder` lowers them to Spark columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace

from quernis.errors import BindError
from quernis.functions import types as t

COMPARE = {"==", "!=", "<", "<=", ">", ">="}
LOGIC = {"and", "or"}
ARITH = {"+", "-", "*", "/"}


class Expr:
    def eq(self, o):
        return Binary("==", self, wrap(o))

    def neq(self, o):
        return Binary("!=", self, wrap(o))

    def lt(self, o):
        return Binary("<", self, wrap(o))

    def lte(self, o):
        return Binary("<=", self, wrap(o))

    def gt(self, o):
        return Binary(">", self, wrap(o))

    def gte(self, o):
        return Binary(">=", self, wrap(o))

    def and_(self, o):
        return Binary("and", self, wrap(o))

    def or_(self, o):
        return Binary("or", self, wrap(o))

    def add(self, o):
        return Binary("+", self, wrap(o))

    def sub(self, o):
        return Binary("-", self, wrap(o))

    def mul(self, o):
        return Binary("*", self, wrap(o))

    def div(self, o):
        return Binary("/", self, wrap(o))

    def not_(self):
        return Unary("not", self)

    def neg(self):
        return Unary("-", self)

    def is_null(self):
        return Unary("is_null", self)

    def is_not_null(self):
        return Unary("is_not_null", self)

    def count(self):
        return Agg("count", self)

    def sum(self):
        return Agg("sum", self)

    def mean(self):
        return Agg("mean", self)

    def min(self):
        return Agg("min", self)

    def max(self):
        return Agg("max", self)

    def alias(self, name: str):
        return Alias(self, name)

    def cast(self, dtype):
        return Cast(self, t.parse(dtype))

    __gt__, __ge__, __lt__, __le__ = gt, gte, lt, lte
    __add__, __sub__, __mul__, __truediv__ = add, sub, mul, div
    __and__, __or__, __invert__, __neg__ = and_, or_, not_, neg

    def __radd__(self, o):
        return wrap(o).add(self)

    def __rsub__(self, o):
        return wrap(o).sub(self)

    def __rmul__(self, o):
        return wrap(o).mul(self)

    def __rtruediv__(self, o):
        return wrap(o).div(self)

    def __bool__(self):
        raise BindError("an expression has no truth value; use & | ~ instead of and, or, not")

    def children(self) -> tuple[Expr, ...]:
        return ()

    def rebuild(self, kids: tuple[Expr, ...]) -> Expr:
        return self


@dataclass(frozen=True)
class Column(Expr):
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    dtype: t.DType
    #: False if the type was inferred, so that a sibling's type may replace it.
    fixed: bool = False

    def __str__(self):
        if isinstance(self.value, str):
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(self.value, bool):
            return str(self.value).lower()
        if isinstance(self.value, datetime.date):
            return f'{self.dtype} "{self.value}"'
        return format(self.value, ".17g") if isinstance(self.value, float) and self.value != int_or_none(self.value) and len(repr(self.value)) > 17 else number_text(self.value)


def int_or_none(v: float):
    return int(v) if v == v and abs(v) != float("inf") and v == int(v) else None


def number_text(v) -> str:
    if isinstance(v, float):
        n = int_or_none(v)
        return str(n) if n is not None and abs(n) < 10**15 else repr(v)
    return str(v)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def rebuild(self, kids):
        return replace(self, left=kids[0], right=kids[1])

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    inner: Expr

    def children(self):
        return (self.inner,)

    def rebuild(self, kids):
        return replace(self, inner=kids[0])

    def __str__(self):
        return f"{self.op}({self.inner})"


@dataclass(frozen=True)
class Agg(Unary):
    pass


@dataclass(frozen=True)
class Alias(Expr):
    inner: Expr
    name: str

    def children(self):
        return (self.inner,)

    def rebuild(self, kids):
        return replace(self, inner=kids[0])

    def __str__(self):
        return f"{self.inner} as {self.name}"


@dataclass(frozen=True)
class Cast(Expr):
    inner: Expr
    dtype: t.DType

    def children(self):
        return (self.inner,)

    def rebuild(self, kids):
        return replace(self, inner=kids[0])

    def __str__(self):
        return f"cast({self.inner} as {self.dtype})"


def col(name: str) -> Column:
    return Column(name)


def lit(value) -> Literal:
    """A literal of inferred type: bool, int64, float64, utf8, date32 or timestamp (of UTC if the value has a zone)."""
    if isinstance(value, bool):
        return Literal(value, t.BOOL, True)
    if isinstance(value, int):
        lo, hi = t.integer_range(t.INT64)
        if lo <= value <= hi:
            return Literal(value, t.INT64)
        if value <= t.integer_range(t.UINT64)[1]:
            return Literal(value, t.UINT64)
        raise BindError(f"literal {value} fits no integer type")
    if isinstance(value, float):
        return Literal(value, t.FLOAT64)
    if isinstance(value, str):
        return Literal(value, t.UTF8, True)
    if isinstance(value, datetime.datetime):
        return Literal(value, t.DType("timestamp", ("us", "UTC" if value.tzinfo else "")))
    if isinstance(value, datetime.date):
        return Literal(value, t.DATE32)
    raise BindError(f"no literal type for {type(value).__name__}; use is_null() to test for nulls")


def typed(value, dtype) -> Literal:
    """A literal of a stated type; the value must fit it without loss."""
    d = t.parse(dtype)
    return Literal(fit(value, d), d, True)


def fit(value, d: t.DType):
    """``value`` as a ``d``, or an error: no wrapping and no truncation."""
    if isinstance(value, datetime.date):
        return _fit_moment(value, d)
    if isinstance(value, bool) or isinstance(value, str) or value is None:
        if (d.tag, type(value)) in (("bool", bool), ("utf8", str)):
            return value
        raise BindError(f"literal {value!r} is no {d.tag}")
    if t.is_integer(d):
        if isinstance(value, float) and int_or_none(value) is None:
            raise BindError(f"literal {value!r} would lose its fraction as {d.tag}")
        n, (lo, hi) = int(value), t.integer_range(d)
        if not lo <= n <= hi:
            raise BindError(f"literal {value!r} is out of the range of {d.tag}")
        return n
    if t.is_float(d):
        return float(value)
    if t.is_decimal(d):
        return value
    raise BindError(f"literal {value!r} is no {d.tag}")


def _fit_moment(value: datetime.date, d: t.DType):
    """A day is its first moment; a moment is a day only if it is that one; times with and without a zone don't mix."""
    if not t.is_moment(d):
        raise BindError(f"literal {value} is no {d.tag}")
    if not isinstance(value, datetime.datetime):
        if d.tag != "timestamp":
            return value
        value = datetime.datetime(value.year, value.month, value.day, tzinfo=datetime.UTC if d.params[1:] and d.params[1] else None)
    if d.tag != "timestamp":
        if value.tzinfo or value.time() != datetime.time():
            raise BindError(f"literal {value} would lose its time as {d.tag}")
        return value.date()
    if bool(value.tzinfo) != bool(d.params[1:] and d.params[1]):
        raise BindError(f"literal {value} {'has a' if value.tzinfo else 'needs a'} time zone beside a {'plain' if value.tzinfo else 'zoned'} timestamp")
    return value


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def walk(e: Expr, visit: Callable[[Expr], None]) -> None:
    """Children first, then the node."""
    for c in e.children():
        walk(c, visit)
    visit(e)


def rewrite(e: Expr, change: Callable[[Expr], Expr]) -> Expr:
    """Bottom-up; untouched subtrees keep their identity."""
    kids = e.children()
    new = tuple(rewrite(c, change) for c in kids)
    return change(e if all(a is b for a, b in zip(kids, new, strict=True)) else e.rebuild(new))


def columns_of(e: Expr) -> list[str]:
    found: dict[str, None] = {}
    walk(e, lambda x: found.setdefault(x.name) if isinstance(x, Column) else None)
    return list(found)


def has_agg(e: Expr) -> bool:
    found = []
    walk(e, lambda x: found.append(x) if isinstance(x, Agg) else None)
    return bool(found)


def output_name(e: Expr) -> str:
    return e.name if isinstance(e, (Alias, Column)) else str(e)
