"""Frame and Series: immutable wrappers that validate, then delegate to Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.errors import BindError, QuernisError
from quernis.functions import expr as x
from quernis.functions import types as t
from quernis.plans import logical
from quernis.plans.binder import Binder, check_unique, quoted

JOINS = ("inner", "left", "right", "outer")
#: Spark's own limit takes a 32-bit int.
MAX_LIMIT = 2**31 - 1


class Frame:
    def __init__(self, df: DataFrame, plan: logical.Node | None = None, source: str = "dataframe", batch_rows: int | None = None):
        if df is None:
            raise QuernisError("no dataframe")
        check_unique(df.columns)
        self._df = df
        self._batch_rows = batch_rows
        self._plan = plan or logical.Node("Scan", f"source={source}")

    # -- inspection -----------------------------------------------------
    @property
    def spark(self) -> DataFrame:
        return self._df

    to_spark = spark

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def schema(self) -> T.StructType:
        return self._df.schema

    @property
    def dtypes(self) -> dict[str, t.DType]:
        return {f.name: t.field_dtype(f) for f in self._df.schema.fields}

    @property
    def width(self) -> int:
        return len(self._df.columns)

    def height(self) -> int:
        return self._df.count()

    def field_index(self, name: str) -> int:
        if name not in self._df.columns:
            raise BindError(f"unknown column {name!r}")
        return self._df.columns.index(name)

    def column(self, name: str) -> Series:
        self.field_index(name)
        return Series(self._df.select(F.col(quoted(name))))

    def describe_schema(self) -> str:
        return f"Schema(fields={self.width})"

    def explain(self) -> str:
        return logical.explain(self._plan)

    def explain_spark(self, mode: str = "formatted") -> None:
        self._df.explain(mode)

    def binder(self, **options) -> Binder:
        return Binder(self._df.schema, **options)

    def _next(self, df: DataFrame, kind: str, detail: str, *more: logical.Node) -> Frame:
        return Frame(df, self._plan.then(kind, detail, *more), batch_rows=self._batch_rows)

    # -- relational operators -------------------------------------------
    def select(self, *columns: str) -> Frame:
        """Columns by exact name, in the given order."""
        if not columns:
            raise BindError("select needs a column")
        check_unique(columns)
        for c in columns:
            if not isinstance(c, str) or not c:
                raise BindError("select takes column names; project takes expressions")
            self.field_index(c)
        return self._next(self._df.select(*[F.col(quoted(c)) for c in columns]), "Project", f"columns=[{', '.join(columns)}]")

    def pick(self, *indices: int) -> Frame:
        """Columns by position."""
        for i in indices:
            if not 0 <= i < self.width:
                raise BindError(f"column index {i} is out of range")
        return self.select(*[self.columns[i] for i in indices])

    def project(self, *exprs: x.Expr) -> Frame:
        """Expressions into a new set of columns."""
        if not exprs:
            raise BindError("project needs an expression")
        check_unique([x.output_name(e) for e in exprs])
        for e in exprs:
            if x.has_agg(e):
                raise BindError(f"aggregate {e} outside group_by or aggregate")
        b = self.binder()
        return self._next(self._df.select(*[b.named(e) for e in exprs]), "Project", f"columns=[{', '.join(map(str, exprs))}]")

    def with_column(self, name: str, e: x.Expr) -> Frame:
        """Adds a column, or replaces the one of that name in its place."""
        if x.has_agg(e):
            raise BindError(f"aggregate {e} outside group_by or aggregate")
        new = self.binder().named(x.Alias(e, name))
        kept = [new if c == name else F.col(quoted(c)) for c in self.columns]
        return self._next(self._df.select(*kept, *([] if name in self.columns else [new])), "WithColumn", f"{name}={e}")

    def filter(self, predicate: x.Expr, ieee_nan: bool = False) -> Frame:
        """Rows for which the predicate is true; null counts as false."""
        if predicate is None:
            raise BindError("filter needs a predicate")
        if isinstance(predicate, x.Expr) and x.has_agg(predicate):
            raise BindError(f"aggregate in the predicate {predicate}")
        c, d = self.binder(ieee_nan=ieee_nan).bind(predicate)
        if d != t.BOOL:
            raise BindError(f"the predicate {predicate} is {d}, not bool")
        return self._next(self._df.filter(c), "Filter", f"predicate={predicate}")

    def limit(self, n: int) -> Frame:
        """The first ``n`` rows in source order; sort first where the order matters."""
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise BindError(f"limit needs an integer of at least 0, not {n!r}")
        if n > MAX_LIMIT:
            if self._df.count() > n:
                raise QuernisError(f"limit {n} is beyond {MAX_LIMIT} and the frame has more rows")
            return self._next(self._df, "Limit", f"n={n}")
        return self._next(self._df.limit(n), "Limit", f"n={n}")

    def sort(self, *keys: str | x.Expr, descending: bool | Sequence[bool] = False) -> Frame:
        """Total order by the keys; nulls come first ascending, last descending."""
        if not keys:
            raise BindError("sort needs a key")
        b = self.binder()
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise BindError("one descending flag for each key, or one for all")
        cols = [b.column(x.col(k) if isinstance(k, str) else k) for k in keys]
        text = ", ".join(f"{k}{' desc' if d else ''}" for k, d in zip(keys, down, strict=True))
        return self._next(self._df.orderBy(*[c.desc() if d else c.asc() for c, d in zip(cols, down, strict=True)]), "Sort", f"keys=[{text}]")

    def group_by(self, *keys: str | x.Expr) -> Grouped:
        if not keys:
            raise BindError("group_by needs a key; use aggregate for the whole frame")
        return Grouped(self, [x.col(k) if isinstance(k, str) else k for k in keys])

    def aggregate(self, *aggs: x.Expr) -> Frame:
        """One row for the whole frame."""
        return Grouped(self, []).agg(*aggs)

    def join(self, other: Frame, on: str | Sequence[str], how: str = "inner", suffix: str | None = None) -> Frame:
        """Equi-join on common names: keys once and first, then left, then right columns.

        Null keys match nothing. Other names that clash need ``suffix``, which
        goes to the right side's columns. Catalyst and AQE choose the strategy.
        """
        on = [on] if isinstance(on, str) else list(on)
        if how not in JOINS:
            raise BindError(f"join is one of {', '.join(JOINS)}, not {how!r}")
        if not on:
            raise BindError("join needs a key")
        check_unique(on, "key")
        mine, theirs = self.dtypes, other.dtypes
        for k in on:
            for side in (mine, theirs):
                if k not in side:
                    raise BindError(f"unknown join key {k!r}")
            if not t.can_compare(mine[k], theirs[k]):
                raise BindError(f"join key {k!r} is {mine[k]} on the left and {theirs[k]} on the right")
        names = {}
        for c in (c for c in other.columns if c not in on):
            names[c] = c + suffix if c in self.columns and suffix else c
            if names[c] in self.columns:
                raise BindError(f"both sides have a column {c!r}; give a suffix")
        check_unique([*self.columns, *names.values()])
        left = self._df.select([F.col(quoted(c)).alias(f"l{i}") for i, c in enumerate(self.columns)])
        right = other._df.select([F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(other.columns)])
        at_l, at_r = self.columns.index, other.columns.index
        cond = None
        for k in on:
            c = left[f"l{at_l(k)}"] == right[f"r{at_r(k)}"]
            cond = c if cond is None else cond & c
        key = lambda k: {"right": F.col(f"r{at_r(k)}"), "outer": F.coalesce(f"l{at_l(k)}", f"r{at_r(k)}")}.get(how, F.col(f"l{at_l(k)}")).alias(k)
        out = left.join(right, cond, how).select(
            *[key(k) for k in on],
            *[F.col(f"l{i}").alias(c) for i, c in enumerate(self.columns) if c not in on],
            *[F.col(f"r{i}").alias(names[c]) for i, c in enumerate(other.columns) if c not in on],
        )
        return self._next(out, "Join", f"how={how}, on=[{', '.join(on)}]", other._plan)

    # -- batches ----------------------------------------------------------
    def map_batches(self, fn, schema: T.StructType | str | None = None) -> Frame:
        """``fn(pa.RecordBatch) -> pa.RecordBatch`` with the declared schema (this frame's by default)."""
        from quernis.operators.batch import map_batches

        return self._next(map_batches(self._df, fn, schema), "Map", getattr(fn, "__name__", "fn"))

    def filter_batches(self, mask, nulls: str = "drop") -> Frame:
        """``mask(pa.RecordBatch) -> bool array``; a null entry drops the row, or gives a row of nulls with ``nulls="emit"``."""
        from quernis.operators.batch import filter_batches

        return self._next(filter_batches(self._df, mask, nulls), "Filter", f"mask={getattr(mask, '__name__', 'fn')}")

    def transform(self, fn) -> Frame:
        """A user operator: Frame to Frame."""
        out = fn(self)
        if not isinstance(out, Frame):
            raise QuernisError("an operator returns a Frame")
        return out

    def iter_batches(self, rows: int | None = None) -> Iterator[pa.RecordBatch]:
        """Record batches of at most ``rows`` rows (by default the source's chunk size), partition after partition: never the whole frame at once."""
        from quernis.operators.batch import iter_batches

        return iter_batches(self._df, self._batch_rows if rows is None else rows)

    def should_rechunk(self) -> bool:
        return False

    def rechunk(self) -> Frame:
        """Spark sizes its own batches, so there is nothing to do."""
        return self

    # -- results ----------------------------------------------------------
    def collect(self) -> list:
        return self._df.collect()

    def to_arrow(self) -> pa.Table:
        return self._df.toArrow()

    def to_numpy(self, *columns: str):
        """Columns as one matrix on the driver; nulls become NaN. For results that fit the driver."""
        frame = self.select(*columns) if columns else self
        for n, d in frame.dtypes.items():
            if not t.is_numeric(d):
                raise BindError(f"column {n!r} is {d}, not a number")
        return frame._df.toPandas().to_numpy(dtype="float64")

    def __str__(self) -> str:
        from quernis.operators.display import render

        return render(self._df)

    @staticmethod
    def from_arrow(spark: SparkSession, data, schema: pa.Schema | None = None) -> Frame:
        from quernis.sources.memory import from_arrow

        return Frame(from_arrow(spark, data, schema))


class Grouped:
    def __init__(self, frame: Frame, keys: list[x.Expr]):
        self.frame, self.keys = frame, keys

    def agg(self, *aggs: x.Expr) -> Frame:
        """Keys, then aggregates. A null key is a group; partial sums are built before the shuffle."""
        if not aggs:
            raise BindError("agg needs an aggregate")
        check_unique([x.output_name(e) for e in (*self.keys, *aggs)])
        for k in self.keys:
            if x.has_agg(k):
                raise BindError(f"aggregate {k} as a key")
        for a in aggs:
            inner = a.inner if isinstance(a, x.Alias) else a
            if not isinstance(inner, x.Agg):
                raise BindError(f"{a} is no aggregate")
        b = self.frame.binder()
        cols = [b.named(a) for a in aggs]
        df = self.frame._df
        out = df.groupBy(*[b.named(k) for k in self.keys]).agg(*cols) if self.keys else df.agg(*cols)
        return self.frame._next(out, "Aggregate", f"keys=[{', '.join(map(str, self.keys))}], aggs=[{', '.join(map(str, aggs))}]")


class Series:
    """One named column."""

    def __init__(self, df: DataFrame):
        if len(df.columns) != 1 or not df.columns[0]:
            raise QuernisError("a series is one named column")
        self._df = df

    @property
    def name(self) -> str:
        return self._df.columns[0]

    @property
    def dtype(self) -> t.DType:
        return t.field_dtype(self._df.schema[0])

    @property
    def spark(self) -> DataFrame:
        return self._df

    def __len__(self) -> int:
        return self._df.count()

    def values(self) -> list:
        return [r[0] for r in self._df.collect()]

    def frame(self) -> Frame:
        return Frame(self._df)

    def __str__(self) -> str:
        from quernis.operators.display import render

        return render(self._df, series=True)


def concat_columns(spark: SparkSession, columns: Iterable) -> Frame:
    """A frame from in-memory columns (:class:`quernis.sources.memory.Values`) of equal length."""
    from quernis.sources.memory import frame_of

    return Frame(frame_of(spark, list(columns)))
