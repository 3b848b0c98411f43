"""CSV and Parquet: lazy reading, chunked scanning and writing with full options."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.errors import BindError, QuernisError
from quernis.functions import types as t
from quernis.operators.frame import Frame
from quernis.plans.binder import quoted
from quernis.sources.memory import select_in_order

#: The tokens that mean null when CSV null parsing is on and no list is given.
NULL_TOKENS = ("", "NULL", "null")


@dataclass(frozen=True)
class CsvOptions:
    """Options of reading, scanning and writing; each is used where it applies."""

    header: bool = True
    #: Rows in a batch of ``Frame.iter_batches``; Spark sizes its own batches otherwise.
    chunk_size: int | None = None
    null_values: Sequence[str] | None = None
    null_value: str = ""
    column_types: dict[str, str | t.DType] = field(default_factory=dict)
    include_columns: Sequence[str] | None = None
    comma: str = ","
    comment: str | None = None
    lazy_quotes: bool = False
    #: Pairs of text and replacement, applied to string columns in this order.
    replace: Sequence[tuple[str, str]] = ()
    use_crlf: bool = False
    #: Formats booleans when writing: (true text, false text).
    bool_texts: tuple[str, str] | None = None
    allow_nullable: bool = True
    #: A full schema, where it is known: saves the pass that infers types. With one
    #: null token at most and nothing to replace, values are parsed as they are read
    #: and filters reach the reader.
    schema: T.StructType | None = None
    #: Whether a quoted cell may hold line breaks. A file is then read by one task;
    #: switch it off for large files without such cells, which then split.
    multi_line: bool = True


def _path(path: str) -> str:
    if not path:
        raise QuernisError("the path is empty")
    return path


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> Frame:
    """A CSV file or folder. Integers are inferred as int64; types can be stated for some columns or all."""
    o = options or CsvOptions()
    reader = spark.read.options(header=o.header, sep=o.comma, quote='"', escape='"', mode="PERMISSIVE" if o.lazy_quotes else "FAILFAST", unescapedQuoteHandling="STOP_AT_DELIMITER" if o.lazy_quotes else "RAISE_ERROR", enforceSchema=True)
    if o.comment:
        reader = reader.option("comment", o.comment)
    tokens = list(NULL_TOKENS if o.null_values is None else o.null_values)
    one = tokens[0] if len(tokens) == 1 else ""
    # Unless an escape of quotes' escapes is named, the parser takes NUL for one and drops it before quotes and line breaks.
    reader = reader.option("nullValue", one).option("multiLine", o.multi_line).option("charToEscapeQuoteEscaping", '"')
    if o.schema is not None:
        schema = o.schema
    else:
        schema = _inferred(reader.csv(_path(path)), tokens)
    for c, d in o.column_types.items():
        if c not in schema.names:
            raise BindError(f"unknown column {c!r} in column_types")
        schema = T.StructType([T.StructField(f.name, t.to_spark(t.parse(d)), True, t.metadata_for(t.parse(d)) or {}) if f.name == c else f for f in schema.fields])
    if o.schema is not None and len(tokens) <= 1 and not o.replace and not any(_padded(f.dataType) for f in schema.fields):
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        df = reader.schema(plain).csv(_path(path))
        cols = [F.col(quoted(f.name)).alias(f.name, metadata=f.metadata or {}) for f in schema.fields]
        return _framed(df.select(cols), o)
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = reader.schema(strings).csv(_path(path))
    cols = []
    for f in schema.fields:
        c = F.col(quoted(f.name))
        for a, b in o.replace:
            c = F.replace(c, F.lit(a), F.lit(b))
        c = F.when(c.isin(tokens), None).otherwise(c)
        cols.append((c if isinstance(f.dataType, T.StringType) else c.cast(f.dataType)).alias(f.name, metadata=f.metadata or {}))
    return _framed(df.select(cols), o)


def _padded(d: T.DataType) -> bool:
    """Types that the reader itself parses by other rules than a cast."""
    return isinstance(d, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType, T.TimeType)) or not isinstance(d, T.AtomicType)


def _framed(df: DataFrame, o: CsvOptions) -> Frame:
    out = select_in_order(df, list(o.include_columns or []))
    return Frame(_strict(out) if not o.allow_nullable else out, source="csv", batch_rows=o.chunk_size)


#: Reading is lazy, so a scan is a read; the two share null handling and options.
scan_csv = read_csv


def _inferred(raw: DataFrame, tokens: list[str]) -> T.StructType:
    """Types by one aggregate over all values: the narrowest of int64, float64, timestamp, bool that holds them."""
    text = [F.when(~F.col(quoted(c)).isin(tokens), F.col(quoted(c))) for c in raw.columns]
    fits = lambda ok: F.coalesce(F.bool_and(ok), F.lit(False))
    tests = [
        (T.LongType(), lambda c: c.try_cast("bigint").isNotNull()),
        (T.DoubleType(), lambda c: c.try_cast("double").isNotNull()),
        (T.TimestampType(), lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}") & c.try_cast("timestamp").isNotNull()),
        (T.BooleanType(), lambda c: F.lower(c).isin("true", "false")),
    ]
    asked = [fits(F.when(c.isNotNull(), test(c))).alias(f"c{i}_{k}") for i, c in enumerate(text) for k, (_, test) in enumerate(tests)]
    row = raw.select(asked).first() if asked else ()
    kind = lambda i: next((d for k, (d, _) in enumerate(tests) if row[i * len(tests) + k]), T.StringType())
    return T.StructType([T.StructField(c, kind(i)) for i, c in enumerate(raw.columns)])


def _strict(df: DataFrame) -> DataFrame:
    """The same rows in columns that cannot be null; a null then fails the job."""
    checked = [F.coalesce(F.col(quoted(f.name)), F.raise_error(F.lit(f"null in column {f.name}")).cast(f.dataType), _zero(f.dataType)).alias(f.name, metadata=f.metadata or {}) for f in df.schema.fields]
    return df.select(checked)


def _zero(d: T.DataType):
    """A literal that is never reached; it makes the column's type non-null."""
    kinds = {"string": F.lit(""), "boolean": F.lit(False), "binary": F.lit(b"")}
    name = d.simpleString()
    if name in kinds:
        return kinds[name]
    if isinstance(d, T.NumericType):
        return F.lit(0).cast(d)
    if isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(d)
    raise BindError(f"allow_nullable=False is not supported for {name}")


def write_csv(frame: Frame, path: str, options: CsvOptions | None = None, single_file: bool = False) -> None:
    """Overwrites ``path``: a folder written in parallel, or one file for small results."""
    o = options or CsvOptions()
    if frame is None:
        raise QuernisError("no frame to write")
    cols = []
    for f in frame.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.BooleanType) and o.bool_texts:
            c = F.when(c, o.bool_texts[0]).when(~c, o.bool_texts[1])
        if isinstance(f.dataType, T.StringType):
            for a, b in o.replace:
                c = F.replace(c, F.lit(a), F.lit(b))
        cols.append(c.alias(f.name))
    df = frame.spark.select(cols)
    # Spark's writer cuts white space and control characters off both ends of a cell unless told not to.
    w = {"header": o.header, "sep": o.comma, "nullValue": o.null_value, "escape": '"', "emptyValue": '""', "lineSep": "\r\n" if o.use_crlf else "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _write(df, _path(path), single_file, lambda d, p: d.write.mode("overwrite").options(**w).csv(p))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, allow_nullable: bool = True, schema: T.StructType | None = None, merge_schema: bool = False) -> Frame:
    """Parquet; filters and column choices made later reach the scan. A declared schema is checked against the file's."""
    df = spark.read.option("mergeSchema", merge_schema).parquet(_path(path))
    for f in schema.fields if schema else []:
        if f.name not in df.columns or df.schema[f.name].dataType != f.dataType:
            raise BindError(f"the file has no column {f.name!r} of type {f.dataType.simpleString()}")
    if schema:
        df = select_in_order(df, schema.names)
    df = select_in_order(df, list(columns or []))
    return Frame(df if allow_nullable else _strict(df), source="parquet")


scan_parquet = read_parquet


def write_parquet(frame: Frame, path: str, compression: str = "snappy", block_size: int | None = None, partition_by: Sequence[str] = (), single_file: bool = False) -> None:
    if frame is None:
        raise QuernisError("no frame to write")
    opts = {"compression": compression} | ({"parquet.block.size": block_size} if block_size else {})
    _write(frame.spark, _path(path), single_file, lambda d, p: d.write.mode("overwrite").options(**opts).parquet(p, partitionBy=list(partition_by) or None))


def _write(df: DataFrame, path: str, single: bool, write: Callable[[DataFrame, str], None]) -> None:
    if not single:
        return write(df, path)
    # One task writes one part file beside the target; Hadoop's own rename puts it there.
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = f"{path}.parts"
    write(df.coalesce(1), made)
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(made)
    fs = target.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    # The old file goes only when the new one is in its place.
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(old, True)
    had = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(part, target):
        if had:
            fs.rename(old, target)
        raise QuernisError(f"could not move the file to {path}")
    fs.delete(old, True)
    fs.delete(folder, True)
    return None
