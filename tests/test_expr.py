import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quernis.errors import BindError
from quernis.functions import expr as x
from quernis.functions import types as t
from quernis.functions.expr import col, lit, typed
from quernis.operators.frame import Frame
from quernis.plans.binder import Binder

#: Tickets of a ferry: fare, seats, harbour, number, day and moment of sale, deposit, weight.
TICKETS = T.StructType(
    [T.StructField(n, k) for n, k in (("fare", T.DoubleType()), ("seats", T.LongType()), ("harbour", T.StringType()), ("ticket", T.LongType()), ("day", T.DateType()), ("sold", T.TimestampNTZType()), ("seen", T.TimestampType()), ("deposit", T.DecimalType(10, 2)), ("tax", T.DecimalType(12, 4)), ("weight", T.FloatType()))]
)
DAY = datetime.date(2024, 2, 29)


@pytest.fixture(scope="module")
def b(spark):
    return Binder(TICKETS)


@pytest.mark.parametrize(
    ("e", "text", "kind"),
    [
        (col("seats").lte(4).or_(col("harbour").neq("Oban")), '((seats <= 4) or (harbour != "Oban"))', "bool"),
        (col("fare").sub(2.75).alias("off_peak"), "(fare - 2.75) as off_peak", "float64"),
        (col("seats").mul(col("fare")).alias("takings"), "(seats * fare) as takings", "float64"),
        (col("seats").sum().alias("boarded"), "sum(seats) as boarded", "int64"),
        (col("fare").mean().alias("usual"), "mean(fare) as usual", "float64"),
        (col("harbour").min(), "min(harbour)", "utf8"),
        (col("fare").max(), "max(fare)", "float64"),
        (col("harbour").count().alias("calls"), "count(harbour) as calls", "int64"),
        (col("ticket").eq(7).not_(), "not((ticket == 7))", "bool"),
        (col("seats").cast("float32"), "cast(seats as float32)", "float32"),
        (col("fare").is_null(), "is_null(fare)", "bool"),
        (col("ticket").is_not_null(), "is_not_null(ticket)", "bool"),
        (col("fare").neg(), "-(fare)", "float64"),
        (col("seats").div(3), "(seats / 3)", "float64"),
        (col("ticket").sub(5).add(9), "((ticket - 5) + 9)", "int64"),
        (col("seats").mul(0.25), "(seats * 0.25)", "float64"),
        (col("weight").mul(1.1), "(weight * 1.1)", "float32"),
        (col("weight").add(1), "(weight + 1)", "float32"),
        (col("day").gte(DAY), '(day >= date32 "2024-02-29")', "bool"),
        (col("sold").lt(DAY), '(sold < date32 "2024-02-29")', "bool"),
        (col("seen").gt(datetime.datetime(2024, 2, 29, 6, tzinfo=datetime.UTC)), '(seen > timestamp "2024-02-29 06:00:00+00:00")', "bool"),
    ],
)
def test_print_and_type(b, e, text, kind):
    assert str(e) == text
    assert b.dtype(e).tag == kind


@pytest.mark.parametrize(
    "e",
    [
        col("harbour").lt(3),
        col("pier").eq(1),
        col("seats").or_(col("harbour").eq("a")),
        col("harbour").mul(2),
        col("harbour").sum(),
        col("harbour").mean(),
        col("harbour").neg(),
        col("fare").not_(),
        col("fare").alias(" "),
        col("fare").max().min(),
        col("ticket").eq(0.5),
        col("ticket").eq(-(2**63) - 1),
        typed(False, "bool").lt(True),
        col("harbour").div(4),
        col("day").eq("2024-02-29"),
        col("day").lt(datetime.datetime(2024, 2, 29, 1)),
        col("sold").lt(datetime.datetime(2024, 2, 29, tzinfo=datetime.UTC)),
        col("seen").lt(datetime.datetime(2024, 2, 29)),
        col("sold").eq(col("seen")),
        col("seats").gt(DAY),
    ],
)
def test_rejected(b, e):
    with pytest.raises(BindError):
        b.bind(e)


def test_literals():
    assert lit(1).dtype == t.INT64 and lit(1.5).dtype == t.FLOAT64 and lit("a").dtype == t.UTF8 and lit(True).dtype == t.BOOL
    for bad in (None, object()):
        with pytest.raises(BindError):
            lit(bad)
    for d in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"):
        lo, hi = t.integer_range(t.parse(d))
        assert typed(lo, d).value == lo and typed(hi, d).value == hi
        for v in (lo - 1, hi + 1, 0.5):
            with pytest.raises(BindError):
                typed(v, d)


@pytest.mark.parametrize(
    ("a", "b_", "out"),
    [("int8", "int32", "int32"), ("int64", "float32", "float64"), ("float32", "float32", "float32"), ("float32", "float64", "float64"), ("uint8", "uint32", "uint32"), ("int8", "uint64", "int64")],
)
def test_promotion(a, b_, out):
    assert t.promote(t.parse(a), t.parse(b_)).tag == out == t.promote(t.parse(b_), t.parse(a)).tag


def test_decimals_have_the_type_that_spark_gives(spark, b):
    df = spark.createDataFrame([], TICKETS)
    wide = T.StructType([T.StructField("p", T.DecimalType(38, 10)), T.StructField("q", T.DecimalType(30, 12))])
    for schema, exprs in ((TICKETS, [col("deposit").add(col("tax")), col("deposit").sub(col("seats")), col("deposit").mul(col("tax")), col("deposit").mul(2)]), (wide, [col("p").add(col("q")), col("p").mul(col("q"))])):
        for e in exprs:
            c, d = Binder(schema).bind(e)
            assert spark.createDataFrame([], schema).select(c).schema[0].dataType == t.to_spark(d)
    plain = df.selectExpr("deposit + tax", "deposit * tax")
    assert [f.dataType for f in plain.schema] == [t.to_spark(b.dtype(e)) for e in (col("deposit").add(col("tax")), col("deposit").mul(col("tax")))]


def test_moments_compare_and_reach_the_scan(spark, tmp_path):
    rows = [(datetime.date(2024, 2, d), datetime.datetime(2024, 2, d, 12)) for d in (27, 28, 29)] + [(None, None)]
    path = f"{tmp_path}/days.parquet"
    spark.createDataFrame(rows, "day date, sold timestamp_ntz").write.parquet(path)
    f = Frame(spark.read.parquet(path))
    assert f.filter(col("day").gte(DAY)).height() == 1 and f.filter(col("sold").gt(DAY)).height() == 1
    assert f.filter(col("sold").lte(datetime.datetime(2024, 2, 28, 12))).height() == 2
    plan = f.filter(col("day").gte(DAY).and_(col("sold").lt(datetime.datetime(2024, 3, 1)))).spark._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and "LessThan(sold" in plan


def test_walk_and_rewrite():
    e = x.Alias(x.Binary("<", x.Binary("*", col("fare"), lit(3)), lit(50)), "cheap")
    seen = []
    x.walk(e, lambda n: seen.append(str(n)))
    assert seen == ["fare", "3", "(fare * 3)", "50", "((fare * 3) < 50)", "((fare * 3) < 50) as cheap"]
    new = x.rewrite(e, lambda n: col("toll") if isinstance(n, x.Column) else n)
    assert str(new) == "((toll * 3) < 50) as cheap" and x.rewrite(e, lambda n: n) is e
    deep = x.Alias(col("u").eq(1).not_().and_(col("v").cast("float64").sum()), "w")
    assert x.columns_of(x.rewrite(deep, lambda n: col("k") if n == col("v") else n)) == ["u", "k"]


@pytest.mark.parametrize(("kind", "value"), [("int", 2), ("smallint", 2), ("tinyint", 2), ("bigint", 2), ("float", 2.1), ("double", 2.1), ("string", "b"), ("boolean", True)])
def test_equality_by_type(spark, kind, value):
    text = f"'{value}'" if kind == "string" else str(value)
    df = spark.sql(f"select cast({text} as {kind}) x union all select cast(null as {kind})")
    c = Binder(df.schema).column(col("x").eq(value))
    assert sorted(str(r[0]) for r in df.select(c).collect()) == ["None", "True"]


def test_nan_modes(spark):
    df = spark.sql("select double('NaN') a, double(1) b")
    e = col("a").gt(col("b"))
    assert df.select(Binder(df.schema).column(e)).first()[0] is True
    assert df.select(Binder(df.schema, ieee_nan=True).column(e)).first()[0] is False
    assert df.select(Binder(df.schema, ieee_nan=True).column(col("a").neq(col("a")))).first()[0] is True


@settings(max_examples=9, deadline=None)
@given(st.sampled_from([True, False, None]), st.sampled_from([True, False, None]))
def test_kleene(spark, p, q):
    df = spark.createDataFrame([(p, q)], "p boolean, q boolean")
    b = Binder(df.schema)
    got = df.select(b.column(col("p").and_(col("q"))), b.column(col("p").or_(col("q")))).first()
    both = False if p is False or q is False else None if p is None or q is None else True
    either = True if p or q else None if p is None or q is None else False
    assert tuple(got) == (both, either)
