import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernis import BindError, Frame, QuernisError, col, concat_columns, lit
from quernis.operators import compute
from quernis.sources import memory
from quernis.sources.memory import Values


@pytest.fixture
def small(spark):
    return concat_columns(spark, [Values("ids", [1, 2, 3, 4], "int32"), Values("vals", ["a", "b", "c", "d"])])


def test_build(small, spark):
    assert small.columns == ["ids", "vals"] and small.width == 2 and small.height() == 4
    assert [d.tag for d in small.dtypes.values()] == ["int32", "utf8"]
    assert small.describe_schema() == "Schema(fields=2)" and small.field_index("vals") == 1
    s = small.column("vals")
    assert (s.name, s.dtype.tag, len(s), s.values()) == ("vals", "utf8", 4, ["a", "b", "c", "d"])
    for bad in (lambda: Values("", [1]), lambda: Values("x", None), lambda: Values("x", 5), lambda: Values("x", [object()]), lambda: memory.nulls("x", -1), lambda: memory.fixed_binary("x", [], 0)):
        with pytest.raises(QuernisError):
            bad()
    with pytest.raises(BindError, match="duplicate series name"):
        concat_columns(spark, [Values("a", [1]), Values("a", [2])])
    with pytest.raises(QuernisError, match="len="):
        concat_columns(spark, [Values("a", [1]), Values("b", [1, 2])])
    with pytest.raises(QuernisError):
        concat_columns(spark, [None])
    assert memory.frame_of(spark, [memory.nulls("n", 3)]).count() == 3
    with pytest.raises(QuernisError):
        Frame(None)


def test_filter_select_limit(small):
    f = small.filter(col("ids").gt(2)).select("ids").limit(1)
    assert [tuple(r) for r in f.collect()] == [(3,)]
    assert f.explain() == "Limit(n=1)\n  Project(columns=[ids])\n    Filter(predicate=(ids > 2))\n      Scan(source=dataframe)\n"
    assert small.pick(1).columns == ["vals"] and small.select("vals", "ids").columns == ["vals", "ids"]
    for bad in (lambda: small.select(), lambda: small.select("ids", "ids"), lambda: small.select("IDS"), lambda: small.select(""), lambda: small.pick(2), lambda: small.limit(-1), lambda: small.limit(1.5), lambda: small.filter(None), lambda: small.filter(col("ids")), lambda: small.filter(col("ids").sum().gt(1)), lambda: small.project(col("ids").sum()), lambda: small.project(), lambda: small.sort()):
        with pytest.raises(BindError):
            bad()
    assert small.limit(0).height() == 0 and small.limit(2**40).height() == 4
    assert small.filter(col("ids").gt(9)).columns == ["ids", "vals"]
    assert [r[0] for r in small.sort("ids", descending=True).collect()] == [4, 3, 2, 1]
    assert small.with_column("ids", col("ids").mul(2)).columns == ["ids", "vals"]


def test_awkward_names(spark):
    f = Frame(spark.sql("select 1 as `a.b`, 2 as `A.B`, 3 as `c``d`"))
    assert tuple(f.select("A.B", "c`d", "a.b").collect()[0]) == (2, 3, 1)
    assert tuple(f.filter(col("a.b").eq(1)).project(col("c`d").add(col("A.B")).alias("x")).collect()[0]) == (5,)


def test_group_and_join(spark):
    f = Frame(spark.sql("select * from values ('a', 1, 1.5D), ('a', null, 2.5D), (null, 3, null) t(k, n, v)"))
    g = f.group_by("k").agg(col("n").count(), col("n").sum(), col("v").mean().alias("m"), col("v").min(), col("v").max())
    assert g.columns == ["k", "count(n)", "sum(n)", "m", "min(v)", "max(v)"]
    assert {tuple(r) for r in g.collect()} == {("a", 1, 1, 2.0, 1.5, 2.5), (None, 1, 3, None, None, None)}
    assert [tuple(r) for r in f.limit(0).aggregate(col("n").count(), col("n").sum()).collect()] == [(0, None)]
    for bad in (lambda: f.group_by(), lambda: f.group_by("k").agg(), lambda: f.group_by("k").agg(col("n")), lambda: f.group_by("zz").agg(col("n").sum()), lambda: f.aggregate(col("k").sum())):
        with pytest.raises(BindError):
            bad()
    left = Frame(spark.sql("select * from values (1, 'x'), (2, 'y'), (null, 'z') t(id, v)"))
    right = Frame(spark.sql("select * from values (2L, 'Y'), (3L, 'W'), (null, 'Z') t(id, v)"))
    want = {"inner": 1, "left": 3, "right": 3, "outer": 5}
    for how, n in want.items():
        j = compute.join(left, right, ["id"], how, suffix="_r")
        assert j.columns == ["id", "v", "v_r"] and j.height() == n
    for bad in (lambda: left.join(right, "id"), lambda: left.join(right, []), lambda: left.join(right, "v2"), lambda: left.join(right, "id", "cross"), lambda: left.join(Frame(spark.sql("select 'a' id")), "id")):
        with pytest.raises(BindError):
            bad()


def test_batches(small, spark):
    f = small.map_batches(lambda b: pa.RecordBatch.from_arrays([pc.add(b.column(0), pa.scalar(1, pa.int32()))], ["n"]), "n int")
    assert sorted(r[0] for r in f.collect()) == [2, 3, 4, 5]
    assert small.filter_batches(lambda b: pc.greater(b.column(0), 2)).height() == 2
    with pytest.raises(Exception, match="the mask"):
        small.filter_batches(lambda b: None).collect()
    with pytest.raises(Exception, match="the mask has"):
        small.filter_batches(lambda b: pa.array([True] * (b.num_rows + 1))).collect()
    got = list(Frame(small.spark.coalesce(1)).iter_batches(3))
    assert [b.num_rows for b in got] == [3, 1]
    assert Frame.from_arrow(spark, got).height() == 4
    assert Frame.from_arrow(spark, [], pa.schema([("a", pa.int64())])).columns == ["a"]
    assert small.rechunk() is small and not small.should_rechunk()
    assert small.transform(lambda f: f.limit(1)).height() == 1
    assert small.to_arrow().num_rows == 4 and small.to_numpy("ids").shape == (4, 1)


def test_arrow_types(spark):
    import datetime as dt

    ts = dt.datetime(2026, 3, 4, 12, 0, tzinfo=dt.timezone.utc)
    table = pa.table({
        "u8": pa.array([255], pa.uint8()), "u16": pa.array([65535], pa.uint16()), "u32": pa.array([2**32 - 1], pa.uint32()), "u64": pa.array([2**64 - 1], pa.uint64()),
        "f16": pa.array([1.5], pa.float16()), "lu": pa.array(["x"], pa.large_string()), "sv": pa.array(["x"], pa.string_view()), "d64": pa.array([dt.date(2026, 3, 4)], pa.date64()),
        "dict": pa.array(["x"]).dictionary_encode(), "ts": pa.array([ts], pa.timestamp("ns", "UTC")), "fsb": pa.array([b"ab"], pa.binary(2)), "ll": pa.array([[1]], pa.large_list(pa.int64())),
    })
    f = Frame.from_arrow(spark, table)
    tags = {n: d.tag for n, d in f.dtypes.items()}
    assert tags["u8"] == "uint8" and tags["u64"] == "uint64" and tags["f16"] == "float16" and tags["dict"] == "utf8" and tags["ts"] == "timestamp"
    row = f.spark.first()
    assert (row.u8, row.u16, row.u32, int(row.u64)) == (255, 65535, 2**32 - 1, 2**64 - 1)
    assert f.filter(col("u8").eq(255)).height() == 1
    with pytest.raises(BindError):
        f.filter(col("u8").eq(-1))
    with pytest.raises(BindError):
        f.filter(col("u8").gt(1.5))


def test_display(spark):
    f = concat_columns(spark, [Values("ids", [1, 2, 3], "int32"), Values("names", ["a", "b", None])])
    assert str(f) == "\n".join(["shape: (3, 2)", "┌─────┬───────┐", "│ ids │ names │", "│ --- │ ---   │", "│ i32 │ str   │", "╞═════╪═══════╡", "│ 1   │ a     │", "│ 2   │ b     │", "│ 3   │ null  │", "└─────┴───────┘"])
    assert str(f.column("ids")).startswith("shape: (3,)\n")
    many = str(Frame(spark.range(0, 25, 1, 1)))
    assert "…" in many and many.count("\n") == 27
    g = str(Frame(spark.sql("select 1.0D a, true b, date'2026-03-04' c, float(0.1) d, timestamp_ntz'2026-03-04 12:00:00.5' e, array(1) f")))
    assert all(s in g for s in (" 1 ", " true ", "2026-03-04", " 0.1 ", "2026-03-04T12:00:00Z", "<unsupported>", "f64", "f32", "bool"))
    from quernis.operators.display import render

    assert render(None) == "<nil>"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=8), st.integers(-5, 5), st.integers(0, 9))
def test_filter_and_limit_laws(spark, values, cut, n):
    f = Frame(spark.createDataFrame([(v,) for v in values], "x bigint"))
    p, q = col("x").gt(cut), col("x").lt(cut + 3)
    key = lambda fr: sorted(r[0] for r in fr.collect())
    assert key(f.filter(p).filter(q)) == key(f.filter(p.and_(q))) == sorted(v for v in values if v is not None and cut < v < cut + 3)
    assert f.limit(n).height() == min(n, len(values))


def test_pushdown(spark, capsys):
    f = Frame(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).filter(col("l_linenumber").gt(3)).select("l_orderkey")
    f.explain_spark()
    text = capsys.readouterr().out
    assert "GreaterThan(l_linenumber,3)" in text and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
    assert lit(3).dtype.tag == "int64"
