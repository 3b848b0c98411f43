import pytest
from pyspark.sql import types as T

from quernis import BindError, QuernisError, col, concat_columns
from quernis.operators import compute
from quernis.sources.database import read_database, write_database
from quernis.sources.files import CsvOptions, read_csv, read_parquet, write_csv, write_parquet
from quernis.sources.memory import Values


@pytest.fixture
def frame(spark):
    return concat_columns(spark, [Values("ids", [1, 2, 3]), Values("names", ["alpha", None, "g,\"x\""]), Values("ok", [True, False, None])])


def rows(f):
    return sorted(map(tuple, f.collect()), key=str)


def test_csv_round_trip(spark, frame, tmp_path):
    for single in (False, True):
        path = str(tmp_path / f"c{single}.csv")
        write_csv(frame, path, single_file=single)
        back = read_csv(spark, path)
        assert [d.tag for d in back.dtypes.values()] == ["int64", "utf8", "bool"]
        assert rows(back) == rows(frame)
    write_csv(frame, str(tmp_path / "b"), CsvOptions(bool_texts=("Y", "N"), use_crlf=True, comma=";", replace=[("alpha", "beta")]))
    back = read_csv(spark, str(tmp_path / "b"), CsvOptions(comma=";"))
    assert {r[2] for r in back.collect()} == {"Y", "N", None} and "beta" in {r[1] for r in back.collect()}


def test_csv_options(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('ids,vals,w\n# note\n1,a,NA\n2,,1.5\n3,"c,d",2\n')
    o = CsvOptions(comment="#", null_values=["NA", ""], column_types={"ids": "int32"}, include_columns=["vals", "ids", "w"])
    f = read_csv(spark, str(p), o)
    assert f.columns == ["vals", "ids", "w"] and [d.tag for d in f.dtypes.values()] == ["utf8", "int32", "float64"]
    assert rows(f) == rows_of([("a", 1, None), (None, 2, 1.5), ("c,d", 3, 2.0)])
    assert rows(f.filter(col("ids").gt(2)).select("vals").limit(1)) == [("c,d",)]
    p.write_text("1,a\n2,b\n")
    assert read_csv(spark, str(p), CsvOptions(header=False)).height() == 2
    with pytest.raises(Exception, match="null in column"):
        q = tmp_path / "n.csv"
        q.write_text("a,b\n1,\n2,x\n")
        read_csv(spark, str(q), CsvOptions(allow_nullable=False)).collect()
    for bad in (lambda: read_csv(spark, ""), lambda: write_csv(None, "x")):
        with pytest.raises(QuernisError):
            bad()
    with pytest.raises(BindError):
        read_csv(spark, str(p), CsvOptions(header=False, column_types={"zz": "int64"}))


def rows_of(r):
    return sorted(r, key=str)


def test_parquet(spark, frame, tmp_path):
    for single in (False, True):
        path = str(tmp_path / f"p{single}")
        write_parquet(frame, path, single_file=single)
        assert rows(read_parquet(spark, path)) == rows(frame)
    assert read_parquet(spark, path, columns=["names"]).columns == ["names"]
    assert not read_parquet(spark, path, columns=["ids"], allow_nullable=False).schema["ids"].nullable
    with pytest.raises(BindError):
        read_parquet(spark, path, columns=["zz"])


def test_line_breaks_in_cells(spark, tmp_path):
    """Quoted cells with line breaks come back; without them files may split."""
    f = concat_columns(spark, [Values("id", [1, 2, 3]), Values("cell", ["one\ntwo", 'a "b",\n\nc', "plain"])])
    write_csv(f, str(tmp_path / "m"))
    assert rows(read_csv(spark, str(tmp_path / "m"))) == rows(f)
    with pytest.raises(Exception, match="MALFORMED|CAST|malformed"):
        read_csv(spark, str(tmp_path / "m"), CsvOptions(multi_line=False)).collect()
    p = tmp_path / "x.csv"
    p.write_text('id,cell\n1,"x\ny"\n')
    assert rows(read_csv(spark, str(p))) == [(1, "x\ny")]


#: White space and control characters at the ends of a cell, NUL beside quotes and breaks, quotes of all kinds.
ODD_CELLS = ["", " ", " a ", "\ta\t", "\n", "\na\n\n", " \n ", "\x00", "\x00\x00", "\x00a\x00", '\x00"', '"\x00', 'a\x00"b', "\x00\nb", "a\n\x00", "\x01a\x1f", '"', '""', '" a "', ' "a" ', '\\"', '"\\', ",", " , ", "\ufeffa", "\U0001f600 \n"]


def test_odd_cells_come_back_whole(spark, tmp_path):
    f = concat_columns(spark, [Values("id", list(range(len(ODD_CELLS)))), Values("cell", ODD_CELLS)])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cell", T.StringType())])
    for single in (False, True):
        write_csv(f, str(tmp_path / f"o{single}"), single_file=single)
        back = read_csv(spark, str(tmp_path / f"o{single}"), CsvOptions(schema=schema, null_values=["none"]))
        assert rows(back) == rows(f)


def test_line_breaks_query_on_odd_texts(spark, tmp_path):
    from quernis.plans.catalog import QUERIES

    texts = [*ODD_CELLS, None, "\r", "\r\n", " \r\r\na\r", '\r"\x00\r\n']
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # As its SQL says.
    told = {i: ("-" if x is None else x).replace("\r\n", "\n").replace("\r", "\n") for i, x in enumerate(texts)}
    assert {r.doc_id: r.text for r in QUERIES["csv_line_breaks"](spark, str(tmp_path)).collect()} == told


def test_typed_read_pushes_filters(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,w,name\n1,0.5,a\n2,-,b\n3,2.5,-\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("w", T.DoubleType()), T.StructField("name", T.StringType())])
    f = read_csv(spark, str(p), CsvOptions(schema=schema, null_values=["-"], chunk_size=2, include_columns=["name", "id", "w"]))
    assert f.columns == ["name", "id", "w"] and rows(f) == rows_of([("a", 1, 0.5), ("b", 2, None), (None, 3, 2.5)])
    assert [b.num_rows for b in f.iter_batches()] == [2, 1] and [b.num_rows for b in f.iter_batches(1)] == [1, 1, 1]
    plan = f.filter(col("id").gt(1)).spark._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id" in plan
    # Several tokens: the values are read as text and cast.
    g = read_csv(spark, str(p), CsvOptions(schema=schema, null_values=["-", "?"]))
    assert rows(g) == rows_of([(1, 0.5, "a"), (2, None, "b"), (3, 2.5, None)])


def test_more_csv_and_parquet_options(spark, frame, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b\n1,x "y" z\n2,"w"\n')
    assert rows(read_csv(spark, str(p), CsvOptions(lazy_quotes=True))) == rows_of([(1, 'x "y" z'), (2, "w")])
    write_csv(frame, str(tmp_path / "n"), CsvOptions(null_value="NIL"))
    assert rows(read_csv(spark, str(tmp_path / "n"), CsvOptions(null_values=["NIL"], column_types={"ids": "int64", "ok": "bool"}))) == rows(frame)
    write_parquet(frame, str(tmp_path / "z"), compression="zstd", block_size=1 << 20, partition_by=["ids"])
    assert sorted(d.name for d in (tmp_path / "z").iterdir() if d.is_dir()) == ["ids=1", "ids=2", "ids=3"]
    write_parquet(frame.select("ids"), str(tmp_path / "s/a"))
    write_parquet(frame.select("names"), str(tmp_path / "s/b"))
    both = read_parquet(spark, str(tmp_path / "s/*"), merge_schema=True)
    assert sorted(both.columns) == ["ids", "names"] and both.height() == 6


def test_database_round_trip(spark, frame):
    url, driver = "jdbc:derby:memory:quernis;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    write_database(frame, url, "things", mode="overwrite", driver=driver)
    f = read_database(spark, url, "things", split_by="ids", bounds=(1, 3), parts=2, driver=driver)
    assert rows(f) == rows(frame) and rows(f.filter(col("ids").gt(2)).select("ids")) == [(3,)]
    for bad in (lambda: read_database(spark, "", "x"), lambda: read_database(spark, url, "x", split_by="ids"), lambda: write_database(None, url, "x")):
        with pytest.raises(QuernisError):
            bad()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from quernis import __main__ as cli

    p = tmp_path / "c.csv"
    p.write_text("boat,seats\nheron,12\ntern,\n")
    monkeypatch.setattr(cli, "local_session", lambda n: spark)
    assert cli.main([str(p)]) == 0
    out = capsys.readouterr().out
    assert "boat" in out and "heron" in out and "12" in out
    assert cli.main([]) == 2 and "usage" in capsys.readouterr().err


def test_eager_functions(spark, frame):
    assert rows(compute.filter(frame, col("ids").gt(1))) == rows(frame.filter(col("ids").gt(1)))
    assert compute.group_by(frame, [], [col("ids").sum().alias("s")]).collect()[0][0] == 6
    assert compute.join(frame, frame.select("ids"), ["ids"]).height() == 3


def test_shared_folder_of_a_cluster(spark):
    from quernis.session import shared_dir

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {"spark.checkpoint.dir": ""}

        conf = {}

    with pytest.raises(ValueError, match="share"):
        shared_dir(Cluster)
    assert shared_dir(spark)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["n_name", "orders", "revenue"]
    assert not set(e.oracle_sql()) - set(e.queries())
