"""The query catalogue: each operator as a Frame query and as plain SQL."""

from __future__ import annotations

import datetime
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernis.functions.expr import col, lit
from quernis.operators import compute
from quernis.operators.frame import Frame
from quernis.session import shared_dir
from quernis.sources.files import CsvOptions, read_csv, read_parquet, write_csv, write_parquet


def table(spark: SparkSession, sf: str, name: str) -> Frame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    return os.path.join(shared_dir(spark), "catalog", f"{name}-{uuid.uuid4().hex}")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf: (r.spark if isinstance(r := fn(lambda n: table(spark, sf, n)), Frame) else r)
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def io_query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf: fn(spark, sf).spark
        ORACLES[fn.__name__] = sql
        return fn

    return add


@query("select n_name, n_nationkey from nation")
def scan_project(t):
    return t("nation").select("n_name", "n_nationkey")


@query("select n_regionkey, n_name from nation")
def project_by_index(t):
    return t("nation").pick(2, 1)


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def filter_gt_double(t):
    return t("lineitem").filter(col("l_quantity").gt(45)).select("l_orderkey", "l_quantity")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def filter_eq_string(t):
    return t("customer").filter(col("c_mktsegment").eq("BUILDING")).select("c_custkey", "c_name")


@query("select event_id, event_type from events where event_type != 'error'")
def filter_neq_string(t):
    return t("events").filter(col("event_type").neq("error")).select("event_id", "event_type")


@query("select c_custkey, c_name from customer where c_name > 'Customer#000001000'")
def filter_gt_string(t):
    return t("customer").filter(col("c_name").gt("Customer#000001000")).select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey from orders where o_custkey > o_orderkey")
def filter_columns(t):
    return t("orders").filter(col("o_custkey").gt(col("o_orderkey"))).select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_discount from lineitem where l_discount >= 0.03 and l_discount <= 0.07 and l_quantity < 24")
def filter_lt_lte_gte(t):
    p = col("l_discount").gte(0.03).and_(col("l_discount").lte(0.07)).and_(col("l_quantity").lt(24))
    return t("lineitem").filter(p).select("l_orderkey", "l_discount")


@query("select c_custkey from customer where c_nationkey > 12")
def filter_int_literal_promote(t):
    return t("customer").filter(col("c_nationkey").gt(12)).select("c_custkey")


@query("select o_orderkey from orders where (o_orderstatus = 'F' or o_orderpriority = '1-URGENT') and not (o_totalprice > 250000)")
def filter_and_or_not(t):
    p = col("o_orderstatus").eq("F").or_(col("o_orderpriority").eq("1-URGENT")).and_(col("o_totalprice").gt(250000).not_())
    return t("orders").filter(p).select("o_orderkey")


def _flag_or_null(f: Frame) -> Frame:
    return Frame(f.spark.withColumn("k", F.nullif(F.col("l_returnflag"), F.lit("N"))))


@query("select l_orderkey from lineitem where nullif(l_returnflag,'N') = 'R'")
def filter_null_dropped(t):
    return _flag_or_null(t("lineitem")).filter(col("k").eq("R")).select("l_orderkey")


@query("select l_orderkey, nullif(l_returnflag,'N') is null as is_n, nullif(l_returnflag,'N') is not null as not_n from lineitem")
def is_null_flags(t):
    return _flag_or_null(t("lineitem")).project(col("l_orderkey"), col("k").is_null().alias("is_n"), col("k").is_not_null().alias("not_n"))


@query("select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as net, l_linenumber+1 as nxt from lineitem")
def arith_add_sub_mul(t):
    net = col("l_extendedprice").mul(lit(1).sub(col("l_discount"))).alias("net")
    return compute.project(t("lineitem"), [col("l_orderkey"), col("l_linenumber"), net, col("l_linenumber").add(1).alias("nxt")])


@query("select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '1995-06-01' and l_shipdate < timestamp '1995-07-01 12:00:00'")
def filter_date_range(t):
    first, end = datetime.date(1995, 6, 1), datetime.datetime(1995, 7, 1, 12)
    p = col("l_shipdate").gte(first).and_(col("l_shipdate").lt(end))
    return t("lineitem").filter(p).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_totalprice/2 as half, o_custkey/4 as q from orders")
def arith_div(t):
    return t("orders").project(col("o_orderkey"), col("o_totalprice").div(2).alias("half"), col("o_custkey").div(4).alias("q"))


@query("select s_suppkey, -s_acctbal as neg_bal, cast(s_nationkey as double) as nk from supplier")
def arith_neg_cast(t):
    return t("supplier").project(col("s_suppkey"), col("s_acctbal").neg().alias("neg_bal"), col("s_nationkey").cast("float64").alias("nk"))


@query("select p_partkey, p_size * 2 as p_size, p_retailprice * 1.1 as taxed from part")
def with_column_replace_add(t):
    return t("part").with_column("p_size", col("p_size").mul(2)).with_column("taxed", col("p_retailprice").mul(1.1)).select("p_partkey", "p_size", "taxed")


@query("select o_orderkey from orders where o_totalprice > 400000 order by o_orderkey limit 10")
def filter_then_limit(t):
    return t("orders").filter(col("o_totalprice").gt(400000)).sort("o_orderkey").limit(10).select("o_orderkey")


@query("select o_orderkey from (select * from orders order by o_orderkey limit 100) where o_orderstatus = 'F'")
def limit_then_filter(t):
    return t("orders").sort("o_orderkey").limit(100).filter(col("o_orderstatus").eq("F")).select("o_orderkey")


@query("select n_name from nation limit 0")
def limit_zero(t):
    return t("nation").select("n_name").limit(0)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_desc_limit(t):
    return t("orders").sort("o_totalprice", "o_orderkey", descending=[True, False]).limit(25).select("o_orderkey", "o_totalprice")


@query("select l_returnflag, count(l_orderkey) as n, round(avg(l_quantity),6) as avg_q, min(l_shipdate) as min_d, max(l_extendedprice) as max_p, cast(sum(l_linenumber) as bigint) as sum_ln from lineitem group by l_returnflag")
def group_all_aggs(t):
    f = t("lineitem").group_by("l_returnflag").agg(col("l_orderkey").count().alias("n"), col("l_quantity").mean().alias("avg_q"), col("l_shipdate").min().alias("min_d"), col("l_extendedprice").max().alias("max_p"), col("l_linenumber").sum().alias("sum_ln"))
    return f.spark.withColumn("avg_q", F.round("avg_q", 6))


@query("select count(o_orderkey) as n, min(o_orderdate) as lo, max(o_orderdate) as hi from orders")
def agg_global(t):
    return t("orders").aggregate(col("o_orderkey").count().alias("n"), col("o_orderdate").min().alias("lo"), col("o_orderdate").max().alias("hi"))


@query("select nullif(l_returnflag,'N') as k, count(l_orderkey) as n from lineitem group by 1")
def group_null_key(t):
    return compute.group_by(_flag_or_null(t("lineitem")), [col("k")], [col("l_orderkey").count().alias("n")])


@query("select l_linenumber + 1 as k, round(sum(l_quantity), 4) as q from lineitem group by 1")
def group_expression_key(t):
    f = t("lineitem").group_by(col("l_linenumber").add(1).alias("k")).agg(col("l_quantity").sum().alias("q"))
    return f.spark.withColumn("q", F.round("q", 4))


@query("select l_linestatus, count(nullif(l_returnflag,'N')) as n from lineitem group by l_linestatus")
def count_skips_null(t):
    return _flag_or_null(t("lineitem")).group_by("l_linestatus").agg(col("k").count().alias("n"))


def _customers_as_orders_key(f: Frame) -> Frame:
    return f.project(col("c_custkey").alias("o_custkey"), col("c_name"), col("c_acctbal"), col("c_nationkey"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(t):
    return compute.join(t("orders"), _customers_as_orders_key(t("customer")), ["o_custkey"]).select("o_orderkey", "c_name")


@query("select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 450000) o on c_custkey = o_custkey")
def join_left(t):
    big = t("orders").filter(col("o_totalprice").gt(450000)).project(col("o_custkey").alias("c_custkey"), col("o_orderkey"))
    return t("customer").join(big, "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("select c_custkey, o_orderkey from (select * from orders where o_totalprice > 450000) o right join customer on o_custkey = c_custkey")
def join_right(t):
    big = t("orders").filter(col("o_totalprice").gt(450000)).project(col("o_custkey").alias("c_custkey"), col("o_orderkey"))
    return big.join(t("customer"), "c_custkey", "right").select("c_custkey", "o_orderkey")


@query("select coalesce(o_custkey, c_custkey) as custkey, o_orderkey, c_name from (select * from orders where o_totalprice > 450000) o full join (select * from customer where c_acctbal > 5000) c on o_custkey = c_custkey")
def join_outer(t):
    o = t("orders").filter(col("o_totalprice").gt(450000)).project(col("o_custkey").alias("custkey"), col("o_orderkey"))
    c = t("customer").filter(col("c_acctbal").gt(5000)).project(col("c_custkey").alias("custkey"), col("c_name"))
    return o.join(c, "custkey", "outer").select("custkey", "o_orderkey", "c_name")


@query("select n_name, count(o_orderkey) as orders, round(sum(o_totalprice),2) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate > timestamp '1998-01-01' group by n_name")
def flagship(t):
    recent = t("orders").filter(col("o_orderdate").gt(datetime.date(1998, 1, 1)))
    nation = t("nation").project(col("n_nationkey").alias("c_nationkey"), col("n_name"))
    f = recent.join(_customers_as_orders_key(t("customer")), "o_custkey").join(nation, "c_nationkey")
    f = f.group_by("n_name").agg(col("o_orderkey").count().alias("orders"), col("o_totalprice").sum().alias("revenue"))
    return f.spark.withColumn("revenue", F.round("revenue", 2))


@query("select l_orderkey, l_linenumber, l_quantity * 2 as l_quantity from lineitem")
def map_batches(t):
    import pyarrow as pa
    import pyarrow.compute as pc

    def double(b):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.multiply(b.column(2), 2.0)], schema=b.schema)

    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").map_batches(double)


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def filter_mask_batches(t):
    import pyarrow.compute as pc

    return t("lineitem").select("l_orderkey", "l_quantity").filter_batches(lambda b: pc.greater(b.column(1), 45.0))


@io_query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(spark, sf):
    path = shared_folder(spark, "csv")
    write_csv(table(spark, sf, "customer"), path)
    return read_csv(spark, path)


@io_query("select doc_id, replace(replace(coalesce(text, '-'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents")
def csv_line_breaks(spark, sf):
    """Texts with line breaks, quotes and commas; a reader of quoted cells takes each line break as one sign."""
    path = shared_folder(spark, "csv")
    docs = table(spark, sf, "documents").spark
    text = F.regexp_replace(F.coalesce("text", F.lit("-")), "\r\n?", "\n")
    write_csv(Frame(docs.select("doc_id", text.alias("text"))), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    # No text is null, nor is any text now a carriage return.
    return read_csv(spark, path, CsvOptions(schema=schema, null_values=["\r"]))


@io_query("select c_name, c_custkey from customer where c_custkey > 700")
def csv_scan_options(spark, sf):
    path = shared_folder(spark, "csv")
    write_csv(table(spark, sf, "customer"), path, CsvOptions(comma="|", use_crlf=True))
    f = read_csv(spark, path, CsvOptions(comma="|", column_types={"c_custkey": "int64", "c_name": "utf8"}, include_columns=["c_name", "c_custkey"]))
    return f.filter(col("c_custkey").gt(700))


@io_query("select * from orders")
def parquet_roundtrip(spark, sf):
    path = shared_folder(spark, "parquet")
    write_parquet(table(spark, sf, "orders"), path)
    return read_parquet(spark, path)


@io_query("select n_nationkey, n_name, n_regionkey from nation")
def arrow_roundtrip(spark, sf):
    f = table(spark, sf, "nation")
    return Frame.from_arrow(spark, list(f.iter_batches(10)))


@io_query("select event_type, cast(count(*) as bigint) as n from events where value > 10 group by event_type")
def stream_filter_group(spark, sf):
    from pyspark.sql import SparkSession as S  # noqa: F401

    from quernis.streaming.stream import stream_parquet, write_stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A file source watches folders or globs; the pattern names the one table.
    f = stream_parquet(spark, f"{sf}/events.parque[t]", schema).filter(col("value").gt(10)).select("event_id", "event_type")
    out = shared_folder(spark, "stream")
    write_stream(f, "parquet", f"{out}/state", path=f"{out}/rows").awaitTermination()
    done = Frame(spark.read.schema("event_id bigint, event_type string").parquet(f"{out}/rows"))
    return done.group_by("event_type").agg(col("event_id").count().alias("n"))


def flagship_query(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf)
