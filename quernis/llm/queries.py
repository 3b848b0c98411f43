"""The operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernis.llm import chroma, itq, langid, lines, lm, minhash, mixing, order, packing, warc
from quernis.llm.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Fixed value: what a word is, in RE2 and in Java.
WORD = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def components_sql(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``comp(node, label)`` over ``links(a, b)`` in both directions."""
    return f"""reach(node, label) as (select node, node from {nodes} union select l.b, r.label from reach r join {links} l on l.a = r.node),
comp as (select node, min(label) as label from reach group by node)"""


@query(
    rf"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select x.doc_id as a, y.doc_id as b from items x join items y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
nodes as (select doc_id as node from documents),
{components_sql("nodes", "links")}
select s.doc_id, len(s.s)::bigint as n_shingles, c.label as component_id, s.doc_id = c.label as kept from sets s join comp c on c.node = s.doc_id"""
)
def op3_minhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), how=minhash.Shingling(words=2, percent=80)).drop("of")


@query(
    rf"""with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
turned as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, source_size * 3 as most from per),
levels as (select *, (sum(source_size) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::double as level
  from turned window o as (order by most::double / w, source asc nulls last)),
goal as (select source, source_size, least(coalesce(max(case when level * w <= most then level end) over () * w, 0), most::double) as target from levels),
rated as (select d.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate, ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496 as drawn
  from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when drawn < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated"""
)
def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.copies(table(spark, sf, "documents"), weights=(5, 2, 1), cap=3)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


@query()
def op2_language_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op9_pack_along_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.pack(table(spark, sf, "documents"), tokenizer_path(), length=1024, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    """with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as x from p),
b as (select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest from d),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from b)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"""
)
def op6_warc_chains(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archives")
    warc.write_archives(warc.records(table(spark, sf, "pages"), min_bytes=0), folder)
    return warc.resolved(warc.whole(spark, folder, scratch.put("records", warc.read_archives(spark, folder, scratch=scratch))))


@query(
    f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda c: c::double) as e from embeddings where label is not null and embedding is not null),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.98),
nodes as (select vec_id as node from embeddings),
{components_sql("nodes", "links")}
select c.node as vec_id, (select count(*) from links l where l.a = c.node)::bigint as n_links, c.label as component_id, c.label = c.node as kept from comp c"""
)
def op7_itq_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf, "embeddings"), threshold=0.98)


@query()
def op1_chroma_alignments(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "recordings")
    prints = scratch.put("prints", chroma.fingerprints(chroma.recordings(table(spark, sf, "embeddings"))))
    return chroma.search(prints, F.col("rec_id") % 50 == 0)


@query()
def op5_cross_entropy_difference(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf, "documents"), good)


@query()
def op8_training_order(spark: SparkSession, sf: str) -> DataFrame:
    folder = Scratch(spark, "shards").folder("shards")
    return order.materialise(table(spark, sf, "documents"), folder, tokenizer_path())


@query()
def op10_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return lines.summary(docs, lines.repeated_lines(docs))
