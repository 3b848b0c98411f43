"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written
as Parquet and read again as the next stage's ``docs``. All but the last keep
the columns of ``documents``; extra columns, whatever their names, come through
as they are. Every stage takes an empty table and texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernis.llm import langid, lines, minhash, mixing, packing
from quernis.llm.queries import tokenizer_path
from quernis.llm.scratch import Scratch, quoted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: no letterless texts, none between two languages.

    Null and empty texts go with the letterless ones. Without any labelled row
    no language can be told and nothing stays.
    """
    told = langid.predict(docs, langid.fit(docs), keep=tuple(docs.columns))
    return told.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*map(quoted, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines the first occurrence in the corpus stays; documents that lose all their text go.

    Ties go to the least document id, then line number. Documents with a null id
    or text stay as they are. ``n_chars`` is counted anew.
    """
    left = lines.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that of the least id.

    Rows are judged each by its text, also where they share an id; documents
    with a null id or without words stay.
    """
    return minhash.without_copies(docs, how=minhash.Shingling(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out. A null source is one of its own; rows of one id are drawn alike."""
    return mixing.mixed(docs, weights=(5, 2, 1), cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences along the curve, with their ids and a checksum; a repeated document is packed as often."""
    return packing.pack(docs, tokenizer_path(), length=1024, end_id=0).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL has no trained language codes and no SimHash; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
