"""Mixing sources to target weights by repeating and thinning documents.

Sources in code-point order, null last, get the weights in turn and share the
corpus size in proportion. No source may be repeated more than ``cap`` times;
what it cannot take is shared among the others by weight until none is above
its cap. A document is then taken ``floor(rate)`` times, and once more if a
number drawn from a hash of its id is below the fraction, so reruns agree.

Sizes are words (null text: 0). A source without words has the target 0.
Rows with equal ids draw alike, null ids too. Only one row for each source,
never the documents, meets in one task: some 50 bytes a source, so a million
sources fit and hosts of a whole web crawl should be grouped before. Texts may
have any length; extra columns come through ``mixed`` and are passed by in
``copies``; an empty table gives an empty one. Equal ratios of cap and weight go
by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernis.llm.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``; the excess over caps is reshared exactly.

    In the order of cap over weight the capped sources come first, so one pass
    of running sums finds the level at which the rest share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.cast("bigint").alias("w"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    zero = F.lit(0).cast("bigint")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), zero)) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
    per = per.withColumn("level", level)
    shared = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(every)
    target = F.least(F.coalesce(shared * F.col("w"), F.lit(0.0)), F.col("most").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``: how often the mix takes each document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.put("sized", docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")))
    goal = scratch.put("targets", targets(sized, weights, cap))
    return _with_copies(sized, goal, F.col("doc_id"))


def _with_copies(rows: DataFrame, goal: DataFrame, doc_id: Column) -> DataFrame:
    goal = goal.withColumnRenamed("source", "goal_source")
    out = rows.join(goal, rows.source.eqNullSafe(goal.goal_source)).drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(2**52)
    return out.withColumn("copies", (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with its own columns only."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"))
    goal = scratch.put("targets", targets(sized, weights, cap))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.col(f"c{docs.columns.index(source)}").alias("source"))
    out = _with_copies(rows, goal, F.col(f"row.c{docs.columns.index(doc_id)}"))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*").toDF(*docs.columns)
