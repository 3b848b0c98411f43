"""Connected components of a link table, wholly distributed.

Labels spread to neighbours and through label trees, so the rounds grow with
the logarithm of a component's width. Every round is written to the shared
folder. Nothing but one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``links(a, b)``: the label is the component's smallest node.

    Loops, repeated links and an empty table are fine; a node without a link has no row.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.put("links", both)
    lab = scratch.put("labels", both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = scratch.put("seen", lab.join(near, "node").select("node", "label", F.least("label", "near").alias("near")))
        # The whole tree under a root follows the least label that one of its nodes has seen.
        root = seen.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("to"))
        step = seen.join(root, seen.label == root.root).select("node", "label", F.least("near", "to").alias("next"))
        jump = root.select(F.col("root").alias("next"), F.col("to").alias("then"))
        then = F.coalesce(F.least("next", "then"), "next")
        new = scratch.put("labels", step.join(jump, "next", "left").select("node", then.alias("label"), (F.col("label") != then).alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(seen, lab)
        lab = new.select("node", "label")
        lab._scratch_path = new._scratch_path
        if not moved:
            scratch.drop(both)
            return lab
