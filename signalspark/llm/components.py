"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalspark.llm.tables import remove, store
from signalspark.operators.frames import attach


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the component's smallest node) of every node with an edge (src, dst).

    Each round takes the smallest label among neighbours, then that label's own
    label, so chains halve.  Minima combine before the shuffle and joins to
    labels are salted: a node that links a third of all is no bottleneck.
    Rounds are cut by tables in the shared folder, of which the last two stay.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both, kept = store(both, "edges")
    labels, path = store(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            attach(both, labels.select(F.col("node").alias("dst"), "label"), ["dst"], "src")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        nxt, new = store(
            attach(low, jump, ["low"], "node").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), F.col("label").alias("old")),
            "labels",
        )
        changed = not nxt.filter("label <> old").isEmpty()
        remove(spark, path)
        labels, path = nxt.select("node", "label"), new
        if not changed:
            remove(spark, kept)
            return labels
    raise RuntimeError(f"components still changing after {max_rounds} rounds")
