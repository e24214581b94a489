"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def component_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, label)`` for every node of the edges ``(a, b)``, both bigint.

    ``label`` is the smallest node of the component. Each round lowers the label
    of a node, and of the node it points to, to the smallest label next to it,
    and then replaces each label by that label's own label, so the number of
    rounds grows with the logarithm of the longest path. Rounds are written to
    the shared folder. Minima are pre-aggregated in each task; the only join on
    labels, of which one may be everywhere, has unique rows on its other side,
    so adaptive execution can split it.

    Self loops and repeated edges change nothing, rows with a null end are
    ignored, no edges give no rows. More rounds than ``max_rounds`` raise: labels
    are never returned unfinished.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(
        links.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("node")).alias("label")
        ),
        "labels",
    )
    if labels.isEmpty():
        return labels
    for _ in range(max_rounds):
        seen = links.join(labels.select(F.col("node").alias("b"), "label"), "b").select(
            F.col("a").alias("node"), "label"
        )
        beside = seen.groupBy("node").agg(F.min("label").alias("low"))
        hooked = labels.join(beside, "node").select(
            "node", "label", F.least("label", "low").alias("low")
        )
        offers = hooked.select("node", "low").union(
            hooked.select(F.col("label").alias("node"), "low")
        )
        lowered = stored(offers.groupBy("node").agg(F.min("low").alias("label")), "lowered")
        jumped = lowered.join(
            lowered.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"
        ).select("node", F.col("next").alias("label"))
        before = labels
        labels = stored(jumped, "labels")
        changed = labels.join(before.withColumnRenamed("label", "was"), "node").where(
            "label <> was"
        )
        if changed.isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
