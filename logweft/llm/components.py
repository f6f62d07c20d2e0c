"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.common import cut


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the ends of links (a, b), a < b, as those do, about one for each end.

    Every node's lesser neighbours are linked to the least of them instead of to the node, and the node to that one, so
    nodes that many stars share leave only the links between the stars' middles.
    """
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    ends = links.join(least, "b").select("least", F.col("a").alias("b")).unionByName(least.select("least", "b"))
    return cut(ends.where("least <> b").select(F.col("least").alias("a"), "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (a, b): label is the least node of its component.

    Each round takes the least label among neighbours, then twice the label's own label, so a chain of n links needs
    about log n rounds. Every round is written to the checkpoint folder; only a count of changes reaches the driver.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("seen"))
        offered = both.join(of, "a").groupBy(F.col("b").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label"))
        lower = cut(lower)
        settled = lower.where("old <> label").isEmpty()
        labels = lower.select("node", "label")
        if settled:
            return labels
