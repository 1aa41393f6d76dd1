"""Connected components of a table of links, by label exchange and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v); label is the smallest node that it reaches.

    Each round takes the least label among a node and its neighbours and then
    the label of that label; rounds end when nothing changes. Joins and partial
    sums only, so a node with very many links is no group in one task. Lineage
    is cut through the shared folder each round. No links give no rows.
    """
    both = checkpoint(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).where("u <> v").distinct())
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = checkpoint(hooked.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        changed = nxt.where("was <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
