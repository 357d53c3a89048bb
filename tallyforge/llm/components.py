"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of links; comp is the smallest node that links reach.

    Each round takes the smallest label among neighbours, then follows labels once; labels travel about
    twice as far in each round. Both steps are aggregations and joins on one row for each node, so no
    node's links are gathered in one place. Null ends are left out; self links keep their node.
    """
    edges = links.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = save(edges.union(edges.select("v", "u")).distinct(), "links")
    labels = save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("near")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        ahead = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = save(stepped.join(ahead, "comp").select("node", F.least("comp", "next").alias("comp"), (F.least("comp", "next") != F.col("was")).alias("moved")), "labels")
        labels = moved.select("node", "comp")
        if not moved.where("moved").take(1):
            return labels
