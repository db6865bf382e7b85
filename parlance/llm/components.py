"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): its smallest reachable node.

    Each round gives a node the least label among itself and its neighbours and
    then its label's own label, so distances about halve.  Neighbours are only
    ever aggregated by minimum, before the shuffle too, so a node with very many
    neighbours costs no more memory.  Every round is written to the shared folder.
    """
    pairs = edges.where("src <> dst").select("src", "dst")
    pairs = cut(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(pairs.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        heard = pairs.join(labels, pairs["src"] == labels["node"]).groupBy(F.col("dst").alias("n")).agg(F.min("label").alias("m"))
        lower = labels.join(heard, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        parent = labels.select(F.col("node").alias("p"), F.col("label").alias("up"))
        stepped = cut(lower.join(parent, F.col("label") == F.col("p"), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        done = stepped.where("label <> old").isEmpty()
        labels = stepped.select("node", "label")
        if done:
            return labels.select("node", F.col("label").alias("component"))
