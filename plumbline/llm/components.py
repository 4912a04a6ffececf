"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import landed


def connected_components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) for every node of ``edges`` (columns a, b).

    Each round gives a node the least label around it and then the label of that label, so long
    chains halve; labels are written to the shared folder between rounds. Sums over neighbours are
    combined before the shuffle, so a node with many edges is no hot spot. Stops when nothing
    changes. An empty table of edges gives none.
    """
    both = landed(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = landed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("comp").alias("around"))
            .withColumnRenamed("a", "node")
        )
        nearer = labels.join(around, "node").select("node", "comp", F.least("comp", "around").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("comp").alias("beyond"))
        # A label that is a node of its own has itself a label, which is at most as large.
        moved = landed(nearer.join(target, "new").select("node", "comp", F.least("new", "beyond").alias("new")), "labels")
        labels = moved.select("node", F.col("new").alias("comp"))
        if moved.where("new <> comp").limit(1).count() == 0:
            return labels
