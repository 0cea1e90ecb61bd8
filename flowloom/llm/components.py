"""Connected components of a link table, found with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.storage import Workspace


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the least node it is connected with.

    Each step maps a node to the least of its neighbours, follows that once more (pointer jumping), and puts
    the images in place of both ends of every edge. Edges inside one image go, so only what is still to be
    joined is read again, and a star or a path is soon used up. Every step is written, which cuts the lineage.
    """
    edges = work.save(f"{name}-edges0", links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        both = edges.unionAll(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        image = work.save(f"{name}-image{len(steps)}", least.join(jump, "label").select("node", F.col("further").alias("label")))
        ends = [image.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        steps.append(image)
        edges = work.save(f"{name}-edges{len(steps)}", moved)
    labels = steps[-1]
    for image in reversed(steps[:-1]):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = image.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return work.save(f"{name}-labels", labels)
