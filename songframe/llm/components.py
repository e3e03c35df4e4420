"""Connected components of a graph that lies in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace


def relabel(labels: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """``labels(node, comp)`` after ``links(a, b)`` joined components.

    Components are nodes here. Each round every component takes the smallest label among itself and
    its neighbours, then the label of that label, so paths halve; the rounds end when no label
    changes. Only components that a link touches take part.
    """
    of_a, of_b = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
    edges = space.keep(edges.union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    now = edges.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = edges.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = space.keep(least.join(up, "label").select("node", "was", F.col("up").alias("label")), "labels")
        moved = nxt.where("label <> was").limit(1).count()
        now = nxt.select("node", "label")
        if not moved:
            break
    merged = now.where("node <> label").select(F.col("node").alias("comp"), F.col("label").alias("to"))
    return space.keep(
        labels.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components"
    )
