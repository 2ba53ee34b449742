"""Connected components of a link table, by repeated contraction.

Each round maps every node to its smallest neighbour (itself included) and replaces
the links by links between the images, until none is left. Rounds are written to
the shared folder; nothing but an emptiness test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component's name is its smallest node."""
    links = stored(links.select("a", "b").filter("a != b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("image")), "contraction")
        if labels is None:
            labels = step.withColumnRenamed("image", "component")
        else:
            labels = (labels.join(step, labels["component"] == step["node"], "left")
                      .select(labels["node"], F.coalesce("image", "component").alias("component")))
        labels = stored(labels, "labels")
        to_a = step.select(F.col("node").alias("a"), F.col("image").alias("a2"))
        to_b = step.select(F.col("node").alias("b"), F.col("image").alias("b2"))
        links = stored(links.join(to_a, "a").join(to_b, "b").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a != b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
