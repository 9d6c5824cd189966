"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) of each node that has a link: the smallest node that can be reached.

    Each round takes the least label of a node's neighbours, then the label of that
    label, so that chains halve.  Every round is a written table.  Joins are on nodes;
    a node with very many links is split by the joins of adaptive execution, and its
    neighbours' labels are reduced before they are shuffled.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u != v").distinct())
    labels = written(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("v") == F.col("u"), "left").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = written(step)
        over = step.select(F.col("v").alias("x"), F.col("label").alias("y"))
        labels = written(step.join(over, F.col("label") == F.col("x"), "left").select("v", "old", F.least("label", "y").alias("label")))
        if labels.where("label != old").isEmpty():
            return labels.select("v", "label")
        labels = labels.select("v", "label")
