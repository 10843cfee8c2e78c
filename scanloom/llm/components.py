"""Connected components of a table of links, with labels that travel by joins and never to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its lowest node) for the nodes of links (a, b).

    In each turn a node takes the lowest label among its own and its neighbours', then the label of its
    label, so that the turns needed grow with the logarithm of a component's width. Every turn ends in a
    written table; a hub's neighbours meet by partial minima.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        lower = labels.select("node", "label").union(told).groupBy("node").agg(F.min("label").alias("label"))
        lower = written(lower, "labels")
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(lower.join(of, "label").select("node", F.least("label", "next").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
