"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node it reaches.

    Each round a node takes the smallest label among its neighbours and then the label of that
    label, so paths shorten by half. Neighbours are only ever reduced to a minimum, before
    the shuffle where possible; no node's neighbours are gathered. Links to itself and repeated
    links do no harm; nulls link nothing.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = kept(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = kept(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = kept(labels.join(least, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = kept(hooked.join(above, "label").select("node", F.least("label", "above").alias("label"),
                                                         (F.least("label", "above") < F.col("was")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.select("node", F.col("label").alias("root"))
        labels = labels.drop("moved")
