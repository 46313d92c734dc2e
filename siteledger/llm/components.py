"""Connected components of a link graph, by contraction with Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import stored

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by
    one of its nodes.

    Each round every node points to its smallest neighbour (or itself), pointers
    are followed 2**JUMPS steps, and the graph shrinks to the nodes pointed to.
    All steps are joins; nothing but an emptiness test reaches the driver.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")), "components-pointers")
        for _ in range(JUMPS):
            to = to.join(to.select(F.col("from").alias("to"), F.col("to").alias("__to")), "to").select("from", F.col("__to").alias("to"))
        to = stored(to, "components-pointers")
        labels = labels.join(to, labels["component"] == to["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        edges = edges.join(to.withColumnsRenamed({"from": "a", "to": "x"}), "a").join(to.withColumnsRenamed({"from": "b", "to": "y"}), "b")
        edges = stored(edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "components-edges")
    return stored(labels, "components-labels")
