"""Connected components as joins, with no group ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import saved


def relabelled(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """``labels`` (node, label) with each label that is a node of ``mapping`` (node, label) replaced by that one's label.

    ``mapping`` holds a node once. Both should be saved tables: then a join on a label that a third of all nodes have
    is one that Spark splits (adaptive skew join).
    """
    to = mapping.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return labels.join(to, "label", "left").select("node", F.coalesce("above", "label").alias("label"))


def rooted(parents: DataFrame) -> DataFrame:
    """(node, label): the root above each node of a forest (node, label) whose labels are less than their nodes.

    Each round jumps to the label's own label, so paths get shorter by half.
    """
    parents = saved(parents, "parents")
    while True:
        new = saved(relabelled(parents, parents), "parents")
        changed = new.join(parents.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        parents = new
        if not changed:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the least node that can be reached.

    Each round every node takes the least of itself and its neighbours as its parent (partially aggregated, so a hub is
    no hot task); the roots of that forest are the nodes of the next round's graph, which has only the links
    between different trees. Rounds end when no link is left. Self-links and repeated links do no harm; no links, no rows.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = rooted(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        labels = roots if labels is None else saved(relabelled(labels, roots), "labels")
        low, high = (roots.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}")) for c in ("a", "b"))
        left = left.join(low, "a").join(high, "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        left = saved(left.distinct(), "links")
        if left.isEmpty():
            return labels
