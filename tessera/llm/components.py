"""Connected components of an edge table, as joins and aggregates only."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard
from .storage import materialise as _materialise

materialise = partial(_materialise, codec="none")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, label) with the smallest reachable node as label, for every node that has an edge.

    With ``rounds`` it stops after so many: equal labels are then still connected, but connected nodes may differ.
    """
    once = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "cc-edges")
    labels = _smallest_around(once, rounds)
    discard(once)
    return labels


def _smallest_around(edges: DataFrame, rounds: int | None) -> DataFrame:
    """``connected_components`` of a stored table (a, b).

    Each round every node takes the smallest label around it, then the label of its label; rounds grow with the logarithm
    of the longest path.  A node's edges are aggregated before they are shuffled, so a hub is no hot key.  Labels and edges
    meet in merge joins: a broadcast would take the labels through the driver, three times a round.
    """
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        around = both.join(labels.hint("merge"), both.v == labels.node).select("u", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        own = labels.select(F.col("node").alias("u"), "label", F.col("label").alias("old"))
        hooked = around.union(own).groupBy("u").agg(F.min("label").alias("label"), F.max("old").alias("old")).withColumnRenamed("u", "node")
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2")).hint("merge")
        new = materialise(hooked.join(up, hooked.label == up.n2, "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "old"), "cc-labels")
        if rounds is not None:
            rounds -= 1
        moved = rounds != 0 and not new.where("label <> old").isEmpty()
        discard(labels)
        labels = new.select("node", "label")
        if not moved:
            return labels


class Components:
    """Components that grow by batches of edges.

    Edges are kept between labels, not nodes: once two ends have one label their edge is gone, so later batches only pay for
    what they join.  ``labels`` is (node, label), or None before the first edge.
    """

    def __init__(self) -> None:
        self.labels: DataFrame | None = None
        self.open: DataFrame | None = None

    def _between(self, edges: DataFrame) -> DataFrame:
        for c in ("a", "b") if self.labels is not None else ():
            side = self.labels.withColumnsRenamed({"node": "_n", "label": "_l"}).hint("merge")
            edges = edges.join(side, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_l", c)).drop("_n", "_l")
        return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def add(self, edges: DataFrame, rounds: int | None = 2) -> None:
        """Take in (a, b); without ``rounds`` the labels are exact afterwards."""
        edges = self._between(edges.unionByName(self.open) if self.open is not None else edges)
        edges = materialise(edges, "cc-open")
        if edges.isEmpty():
            self.open = None
            return
        step = _smallest_around(edges, rounds)
        if self.labels is not None:
            up = step.withColumnsRenamed({"node": "_n", "label": "_l"}).hint("merge")
            moved = self.labels.join(up, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
            step = moved.unionByName(step.join(self.labels.select("node").hint("merge"), "node", "left_anti"))
            step = materialise(step, "cc-labels")
        self.labels = step
        self.open = edges if rounds is not None else None
