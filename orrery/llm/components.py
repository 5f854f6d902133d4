"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import table


def _hop(labels: DataFrame, up: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by its own label, where ``up`` has one."""
    following = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(following, "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) rows -> (node, label), label being the smallest node that is reachable.

    In each round every node points to its least neighbour or itself, four such steps are taken at once, and the edges are moved
    to where their ends have come. That keeps what is connected connected and shrinks it; no edge is left when every component
    has come to its smallest node. A round is three plans, each written as a table; only whether edges are left reaches the driver.
    """
    edges = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        up = table(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")))
        two = _hop(up, up)
        up = table(_hop(two, two))
        labels = up if labels is None else table(_hop(labels, up))
        for x in "ab":
            edges = edges.join(up.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")), x)
        moved = edges.where("to_a <> to_b")
        edges = table(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
    return labels
