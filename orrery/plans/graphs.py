"""Connected components by least labels; every round is checkpointed if the session has a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows without their plan: a checkpoint, or kept in memory and on disk where the session has no checkpoint folder."""
    has_folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if has_folder else df.persist()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node that is reachable."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        best = F.least("label", F.coalesce("near", "label"), F.coalesce("far", "label"))
        new = cut(labels.join(near, "node", "left").join(far, "label", "left").select("node", best.alias("label"), (best != F.col("label")).alias("changed")))
        labels = new.drop("changed")
        if not new.where("changed").limit(1).count():
            return labels
