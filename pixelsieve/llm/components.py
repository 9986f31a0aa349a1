"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import cut

#: Rows of a partition of labels. Partitions are as many as the edges need, so that small graphs take few tasks and
#: files a round.
ROWS = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of edges (a, b; longs) the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, then its label's label; the labels are
    written to the shared checkpoint folder, and rounds end when none has changed. Minima are combined before
    the shuffle, so that a node with very many neighbours is no hot spot. Rounds grow with the logarithm of the
    longest path. No edges: no rows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b"))
    parts = max(1, -(-both.count() // ROWS))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node").coalesce(parts))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = closer.select(F.col("node").alias("at"), F.col("root").alias("further"))
        new = closer.join(jump, F.col("root") == F.col("at")).select("node", "was", F.least("root", "further").alias("root"))
        new = cut(new.coalesce(parts))
        changed = new.filter("was <> root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
