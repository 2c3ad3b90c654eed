"""Connected components over a distributed edge table.

Each round hooks every node to its smallest neighbour, halves the paths of the
resulting forest until they end in roots, and contracts the edges to the roots;
it ends when no edge joins two roots. Rounds grow with the logarithm of the
longest chain. Minima are taken with partial aggregation. A join gives each row of a
table one row of labels, so a node with very many neighbours makes a large partition
of small rows, which adaptive execution splits, not a product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ensure_checkpoint_dir, settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, root): root is the least node reachable; nodes without an edge to another are absent.

    Nulls and loops are dropped, repeated edges count once, no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first, total = True, None
    while rows := edges.count():
        total = total or rows
        both = edges.union(edges.select("b", "a"))
        forest = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), rows)
        moved = True
        while moved:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            forest = settled(forest.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), rows)
            moved = not forest.where("moved").isEmpty()
            forest = forest.select("node", "root")
        if first:
            labels, first = forest, False
        else:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = settled(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), total)
        ends = edges.join(forest.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(forest.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = settled(ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), rows)
    return labels
