"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventbook.session import cut_lineage, drop_written


def _roots(up: DataFrame) -> DataFrame:
    """``comp, root``: where the steps ``comp -> up`` end, by doubling."""
    while True:
        above = up.select(F.col("comp").alias("up"), F.col("up").alias("top"))
        step = cut_lineage(up.join(above, "up", "left").select("comp", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        up = step.select("comp", "up")
        if step.filter("moved").isEmpty():
            return up.withColumnRenamed("up", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for the ends of ``edges`` (``a, b``, long); a component is named after its smallest node.

    Each component hangs itself under its smallest neighbour, the trees that arise are made flat by
    doubling, and the edges that still lead somewhere else go into the next turn between components.  A component
    that is no smallest one of its neighbourhood disappears in a turn, so turns follow the logarithm of
    a chain's length.
    """
    links = cut_lineage(edges.select("a", "b").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("comp", F.col("node"))
    while True:
        up = links.filter("a <> b").groupBy(F.greatest("a", "b").alias("comp")).agg(F.min(F.least("a", "b")).alias("up"))
        up = cut_lineage(up)
        if up.isEmpty():
            return labels
        roots = _roots(up)
        labels = cut_lineage(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        last = links
        for end in ("a", "b"):
            moved = roots.select(F.col("comp").alias(end), F.col("root").alias("to"))
            links = links.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = cut_lineage(links.filter("a <> b").distinct())
        drop_written(last)
