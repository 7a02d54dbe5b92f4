"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), nodes being bigint; root is the smallest node of the component.

    Each round gives a node the smallest parent found among its neighbours, hooks its old parent
    onto that too, and then halves all paths, so that the number of rounds follows the logarithm of
    the longest chain. Every step is a join of a few longs or an aggregate that is combined before the
    shuffle, and each round is cut off by a table that goes with the next; no group is ever gathered in one task, as
    the rows of a hub in a join can be split by Spark's own rule for skewed joins.
    """
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    parents = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
    while True:
        near = edges.join(parents.select(F.col("node").alias("b"), "p"), "b").groupBy(F.col("a").alias("node")).agg(F.min("p").alias("m"))
        step = parents.select("node", "p").join(near, "node").select("node", "p", F.least("p", "m").alias("m"))
        hooks = step.groupBy(F.col("p").alias("node")).agg(F.min("m").alias("h"))
        up = step.join(hooks, "node", "left").select("node", F.col("p").alias("was"), F.least("m", "h").alias("m"))
        jump = up.select(F.col("node").alias("m"), F.col("m").alias("up"))
        after = checkpointed(up.join(jump, "m").select("node", "was", F.least("m", "up").alias("p")))
        discard(parents)
        parents = after
        if after.where("p <> was").isEmpty():
            discard(edges)
            return parents.select("node", F.col("p").alias("root"))
