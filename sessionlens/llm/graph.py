"""Connected components of an edge list, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, counted, discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, root)` for every node of `edges`, root being the smallest node reachable.

    Every node first points at the smallest of its neighbours and itself. In each round, links move to what their ends point
    at, and those within one part, or equal to another, go; roots turn to the smallest root that a link joins them to, and other
    nodes follow two pointers, so long chains shorten by powers of three. So a link is dealt out once, however many rounds there are: later ones
    carry a link for each two parts that are still to be joined. It ends when no pointer changes. A node with very many links is met in
    a join that Spark may split, and what it hears shrinks to one row a task before it is shuffled. Rounds are cut by tables in the
    shared folder, and each goes when the next is written. Roots of up to `SMALL` nodes, two numbers each, are broadcast; beyond that no
    link or component reaches the driver. Edges with a null end are ignored; an empty list gives no rows.
    """
    smaller, larger = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    links = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    links = materialize(links.select(smaller, larger).distinct(), "links")
    ends = links.select(F.col("dst").alias("node"), "src").unionByName(links.select(F.col("src").alias("node"), "src"))
    before, nodes = counted(ends.groupBy("node").agg(F.min("src").alias("root")), "roots")
    left = nodes
    while True:
        turned = roots = before.select("node", "root")
        lookup = F.broadcast(roots) if nodes <= SMALL else roots
        if left:
            moved = links
            for end in ("src", "dst"):
                moved = moved.join(lookup, F.col(end) == F.col("node")).drop(end, "node").withColumnRenamed("root", end)
            moved, left = counted(moved.where("src <> dst").select(smaller, larger).distinct(), "links")
            discard(links)
            links = moved
            # a node that is no root keeps its pointer, which ties it to its part
            hooks = links.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("to"))
            turned = roots.join(hooks, "node", "left").select("node", F.coalesce(F.when(F.col("node") == F.col("root"), F.col("to")), "root").alias("root"))
        turned = turned.select(F.col("node").alias("at"), F.col("root").alias("to"))
        turned, near = F.broadcast(turned) if nodes <= SMALL else turned, roots.withColumn("old", F.col("root"))
        for _ in range(2):
            near = near.join(turned, F.col("root") == F.col("at")).select("node", "old", F.col("to").alias("root"))
        near = near.coalesce(-(-nodes // 4096)) if 0 < nodes <= SMALL else near  # few rows need few files
        after, changed = counted(near, "roots", F.col("old") != F.col("root"))
        discard(before)
        if not changed:
            discard(links)
            return after.select("node", "root")
        before = after
