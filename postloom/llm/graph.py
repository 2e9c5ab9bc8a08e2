"""Connected components of links between long node ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.sources.scratch import Workspace

ROWS_PER_TASK = 200_000


def sized(frame: DataFrame, rows: int) -> DataFrame:
    """As few partitions as the rows need; a shuffle is saved where one is enough."""
    return frame.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) for every node of `links(a, b)`; the component is one of its nodes.

    Each round gives the nodes an order by hash, dealt anew; every node moves to the one that
    stands first among its neighbours and theirs, and links between what is left are kept once. A
    star is one node after a round and a chain loses a constant share of its nodes, so rounds grow
    with the logarithm of the longest chain. A hub's links are combined map-side before they meet.
    Each round is written to the shared folder, which cuts the lineage. Links of a node to itself
    and null ends are ignored.
    """
    links = workspace.stage(links.where("a <> b").select("a", "b").distinct(), "links")
    n = links.count()
    size = 2 * n  # bounds the nodes
    both = sized(links.union(links.select("b", "a")), size)
    found = workspace.stage(
        both.groupBy("a").agg(F.first("a").alias("component")).withColumnRenamed("a", "node"),
        "components",
    )
    turn = 0
    while n:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), c.alias("to"))
        both = sized(links.union(links.select("b", "a")), 2 * n)
        near = _first(both.select("a", rank(F.col("b")).alias("m")), rank(F.col("a")))
        near = sized(workspace.stage(near, "near"), 2 * n)
        beyond = both.join(near.select(F.col("a").alias("b"), "m"), "b").select("a", "m")
        moved = _first(beyond.union(near.select("a", "m")), F.col("m"))
        moved = moved.select(F.col("a").alias("node"), F.col("m.to").alias("to"))
        moved = sized(workspace.stage(moved, "moves"), 2 * n)
        found = sized(found, size).join(
            moved.withColumnRenamed("node", "component"), "component", "left"
        )
        found = found.select("node", F.coalesce("to", "component").alias("component"))
        found = workspace.stage(found, "components")
        links = sized(links, n)
        for end in "ab":
            links = links.join(moved.withColumnRenamed("node", end), end).drop(end)
            links = links.withColumnRenamed("to", end)
        links = links.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        )
        links = workspace.stage(links.distinct(), "links")
        n = links.count()
    return found


def _first(rows: DataFrame, own: Column) -> DataFrame:
    """(a, m): the least m of each node's rows, and of its own."""
    return rows.groupBy("a").agg(F.min("m").alias("m")).select(
        "a", F.least("m", own).alias("m")
    )


def joined_components(parts: DataFrame, links: DataFrame, workspace: Workspace) -> DataFrame:
    """`parts(node, component)` after further `links(a, b)` between nodes, which may be new ones."""
    ends = links
    for end in "ab":
        own = parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        ends = ends.join(own, end, "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(ends, workspace).select(
        F.col("node").alias("component"), F.col("component").alias("to")
    )
    known = parts.join(merged, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )
    # Nodes that had no link before stand among the merged ones under their own name.
    new = merged.join(parts.select(F.col("component")).distinct(), "component", "left_anti")
    return workspace.stage(
        known.union(new.select(F.col("component").alias("node"), F.col("to").alias("component"))),
        "joined",
    )
