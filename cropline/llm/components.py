"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cropline.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of a node are linked to the least of them.

    ``edges`` holds ``(a, b)`` with ``a > b``. The large star moves the larger
    neighbours, the small star the smaller ones and the node itself.
    """
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select("b", "a"))
    least = materialise(both.groupBy(F.col("a").alias("_node")).agg(F.least(F.min("b"), F.col("_node")).alias("_least")))
    # Two stored tables: adaptive execution can split the shuffle of a hub.
    linked = both.join(least, F.col("a") == F.col("_node"))
    if large:
        moved = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("_least").alias("b")).union(
            least.select(F.col("_node").alias("a"), F.col("_least").alias("b"))
        )
    return materialise(moved.filter(F.col("a") != F.col("b")).distinct())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge, the root being the
    least node of its component.

    Large-star and small-star steps alternate until they change nothing, which
    takes a logarithmic number of rounds also on long chains. Every step is a
    shuffle of the edges, with minima combined before it, and is stored in the
    shared folder. No neighbour list is gathered. Self links and null ends are
    ignored; no edges give no rows.
    """
    now = materialise(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    state = None
    while True:
        summary = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summary == state or summary[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = summary
        now = _star(_star(now, large=True), large=False)
