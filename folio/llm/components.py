"""Connected components of links, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """rows joined with the row of `table` (unique in `key`) that theirs names; a key may own a third of all rows."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    return hot_join(rows, materialize(table.join(sizes, key), "named-once"), [key], "n_rows", total).drop("n_rows")


def components(links: DataFrame) -> DataFrame:
    """node and root, one node of all that links lead to, for nodes that have links (a, b).

    Each round orders the nodes by a seeded hash; every node points to the first of its neighbours and itself, and to
    where that points. Links then join the targets, and links within one target vanish. In a random order at least a
    quarter of the nodes with links is expected to go in a round, whatever the links and identifiers are, so rounds
    grow with the logarithm of the longest chain. Two rounds share an order, as a star then ends in two. A node that a
    third of all links name is joined apart from the others. Nothing but numbers of links reaches the driver.
    """
    edges = materialize(links.select("a", "b"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    n_nodes, turn = roots.count(), 0
    while n_edges := edges.count():
        place = lambda c, seed=turn // 2: F.struct(F.xxhash64(c, F.lit(seed)).alias("order"), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(place("b")).alias("best"))
        first = materialize(best.select(F.col("a").alias("node"), F.least("best", place("a"))["node"].alias("to")), "first")
        jump = first.select(F.col("node").alias("to"), F.col("to").alias("then"))
        point = materialize(looked_up(first, "to", jump, n_nodes).select("node", F.col("then").alias("to")), "point")
        of_a, of_b = (point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        half = materialize(looked_up(edges, "a", of_a, n_edges), "half")
        moved = looked_up(half, "b", of_b, n_edges).select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "edges")
        targets = roots.select("root").distinct().join(point.select(F.col("node").alias("root"), "to"), "root", "left")
        roots = looked_up(roots, "root", targets.select("root", F.coalesce("to", "root").alias("to")), n_nodes)
        roots = materialize(roots.select("node", F.col("to").alias("root")), "roots")
        turn += 1
    return roots


def least_of_component(nodes: DataFrame, node: str, value: str, roots: DataFrame) -> DataFrame:
    """nodes with `least_of`, the least of `value` among all nodes of the component; a component may have a third of all nodes."""
    named = nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    named = materialize(named, "rooted")
    firsts = materialize(named.groupBy("root").agg(F.min(value).alias("least_of"), F.count("*").alias("n_nodes")), "firsts")
    total = firsts.agg(F.sum("n_nodes")).first()[0] or 0
    return hot_join(named, firsts, ["root"], "n_nodes", total).drop("n_nodes", "root")
