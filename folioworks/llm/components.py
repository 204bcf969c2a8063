"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SALTS = 16


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with facts (one row a key), where very many rows may share a key: rows are dealt by a salt of column by too."""
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def _hooks(edges: DataFrame, turn: int) -> DataFrame:
    """node, up: of each node's neighbours and itself the one that comes first in an order drawn anew each round."""
    order = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731  different nodes have different values
    best = edges.groupBy("a").agg(F.min(order("b")).alias("place"), F.min_by("b", order("b")).alias("b"))
    return best.select(F.col("a").alias("node"), F.when(F.col("place") < order("a"), F.col("b")).otherwise(F.col("a")).alias("up"))


def components(links: DataFrame, store: Scratch) -> DataFrame:
    """links: a long, b long. Returns node, label (the smallest node that can be reached).

    Each round every node moves three steps at most along hooks that lead to ever earlier places in a random order, and
    edges are written anew between where their ends went. Where ends went is connected as the ends were, whatever the
    steps. A node that has neighbours is first among them and itself with a chance of one half at most, so a round leaves half
    of the nodes or little more on average, whatever the shape of the graph and the order of its identifiers: the number
    of rounds and the tables of all rounds together follow the logarithm and the size of the graph. Rounds are
    written to the store: a lost executor costs one at most. Each node's way through the rounds is put together backwards.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges, ways = store.keep(both), []
    while not edges.isEmpty():
        hooks = store.keep(_hooks(edges, len(ways)))
        step = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        two = hooks.join(step, "up").select("node", F.col("next").alias("up"))
        ways.append(store.keep(two.join(step, "up").select("node", F.col("next").alias("up"))))
        at_a = ways[-1].select(F.col("node").alias("a"), F.col("up").alias("to_a"))
        at_b = ways[-1].select(F.col("node").alias("b"), F.col("up").alias("to_b"))
        moved = edges.join(at_a, "a").join(at_b, "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        contracted = store.keep(moved.distinct())
        store.drop(edges, hooks)
        edges = contracted
    if not ways:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = ways[-1].withColumnRenamed("up", "end")
    for way in reversed(ways[:-1]):
        onward = ends.select(F.col("node").alias("up"), "end")
        ends = store.keep(way.join(onward, "up", "left").select("node", F.coalesce("end", "up").alias("end")))
    least = ends.groupBy("end").agg(F.min("node").alias("label"))
    return spread_join(ends, least, "end", "node").select("node", "label")
