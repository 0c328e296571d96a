"""Connected components of a graph given as links, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut


def _star(links: DataFrame, towards: DataFrame) -> DataFrame:
    """links: node, other. towards: node, least. Joins plain tables, so that adaptive execution can split a hub's rows."""
    return links.join(towards, "node").select("other", "least")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "other"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node that has a link to another. links: a, b (long, not null).

    Every step is a table in the shared folder. Minima are folded before the shuffle; the number of rounds grows with the
    logarithm of the graph, and no node's links are ever gathered.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = cut(links.where("a != b").select(high.alias("node"), low.alias("other")).distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select("other", "node"))
        least = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")))
        large = _star(both, least).where("other > least").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        large = cut(large)
        least = cut(large.groupBy("node").agg(F.min("other").alias("least")))
        small = _star(large, least).where("other != least").select(F.col("other").alias("node"), F.col("least").alias("other"))
        links = cut(small.union(least).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    return links.select("node", F.col("other").alias("root"))
