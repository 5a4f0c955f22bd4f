"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import durable, join_spread


def _with_least(links: DataFrame, own: bool, total: int) -> DataFrame:
    """``u, v, m`` of every link ``u, v``; ``m`` is the least ``v`` of its ``u``, or ``u`` itself if ``own``.

    Minima and degrees are summed up before they move, and links of a node of high
    degree don't: its minimum goes to them.
    """
    least = F.least(F.min("v"), F.first("u")) if own else F.min("v")
    facts = durable(links.groupBy("u").agg(least.alias("m"), F.count("*").alias("_degree")))
    return join_spread(links, facts, "u", "_degree", total)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that a link touches; the root is the smallest
    node of the component.

    Large-star and small-star steps alternate until the links are stars around
    their roots, which takes a logarithmic number of rounds whatever the shape.
    Each round aggregates before it shuffles and is cut by a written table; the
    driver sees one count and one checksum a round.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = durable(links.select(high.alias("u"), low.alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A root keeps no link above; every other node keeps one to its minimum.
        large = durable(large.filter("u > v").distinct())
        small = _with_least(large, False, seen[0])
        lower = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        now = durable(lower.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
