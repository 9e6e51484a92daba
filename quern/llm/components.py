"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.exchange import cut


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of links (a, b) one node of its component, the same for all of them.

    In each round a node joins the first of its neighbours and itself in an order drawn by hash, and links are redrawn between
    what is left. A star is gone after two rounds, and the falling runs of a chain in a drawn order are short. A hub is one row
    per link, joined and pre-aggregated like any other. The rounds' steps are put together at the end."""
    edges, steps = cut(links.select("a", "b").where("a <> b").distinct()), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("drawn"), F.col(c).alias("node"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        steps.append(cut(first.select(F.col("a").alias("at"), F.least("best", order("a"))["node"].alias("to"))))
        edges = cut(edges.join(steps[-1], F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
                    .join(steps[-1], F.col("b") == F.col("at")).select("a", F.col("to").alias("b"))
                    .where("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = steps[0].select(F.col("at").alias("node"), F.col("to").alias("component"))
    for step in steps[1:]:
        named = named.join(step, F.col("component") == F.col("at"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(named)
