"""Connected components of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links`` (a, b).

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots by doubling, and contracts the links to roots;
    it ends when no link joins two roots. Each step is written to the
    checkpoint folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not edges.isEmpty():
        root = cut(both(edges).groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"))
        while True:
            x, y = root.alias("x"), root.alias("y")
            further = cut(x.join(y, F.expr("x.to = y.node")).select("x.node", F.col("y.to").alias("to"), (F.col("x.to") != F.col("y.to")).alias("moved")))
            root = further.select("node", "to")
            if further.filter("moved").isEmpty():
                break
        if label is None:
            label = root
        else:
            x, y = label.alias("x"), root.alias("y")
            label = cut(x.join(y, F.expr("x.to = y.node"), "left").select("x.node", F.coalesce("y.to", "x.to").alias("to")))
        e, p, q = edges.alias("e"), root.alias("p"), root.alias("q")
        new = e.join(p, F.expr("e.a = p.node")).join(q, F.expr("e.b = q.node")).select(F.col("p.to").alias("a"), F.col("q.to").alias("b")).filter("a <> b")
        edges = cut(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.select("node", F.col("to").alias("component"))
