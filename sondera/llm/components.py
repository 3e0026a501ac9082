"""Connected components of a graph of links, by alternating large and small stars.

Each round joins the links with the smallest neighbour of each node, which is a
partial aggregate and a join, and writes the links to the shared folder.  Only
one number per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rounds grow with the logarithm of the longest path.
MOST_ROUNDS = 60


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or its not larger) neighbours to its smallest one."""
    n = _both(e)
    if not large:
        n = n.where("b < a")
    low = n.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
    j = n.join(low, n["a"] == low["u"])
    if large:
        out = j.where("b > a").select(F.col("low").alias("a"), "b")
    else:
        out = j.select(F.col("low").alias("a"), "b").unionByName(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes with a link; the component is its smallest node."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    last = None
    for _ in range(MOST_ROUNDS):
        before, e = e, shared.materialize(_star(_star(e, True), False), "stars")
        shared.remove(before)
        # Settled once every node hangs on one smallest node that hangs on none.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("links did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
