"""Connected components of links between integers, by alternating stars.

Every node links to the smallest id it knows.  A *large star* links each
node's larger neighbours to the smallest id around it; a *small star* does the
same for its smaller neighbours.  Both keep the components, and a few rounds
of them end in stars around each component's smallest node.  Each half round
is one map-side combined minimum and one join against it; the minima are
written first, so adaptive execution can broadcast them or split the hot node
of the join.  Links never leave the executors: the driver sees two numbers a
round (the number of links and a checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a > b).  Star around each node's smallest neighbour."""
    both = links.select(F.col("b").alias("u"), F.col("a").alias("v")) if large else None
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near_all = near.unionByName(both) if large else near
    least = near_all.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    j = near_all.join(least, F.col("u") == F.col("_u"))
    if large:
        out = j.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another: ``root`` is the
    smallest node of its component.  Self-links, nulls, repeated and reversed
    links are allowed; no links give an empty result."""
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    e, last = materialize(e, "links"), None
    while True:
        s = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if s[0] == 0 or s == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = s
        e = materialize(_star(materialize(_star(e, True), "large"), False), "small")
