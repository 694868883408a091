"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node reachable from each linked node, as (node, component).

    Links are pairs of longs, in any direction, repeats and loops allowed; links
    with a null end are ignored.  Nodes without a link to another node have no
    row.  Each round is written to the shared folder; a node of high degree is a
    skewed key of plain joins, which adaptive execution splits.
    """
    u, v = F.col(left), F.col(right)
    edges = common.staged(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), u.isNotNull().alias("x"), v.isNotNull().alias("y")).filter("x and y and u <> v").select("u", "v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.staged(small.union(lowest.select("u", "m")).distinct(), "links")
