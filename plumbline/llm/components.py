"""Connected components of a link table, by alternating large and small stars.

Both steps hang nodes on the smallest node they know of; the links end as stars around
the smallest node of each component after a number of rounds that grows with the
logarithm of the number of nodes. Everything is a grouped minimum and a join by node;
a node with very many links is pre-aggregated by the first and split by the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, packed, packs, tidy_shuffles


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every linked node; links has columns a and b, a < b."""
    links = cut(links.select(F.col("a").alias("lo"), F.col("b").alias("hi")).distinct())
    with tidy_shuffles(links.sparkSession):
        n_links = links.count() if packs(links.sparkSession) else 0
    links = packed(links, n_links)
    while True:
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = packed(packed(large, n_links).distinct(), n_links)
        # Small star: the smaller neighbours of a node, and itself, move to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").filter("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = packed(moved, n_links).unionByName(packed(least.select(F.col("m").alias("lo"), "hi"), n_links)).distinct()
        links = cut(packed(small, n_links))
        # Done when every link ends at a node that hangs on nothing, and no node hangs twice.
        hung = links.groupBy("hi").agg(F.count("*").alias("n"))
        above = links.select(F.col("lo").alias("hi")).distinct().withColumn("n", F.lit(2))
        open_ends = packed(hung.filter("n > 1").select("hi").unionByName(hung.join(above.select("hi"), "hi", "left_semi").select("hi")), n_links)
        with tidy_shuffles(links.sparkSession):
            if open_ends.isEmpty():
                break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
