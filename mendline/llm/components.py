"""Connected components of a table of links, by alternating star contractions.

Every round links the larger neighbours of each node to its smallest neighbour, then the smaller ones likewise, until the
links no longer change; each component is then a star around its smallest node. The rounds grow with the logarithm of the
components' size. A round's links are written to the shared folder, so no lineage piles up and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mendline.sources.io import stored


def _mark(links: DataFrame) -> tuple[int, int]:
    """Number of links and an order-free checksum: equal marks of two rounds mean equal links."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s or 0)


def _to_smallest(pairs: DataFrame, keep: Column) -> DataFrame:
    """Link each u's neighbours v that `keep` admits, and u itself, to the smallest of them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of longs: (node, root) for every node that has a link to another one; root is the smallest
    node of the component. No links give no rows."""
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u > v").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, F.col("v") > F.col("u")).where("a > b").distinct()
        large = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _to_smallest(large, F.lit(True)).where("a > b").distinct()
        links = stored(small.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
