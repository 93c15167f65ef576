"""Connected components by alternating large-star and small-star passes (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.shared import Workspace


def _stars(of: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with m, the least of u and all of u's partners; and the table of minima, to be dropped afterwards.

    Partial minima are taken before the shuffle.

    The minima are written first: then both sides of the join are plain shuffles, and adaptive execution can split
    the node that a third of all others link to.
    """
    least, _ = work.save(of.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return of.join(least, "u"), least


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge touches; component: the least node it can reach.

    Each pass is a pre-aggregated minimum and a join, written to the shared folder; nothing is collected but a
    count and a checksum of the edges, by which the end is seen. The number of passes grows with the logarithm of
    the nodes. Each pass's tables are dropped when the next one's are written.
    """
    count, check = F.count("*"), F.bit_xor(F.xxhash64("u", "v"))

    def save(df: DataFrame, **stats: Column) -> tuple[DataFrame, dict]:
        return work.save(df, "edges", n=count, check=check, **stats)

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links, was = save(links)
    while was["n"]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, least = _stars(both, work)
        large, _ = work.save(starred.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        starred, smaller = _stars(large, work)
        small = starred.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, now = save(small.where("u > v").distinct())
        for done in (links, least, large, smaller):
            work.drop(done)
        links = new
        if now == was:  # edges are distinct, so equal count and checksum mean that a pass changed nothing
            break
        was = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
