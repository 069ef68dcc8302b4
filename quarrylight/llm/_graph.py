"""Connected components of a link table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): after a number of rounds logarithmic in
the longest path, every node points straight at the smallest node of its
component.  Each step is an aggregation with map-side combining and a join on
the node, and is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, join_hot


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over `total` links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = join_hot(both, low, ["u"], total)  # a hub may hold most links
    if large:  # larger neighbours move to the smallest of the neighbourhood
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the node itself move to the smallest of them
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label) for each node of links (src, dst), the label being the smallest node of its component."""
    now = links.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, seen = checkpoint(now), None
    total = now.count()
    for _ in range(most_rounds):
        now = checkpoint(_star(checkpoint(_star(now, True, 2 * total)), False, total))
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
